"""Labels and texts that depend on one number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bands(c: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """First label whose limit lies above ``c``; NULL stays NULL."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for limit, label in limits:
        out = out.when(c < limit, label)
    return out.otherwise(last)


# The thresholds and labels below define the results.
def accuracy_label(mape: Column) -> Column:
    return _bands(mape, [(10, "Excellent"), (20, "Good"), (50, "Acceptable")], "Poor")


def volatility_label(cv: Column) -> Column:
    return _bands(cv, [(10, "Stable"), (20, "Moderately Stable")], "Volatile")


def assumption_label(load: Column) -> Column:
    return _bands(load, [(20, "Conservative"), (45, "Balanced"), (70, "Aggressive")], "High Risk")


def confidence_level(score: Column) -> Column:
    return _bands(score, [(50, "Low"), (75, "Moderate")], "High")


def horizon_caution(months: Column) -> Column:
    return _bands(months, [(12, "none"), (24, "planning_note"), (36, "two_year")], "beyond_three_years")


def correlation_label(r: Column) -> Column:
    return _bands(F.abs(r), [(0.3, "weak"), (0.6, "moderate")], "strong")


def severity(score: Column, medium: float, high: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def signal(change: Column, limit: float, up: str, down: str, flat: str) -> Column:
    """Three-way label of a percent change; NULL stays NULL."""
    return (
        F.when(change.isNull(), F.lit(None).cast("string"))
        .when(change > limit, up).when(change < -limit, down).otherwise(flat)
    )


def inr_text(value: Column) -> Column:
    """Compact rupee text: crores, lakhs, thousands, else a whole number."""
    size = F.abs(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(size >= 1e7, F.format_string("Rs %.2fCr", value / 1e7))
        .when(size >= 1e5, F.format_string("Rs %.2fL", value / 1e5))
        .when(size >= 1e3, F.format_string("Rs %.1fK", value / 1e3))
        .otherwise(F.concat(F.lit("Rs "), F.format_number(value, 0)))
    )
