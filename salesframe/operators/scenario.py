"""What-if projections on forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.exprs import pct, per_series

# Lever names in the order they act, and the preset scenarios in percent.
LEVERS = ["growth", "seasonality", "discount", "marketing", "churn", "new_channel"]
PRESETS: dict[str, tuple[float, ...]] = {
    "best": (20, 10, 0, 25, 0, 15),
    "base": (8, 0, -5, 10, 3, 0),
    "worst": (-5, -10, -15, 0, 15, 0),
    "custom": (8, 0, 0, 0, 0, 0),
}
LOAD_WEIGHTS = {"growth": 0.7, "seasonality": 0.6, "discount": 0.8, "marketing": 0.7, "churn": 1.0, "new_channel": 0.7}


def levered(value: str, step: str, n: str, levers: Mapping[str, str]) -> str:
    """SQL text of a forecast value under the six levers, each a column or number in percent."""
    i = f"({step} - 1)"
    share = {k: f"(CAST({v} AS DOUBLE) / 100)" for k, v in levers.items()}
    grown = f"{value} * pow(pow(1 + {share['growth']}, 1 / 12D), {step})"
    wave = f"CASE WHEN {n} > 1 THEN sin(2 * pi() * {i} / ({n} - 1)) ELSE 0D END"
    factors = [
        f"(1 + {share['seasonality']} * {wave})",
        f"(1 + {share['discount']})",
        f"CASE WHEN {share['marketing']} > 0 THEN 1 + {share['marketing']} * least({step} / 3D, 1D) ELSE 1D END",
        f"CASE WHEN {share['churn']} > 0 THEN greatest(1 - {share['churn']} * {i} / {n}, 0.5D) ELSE 1D END",
        f"(1 + {share['new_channel']})",
    ]
    return f"greatest({' * '.join([grown, *factors])}, 0D)"


def _sized(forecasts: DataFrame, ids: Sequence[str]) -> DataFrame:
    return forecasts.withColumn("_n", F.count(F.lit(1)).over(per_series(ids)))


def apply_levers(forecasts: DataFrame, levers: Mapping[str, str | float], ids: Sequence[str]) -> DataFrame:
    """Add ``Value``; levers are numbers or names of columns already beside the forecast."""
    text = {k: str(levers.get(k, 0)) for k in LEVERS}
    return _sized(forecasts, ids).withColumn("Value", F.expr(levered("Forecast", "step", "_n", text))).drop("_n")


def apply_scenarios(forecasts: DataFrame, ids: Sequence[str],
                    scenarios: Mapping[str, Sequence[float]] = PRESETS) -> DataFrame:
    """Every forecast row under every scenario; the few scenarios ride along in the plan."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("scenario"), *[F.lit(float(v)).alias(f"_{k}") for k, v in zip(LEVERS, values)])
        for name, values in scenarios.items()
    ])
    wide = _sized(forecasts, ids).select(*ids, "step", "Date", "Forecast", "_n", F.inline(rows))
    text = {k: f"_{k}" for k in LEVERS}
    return wide.select(*ids, "scenario", "step", "Date", "Forecast",
                       F.expr(levered("Forecast", "step", "_n", text)).alias("Value"))


def lever_breakdown(forecasts: DataFrame, levers: Sequence[float], ids: Sequence[str],
                    smallest: float = 0.01) -> DataFrame:
    """Revenue change of each lever alone, largest first; changes up to ``smallest`` are left out."""
    alone = {k: tuple(v if j == i else 0 for j in range(len(LEVERS)))
             for i, (k, v) in enumerate(zip(LEVERS, levers))}
    sums = apply_scenarios(forecasts, ids, alone).groupBy(*ids, F.col("scenario").alias("lever")).agg(
        (F.sum("Value") - F.sum("Forecast")).alias("delta"))
    kept = sums.filter(F.abs("delta") > smallest)
    return kept.withColumn("rank", F.row_number().over(
        per_series(ids, F.col("delta").desc(), F.col("lever"))).cast("long"))


def lever_drivers(forecasts: DataFrame, levers: Sequence[float], ids: Sequence[str]) -> DataFrame:
    """Strongest helpful and harmful lever with the sums of both sides."""
    parts = lever_breakdown(forecasts, levers, ids, smallest=0.0)
    d = F.col("delta")
    best = F.min(F.when(d > 0, F.struct((-d).alias("k"), F.col("lever").alias("v"))))
    worst = F.min(F.when(d < 0, F.struct(d.alias("k"), F.col("lever").alias("v"))))
    return parts.groupBy(*ids).agg(
        best.alias("_b"), worst.alias("_w"),
        F.sum(F.greatest(d, F.lit(0.0))).alias("upside"),
        F.sum(F.greatest(-d, F.lit(0.0))).alias("downside"),
    ).select(
        *ids, F.col("_b.v").alias("top_positive"), (-F.col("_b.k")).alias("top_positive_delta"),
        F.col("_w.v").alias("top_negative"), F.col("_w.k").alias("top_negative_delta"), "upside", "downside",
    )


def scenario_summary(scenarios: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Total, mean, change against the base forecast, peak month and the best-worst spread."""
    peak = F.min(F.struct((-F.col("Value")).alias("k"), F.col("Date").alias("d")))
    sums = scenarios.groupBy(*ids, "scenario").agg(
        F.sum("Value").alias("total"), F.avg("Value").alias("mean"), F.sum("Forecast").alias("_base"),
        peak.alias("_p"))
    spread = F.sum(F.when(F.col("scenario") == "best", F.col("total")).when(
        F.col("scenario") == "worst", -F.col("total"))).over(per_series(ids))
    return sums.select(
        *ids, "scenario", "total", "mean", (F.col("total") - F.col("_base")).alias("delta"),
        pct(F.col("total") - F.col("_base"), F.col("_base")).alias("delta_pct"),
        F.col("_p.d").alias("peak_month"), spread.alias("best_worst_spread"),
    )


def scenario_running(scenarios: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Running total and monthly difference to the base forecast of every scenario."""
    from pyspark.sql import Window
    w = per_series([*ids, "scenario"], "step").rowsBetween(Window.unboundedPreceding, 0)
    return scenarios.withColumns({
        "Cumulative": F.sum("Value").over(w), "Difference": F.col("Value") - F.col("Forecast"),
    })


def break_even(scenarios: DataFrame, ids: Sequence[str]) -> DataFrame:
    """First month whose running difference to the base forecast is positive."""
    from pyspark.sql import Window
    w = per_series([*ids, "scenario"], "step").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.sum(F.col("Value") - F.col("Forecast")).over(w)
    ends = scenarios.withColumn("_gap", gap).groupBy(*ids, "scenario").agg(
        (F.sum("Value") - F.sum("Forecast")).alias("delta"),
        F.min(F.when(F.col("_gap") > 0, F.col("Date"))).alias("_first"))
    status = F.when(F.col("delta") < 0, "not_reached").when(
        (F.col("delta") > 0) & F.col("_first").isNotNull(), "reached").otherwise("already_above")
    return ends.select(*ids, "scenario", "delta", status.alias("status"),
                       F.when(status == "reached", F.col("_first")).alias("month"))


def assumption_load(levers: DataFrame) -> DataFrame:
    """Weighted size of the assumptions of a table with one column per lever, and its label."""
    def part(name: str) -> Column:
        size = F.abs(name) if name in ("growth", "seasonality", "discount") else F.col(name)
        return size * LOAD_WEIGHTS[name]
    load = sum((part(k) for k in LEVERS[1:]), part(LEVERS[0]))
    return levers.withColumn("load", load).withColumn("label", L.assumption_label(F.col("load")))


def scenario_wide(scenarios: DataFrame, ids: Sequence[str],
                  names: Sequence[str] = tuple(PRESETS)) -> DataFrame:
    """One row per month with a column per scenario."""
    return scenarios.groupBy(*ids, "Date", "Forecast").pivot("scenario", list(names)).agg(
        F.round(F.first("Value"), 2)).withColumn("Month", F.date_format("Date", "MMM yyyy"))
