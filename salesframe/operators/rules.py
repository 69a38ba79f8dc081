"""Threshold rules over the facts of a series: insights, alerts, recommendations, actions.

Every rule table has one row per rule that fires:
``(keys…, seq, code, level, subject, metric)``. Codes stand for texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import attach, known_keys
from ..functions.labels import signal
from .anomaly import detect_anomalies, iqr_outlier_count, rolling_count, strongest_anomaly
from .cube import Cube, roll_up
from .rollup import business_facts, main_driver, recent_days

Rule = tuple[Column, "Column | str", "Column | str", "Column | None", "Column | None"]


def _text(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def fire(facts: DataFrame, keys: Sequence[str], rules: Sequence[Rule],
         otherwise: tuple[str, str] | None = None) -> DataFrame:
    """One row per rule whose condition holds, numbered in rule order per series."""
    none = F.lit(None)
    rows = [
        F.when(cond, F.struct(
            _text(code).alias("code"), _text(level).alias("level"),
            (none if subject is None else subject).cast("string").alias("subject"),
            (none if metric is None else metric).cast("double").alias("metric"),
        ))
        for cond, code, level, subject, metric in rules
    ]
    fired = F.array_compact(F.array(*rows))
    if otherwise:
        fallback = F.array(F.struct(
            F.lit(otherwise[0]).alias("code"), F.lit(otherwise[1]).alias("level"),
            none.cast("string").alias("subject"), none.cast("double").alias("metric")))
        fired = F.when(F.size(fired) > 0, fired).otherwise(fallback)
    return facts.select(*keys, F.posexplode(fired).alias("_i", "_r")).select(
        *keys, (F.col("_i") + 1).cast("long").alias("seq"), "_r.*"
    )


def _month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def _present(df: DataFrame, dims: Sequence[str]) -> list[str]:
    return [d for d in dims if d in df.columns]


def insights(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    dims = _present(df, ["Category", "Region"])
    dims = [d for d in dims if d not in keys]
    facts = business_facts(df, keys, dims)
    n, c = F.col("months"), F.col
    two = n >= 2
    rules: list[Rule] = [
        (n < 2, "not_enough_data", "neutral", None, n),
        (two & c("growth_half").isNotNull(), signal(c("growth_half"), 10, "strong_upward", "declining", "stable"),
         signal(c("growth_half"), 10, "positive", "warning", "neutral"), None, c("growth_half")),
        (two, "best_month", "positive", _month("best_month"), c("best_sales")),
        (two, "weakest_month", "warning", _month("worst_month"), c("worst_sales")),
        (two & (n >= 4), "recent_momentum", signal(c("momentum"), 5, "positive", "warning", "neutral"), None, c("momentum")),
    ]
    if "Category" in dims:
        heavy = c("top_Category_share") > 50
        rules.append((two & c("top_Category").isNotNull(),
                      F.when(heavy, "category_concentration").otherwise("top_category"),
                      F.when(heavy, "warning").otherwise("positive"), c("top_Category"), c("top_Category_share")))
    if "Region" in dims:
        rules.append((two & c("weak_Region").isNotNull(), "underperforming_region",
                      F.when(c("weak_Region_share") < 15, "warning").otherwise("neutral"),
                      c("weak_Region"), c("weak_Region_share")))
    rules.append((two, F.when(c("cv") > 30, "high_volatility").otherwise("consistent_pattern"),
                  F.when(c("cv") > 30, "warning").otherwise("positive"), None, c("cv")))
    return fire(facts, keys, rules)


def alerts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    facts = business_facts(df, keys)
    drop, enough = -F.col("mom"), F.col("months") >= 3
    falling = (F.col("before_previous_sales") > F.col("previous_sales")) & (
        F.col("previous_sales") > F.col("latest_sales"))
    return fire(facts, keys, [
        (enough & (drop > 10), "revenue_drop", F.when(drop > 20, "danger").otherwise("warning"), None, drop),
        (enough & falling, "three_falling_months", "warning", None, None),
    ])


def _with_row_anomalies(facts: DataFrame, df: DataFrame, keys: Sequence[str], threshold: float,
                        window: int, tiebreak: Sequence[str], include_current: bool) -> DataFrame:
    """Number of rolling anomalies over raw rows."""
    found = detect_anomalies(df, "rolling_deviation", threshold, window, keys, tiebreak=tiebreak,
                             include_current=include_current)
    counts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("anomalies"))
    return attach(facts, counts, keys).fillna(0, ["anomalies"])


def recommendations(df: DataFrame, keys: Sequence[str] = (), threshold: float = 2.5, window: int = 6,
                    tiebreak: Sequence[str] = (), include_current: bool = True) -> DataFrame:
    dims = [d for d in _present(df, ["Category", "Region"]) if d not in keys]
    c = F.col
    facts = _with_row_anomalies(
        business_facts(df, keys, dims), df, keys, threshold, window, tiebreak, include_current)
    moved = (c("months") >= 3) & (c("prev3") > 0)
    rules: list[Rule] = [
        (moved & (c("momentum") < -5), "reverse_slowdown", "action", None, c("momentum")),
        (moved & (c("momentum") > 5), "support_demand", "action", None, c("momentum")),
        (c("anomalies") >= 3, "review_anomalies", "action", None, c("anomalies")),
    ]
    if "Category" in dims:
        rules.append((c("top_Category_share") > 50, "diversify_categories", "action", c("top_Category"), c("top_Category_share")))
    if "Region" in dims:
        rules.append((c("weak_Region_share") < 15, "focus_region", "action", c("weak_Region"), c("weak_Region_share")))
    rules.append((c("cv") > 30, "separate_effects", "action", None, c("cv")))
    return fire(facts, keys, rules, otherwise=("keep_monitoring", "info"))


def business_actions(df: DataFrame, keys: Sequence[str] = (), threshold: float = 2.5,
                     window: int = 6) -> DataFrame:
    dims = [d for d in _present(df, ["Category", "Region"]) if d not in keys]
    c, n = F.col, F.col("months")
    facts = business_facts(df, keys, dims).withColumn("anomalies", rolling_count("_y", threshold, window))
    rules: list[Rule] = []
    if "Region" in dims:
        rules.append((c("top_Region").isNotNull(), "focus_top_region", "action", c("top_Region"), c("top_Region_share")))
    if "Category" in dims:
        heavy = c("top_Category_share") >= 45
        rules.append((c("top_Category").isNotNull(),
                      F.when(heavy, "reduce_dependency").otherwise("review_weakest_category"), "action",
                      F.when(heavy, c("top_Category")).otherwise(c("weak_Category")),
                      F.when(heavy, c("top_Category_share")).otherwise(c("weak_Category_share"))))
    rules += [
        (n >= 2, "investigate_month", "action", _month("worst_month"), c("worst_sales")),
        (c("anomalies") > 0, "explain_anomalies", "action", None, c("anomalies")),
        (F.lit(True), F.when(n < 24, "collect_more_months").otherwise("use_history"), "action", None, n),
    ]
    return fire(facts, keys, rules)


def planning_recommendations(df: DataFrame | Cube, keys: Sequence[str] = (), facts: DataFrame | None = None) -> DataFrame:
    """What to prioritise, review, benchmark and study, with the trend of the first and last months.

    ``facts``: the business facts of both dimensions, where they are known.
    """
    dims = [d for d in _present(df, ["Category", "Region"]) if d not in keys]
    facts, c = business_facts(df, keys, dims) if facts is None else facts, F.col
    rules: list[Rule] = []
    if "Category" in dims:
        rules += [
            (c("top_Category").isNotNull(), "prioritize_category", "action", c("top_Category"), c("top_Category_share")),
            (c("Category_levels") > 1, "review_category", "action", c("weak_Category"), c("weak_Category_share")),
        ]
    if "Region" in dims:
        rules.append((c("top_Region").isNotNull(), "benchmark_region", "action", c("top_Region"), c("top_Region_share")))
    rules += [
        (F.lit(True), signal(c("growth_3"), 5, "protect_growth", "investigate_decline", "create_growth"),
         signal(c("growth_3"), 5, "growing", "declining", "stable"), None, c("growth_3")),
        (F.lit(True), "study_best_month", "action", _month("best_month"), c("best_sales")),
        (F.lit(True), "study_worst_month", "action", _month("worst_month"), c("worst_sales")),
        (F.lit(True), "plan_with_forecast", "info", None, None),
    ]
    return fire(facts, keys, rules)


def upload_insights(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First look at a table: 30-day trend, month comparison, long trend, outliers, size hint."""
    c = F.col
    cube = roll_up(df, keys, (), "day")
    facts = business_facts(cube, keys)
    days = recent_days(cube, keys).select(*keys, F.col("change_pct").alias("_days"))
    odd = iqr_outlier_count(df, "Sales", keys, "_odd")
    facts = attach(attach(facts, days, keys), odd, keys)
    return fire(facts, keys, [
        (c("_days").isNotNull(), "last_30_days", "message", None, c("_days")),
        (c("months") >= 2, "month_comparison", signal(c("mom"), 0, "increasing", "decreasing", "stable"), None, c("mom")),
        (c("months") >= 6, "long_trend", "message", None, c("growth_half")),
        (c("_odd") > 0, "outliers", "message", None, c("_odd")),
        (c("rows") < 30, "small_dataset", "suggestion", None, c("rows")),
    ])


def signals(df: DataFrame, keys: Sequence[str] = (), threshold: float = 2.5, window: int = 6) -> DataFrame:
    """Direction, latest month movement and whether forecasts deserve a warning."""
    facts, c = business_facts(df, keys), F.col
    odd = rolling_count("_y", threshold, window)
    return facts.select(
        *keys, "growth_3", signal(c("growth_3"), 5, "growing", "declining", "stable").alias("direction"),
        F.coalesce("mom", F.lit(0.0)).alias("mom"),
        signal(F.coalesce("mom", F.lit(0.0)), 0, "up", "down", "flat").alias("movement"),
        odd.alias("anomalies"), ((odd > 0) | (c("cv") > 30)).alias("forecast_warning"),
    )


def root_cause(df: DataFrame, keys: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> DataFrame:
    """Which region and category moved the latest month, and the strongest odd row.

    Series with fewer than 30 rows give ``not_enough_data`` only. Two passes over the rows: the roll-up, and the
    search for odd rows with the statistics it gives.
    """
    df = known_keys(df, keys)
    cube = roll_up(df, keys, [d for d in _present(df, ["Region", "Category"]) if d not in keys])
    wide = cube.sizes()
    rules: list[Rule] = [(F.col("_rows") < 30, "not_enough_data", "info", None, F.col("_rows"))]
    enough = F.col("_rows") >= 30
    for dim in cube.dims:
        moved = main_driver(cube.by(dim), dim, keys).select(
            *keys, F.col("subject").alias(f"_s_{dim}"), F.col("change").alias(f"_c_{dim}"),
            F.col("total_change").alias(f"_t_{dim}"))
        wide = attach(wide, moved, keys)
        rules.append((enough & F.col(f"_s_{dim}").isNotNull(), f"{dim.lower()}_driver",
                      F.when(F.col(f"_t_{dim}") < 0, "decline").otherwise("growth"),
                      F.col(f"_s_{dim}"), F.col(f"_c_{dim}")))
    odd = strongest_anomaly(detect_anomalies(df, "zscore", 2.5, keys=keys, tiebreak=tiebreak, centre=cube.centre()),
                            keys, tiebreak)
    wide = attach(wide, odd.select(*keys, F.col("Date").alias("_d"), F.col("anomaly_score").alias("_a"),
                                   F.col("severity").alias("_v")), keys)
    rules.append((enough & F.col("_a").isNotNull(), "unusual_sales", F.col("_v"),
                  F.date_format("_d", "yyyy-MM-dd"), F.col("_a")))
    return fire(wide, keys, rules, otherwise=("no_strong_signal", "info"))
