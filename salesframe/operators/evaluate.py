"""Accuracy metrics, holdout and backtest comparison, champions and confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.exprs import attach, per_series
from ..session import settle
from .anomaly import rolling_count
from .forecast import (
    FOREST, FOREST_MONTHS, WITH_FOREST, Params, add_models, check_models, listed_paths, series_of,
)
from .rollup import business_facts


def _abs_pct(actual: Column, predicted: Column, tiny_only: bool) -> Column:
    """Absolute percent error; the divisor is at least 1, or 1 only for tiny actuals."""
    size = F.abs(actual)
    whole = F.when(size < 1e-8, F.lit(1.0)).otherwise(size) if tiny_only else F.greatest(size, F.lit(1.0))
    return F.abs(actual - predicted) / whole * 100


def metrics(df: DataFrame, keys: Sequence[str] = (), actual: str = "actual", predicted: str = "predicted",
            tiny_only: bool = False, more: Sequence[Column] = ()) -> DataFrame:
    """MAE, RMSE, MAPE and R2 per group, and ``more`` aggregates; R2 is 0 where the actuals do not vary."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    sums = df.groupBy(*keys).agg(
        F.avg(F.abs(a - p)).alias("MAE"), F.avg((a - p) * (a - p)).alias("_mse"),
        F.avg(_abs_pct(a, p, tiny_only)).alias("MAPE"), F.var_pop(a).alias("_var"),
        *more,
    )
    flat = F.when((F.col("_mse") == 0) & F.lit(tiny_only), 1.0).otherwise(0.0)
    return sums.select(
        *keys, "MAE", F.sqrt("_mse").alias("RMSE"), "MAPE",
        F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")).otherwise(flat).alias("R2"),
        *[c for c in sums.columns if c not in (*keys, "MAE", "MAPE", "_mse", "_var")],
    )


def _round_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "MAE": F.round("MAE", 2), "RMSE": F.round("RMSE", 2),
        "MAPE": F.round("MAPE", 2), "R2": F.round("R2", 3),
    })


def split_point(n: Column, test_ratio: float = 0.2) -> Column:
    """Number of training months of a time split."""
    return F.greatest(F.floor(n * F.lit(1 - test_ratio)).cast("int"), F.lit(3))


def time_split(monthly: DataFrame, keys: Sequence[str] = (), test_ratio: float = 0.2) -> DataFrame:
    """Mark the months of each series as train or test."""
    n = F.count(F.lit(1)).over(per_series(keys))
    i = F.row_number().over(per_series(keys, "Date"))
    return monthly.withColumn("part", F.when(i <= split_point(n, test_ratio), "train").otherwise("test"))


def _scored(series: DataFrame, keys: Sequence[str], models: Sequence[str], params: Params | None) -> DataFrame:
    """Actual and predicted of every model at every origin.

    ``series`` has ``y``, ``origins`` (months used for training) and ``h``.
    """
    cut = series.select(*keys, "dates", F.col("y").alias("_all"), "h", "origins", F.posexplode("origins").alias("_i", "o")).select(
        *keys, "o", "h", F.slice("_all", 1, F.col("o")).alias("y"),
        F.slice("_all", F.col("o") + 1, F.col("h")).alias("_actual"),
        F.slice("dates", 1, F.col("o")).alias("dates"), (F.size("origins") - F.col("_i")).alias("slot"),
        F.size("_all").alias("_months"),
    )
    if FOREST not in models:
        return _classic(cut, keys, models, params)
    from .ml import forest_paths

    paths = forest_paths(cut.filter(F.col("_months") >= FOREST_MONTHS).drop("_actual", "_months"), keys)
    scored = cut.select(*keys, "o", "h", "_actual").join(paths, [*keys, "o", "h"]).selectExpr(
        *[f"`{k}`" for k in keys], "o", "h", f"'{FOREST}' AS model_key", "inline(arrays_zip(_actual, v)) AS (actual, predicted)")
    others = [m for m in models if m != FOREST]
    return _classic(cut, keys, others, params).unionByName(scored) if others else scored


def _classic(cut: DataFrame, keys: Sequence[str], models: Sequence[str], params: Params | None) -> DataFrame:
    done = add_models(cut.drop("dates", "slot", "_months"), models, params=params)
    quoted = [f"`{k}`" for k in keys]
    return done.selectExpr(*quoted, "o", "h", "_actual", f"inline({listed_paths(models, 'p_{}.f')})").selectExpr(
        *quoted, "o", "h", "model_key", "inline(arrays_zip(_actual, v)) AS (actual, predicted)")


def _holdout_plan(series: DataFrame, test_ratio: float = 0.2) -> DataFrame:
    n = F.size("y")
    split = split_point(n, test_ratio)
    return series.withColumn("_o", split).withColumn("h", n - F.col("_o")).filter(F.col("h") >= 2).withColumn(
        "origins", F.array("_o")).drop("_o")


def _backtest_plan(series: DataFrame, min_train: Column, horizon: int, max_splits: int) -> DataFrame:
    n = F.size("y")
    first = F.greatest(min_train, n - horizon + 1 - max_splits)
    return series.filter(n >= min_train + horizon).withColumns({
        "h": F.lit(horizon), "origins": F.sequence(first.cast("int"), n - horizon)})


def ranked(comparison: DataFrame, keys: Sequence[str] = (), by: str = "MAPE",
           order: Sequence[str] = WITH_FOREST) -> DataFrame:
    """Number the models of each series from best to worst; ties follow ``order``."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model_key")), F.lit(99))
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.col(by), F.when(place > 0, place).otherwise(99))
    return comparison.withColumn("rank", F.row_number().over(w).cast("long"))


def compare_models(df: DataFrame, keys: Sequence[str] = (), models: Sequence[str] = WITH_FOREST,
                   test_ratio: float = 0.2, params: Params | None = None) -> DataFrame:
    """Holdout metrics of every model and series, best first; series too short for two test months give none."""
    check_models(models)
    scored = _scored(_holdout_plan(series_of(df, keys), test_ratio), keys, models, params)
    out = _round_metrics(metrics(scored, [*keys, "model_key"]))
    return ranked(out.withColumn("Accuracy", L.accuracy_label(F.col("MAPE"))), keys)


def backtest(df: DataFrame, keys: Sequence[str] = (), models: Sequence[str] = WITH_FOREST,
             min_train: int = 6, horizon: int = 1, max_splits: int = 8,
             params: Params | None = None) -> DataFrame:
    """Expanding-window metrics pooled over the last origins of each series."""
    check_models(models)
    plan = _backtest_plan(series_of(df, keys), F.lit(min_train), horizon, max_splits)
    scored = _scored(plan, keys, models, params)
    splits = (F.count(F.lit(1)) / F.max("h")).cast("long").alias("Splits")
    out = _round_metrics(metrics(scored, [*keys, "model_key"], more=[splits]))
    return ranked(out.withColumn("Horizon", F.lit(horizon).cast("long")), keys)


def best_model(comparison: DataFrame, keys: Sequence[str] = (), by: str = "MAPE") -> DataFrame:
    """The best row of a comparison per series."""
    return ranked(comparison.drop("rank"), keys, by).filter("rank = 1").drop("rank")


def _champion_plan(series: DataFrame) -> DataFrame:
    """Origins that judge a series: recent one-month backtests, or one holdout for short histories."""
    n = F.size("y")
    least = F.greatest(F.lit(6), F.least(F.lit(12), F.floor(n / 2).cast("int")))
    first = F.greatest(least, n - 6)
    split = split_point(n)
    long = n >= 10
    return series.withColumns({
        "h": F.when(long, F.lit(1)).otherwise(n - split),
        "origins": F.when(long, F.sequence(first, F.greatest(n - 1, first))).otherwise(F.array(split)),
    }).filter(F.col("h") >= F.when(long, 1).otherwise(2))


def champions(df: DataFrame, keys: Sequence[str] = (), models: Sequence[str] = WITH_FOREST,
              fallback: str = "holts") -> DataFrame:
    """The best model of every series with its metrics and how it was judged."""
    return _champions(settle(series_of(df, keys), "series"), keys, models, fallback)


def _champions(series: DataFrame, keys: Sequence[str], models: Sequence[str] = WITH_FOREST,
               fallback: str = "holts") -> DataFrame:
    scored = _scored(_champion_plan(series), keys, models, None)
    best = best_model(_round_metrics(metrics(scored, [*keys, "model_key"])), keys)
    n = F.size("y")
    sizes = series.select(*keys, n.cast("long").alias("months"), F.element_at("dates", -1).alias("trained_on"))
    how = F.when(F.col("model_key").isNull(), "default").when(F.col("months") >= 10, "backtest").otherwise("holdout")
    return attach(sizes, best, keys).withColumn("judged_by", how).withColumn(
        "model_key", F.coalesce("model_key", F.lit(fallback)))


def with_champion(series: DataFrame, keys: Sequence[str], models: Sequence[str] = WITH_FOREST) -> DataFrame:
    """Monthly arrays with the ``champion`` model of each series; the arrays are written once."""
    series = settle(series, "series")
    picked = _champions(series, keys, models).select(*keys, F.col("model_key").alias("champion"))
    return attach(series, picked, keys)


# Points taken off 100 per band of error, volatility, history and anomalies.
def confidence_score(mape: Column, cv: Column, months: Column, anomalies: Column) -> Column:
    error = F.when(mape < 10, 0).when(mape < 20, 10).when(mape < 35, 25).otherwise(40)
    swing = F.when(cv < 10, 0).when(cv < 20, 8).when(cv < 35, 18).otherwise(30)
    depth = F.when(months >= 24, 0).when(months >= 12, 10).when(months >= 6, 22).otherwise(35)
    odd = F.when(anomalies == 0, 0).when(anomalies <= 2, 5).when(anomalies <= 5, 12).otherwise(20)
    return F.greatest(F.lit(100) - error - swing - depth - odd, F.lit(0)).cast("long")


def with_confidence(df: DataFrame) -> DataFrame:
    """Add score, level and reason codes to rows with MAPE, cv, months and anomalies."""
    c = F.col
    rated = c("MAPE").isNotNull()
    score = confidence_score(c("MAPE"), c("cv"), c("months"), c("anomalies"))
    reason = lambda good, yes, no: F.when(rated, F.when(good, yes).otherwise(no))
    return df.withColumn("score", F.when(rated, score)).withColumns({
        "level": F.coalesce(L.confidence_level(c("score")), F.lit("Not rated")),
        "reason_error": reason(c("MAPE") < 20, "low_error", "high_error"),
        "reason_series": reason(c("cv") < 20, "stable_series", "volatile_series"),
        "reason_history": reason(c("months") >= 12, "sufficient_history", "limited_history"),
        "reason_anomalies": reason(c("anomalies") <= 2, "few_anomalies", "many_anomalies"),
    })


def confidence(df: DataFrame, keys: Sequence[str] = (), threshold: float = 2.5, window: int = 6,
               models: Sequence[str] = WITH_FOREST) -> DataFrame:
    """How far the champion's forecast of each series can be trusted."""
    best = champions(df, keys, models).select(*keys, "model_key", "MAPE")
    facts = business_facts(df, keys).select(
        *keys, "months", "cv", rolling_count("_y", threshold, window).alias("anomalies"))
    return with_confidence(attach(facts, best, keys))


def executive_summary(df: DataFrame, keys: Sequence[str] = (), threshold: float = 2.5,
                      window: int = 6, models: Sequence[str] = WITH_FOREST) -> DataFrame:
    """Headline row per series: totals, best and weakest month, growth, anomalies, best model, confidence."""
    facts = business_facts(df, keys).select(
        *keys, "total", "best_month", "best_sales", "worst_month", "worst_sales", "months", "cv",
        F.coalesce("growth_half", "growth_3").alias("growth"),
        rolling_count("_y", threshold, window).alias("anomalies"))
    best = compare_models(df, keys, models).filter("rank = 1").select(*keys, F.col("model_key").alias("best_model"), "MAPE")
    out = with_confidence(attach(facts, best, keys))
    return out.select(
        *keys, "total", "best_month", "best_sales", "worst_month", "worst_sales", "growth",
        L.signal(F.col("growth"), 10, "strong_upward", "declining", "stable").alias("trend"),
        "anomalies", "best_model", "MAPE", "score", "level",
    )
