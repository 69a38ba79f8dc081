"""Anomalies and outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.exprs import attach, known_keys, per_series
from ..functions.labels import severity
from ..functions.quantiles import counted_values, quantiles_of, sketched_quantiles
from ..session import settle
from .ordered import over_rows


_QUARTERS = {"_q1": 0.25, "_q3": 0.75}


def _fences(df: DataFrame, value_col: str, keys: Sequence[str], approx: float | None = None) -> DataFrame:
    if approx:
        return _fences_of(sketched_quantiles(df, value_col, _QUARTERS, approx, keys, "_n"), keys)
    return _fences_of(quantiles_of(counted_values(df, value_col, keys), _QUARTERS, keys, "_n"), keys)


def _fences_of(q: DataFrame, keys: Sequence[str]) -> DataFrame:
    iqr = F.col("_q3") - F.col("_q1")
    return q.filter(iqr > 0).select(
        *keys, "_n", iqr.alias("_iqr"), (F.col("_q1") - 1.5 * iqr).alias("_low"),
        (F.col("_q3") + 1.5 * iqr).alias("_high"),
    )


def _fence_score(v: Column) -> Column:
    far = F.greatest(F.abs(v - F.col("_high")), F.abs(F.col("_low") - v))
    return F.round(far / F.greatest(F.col("_iqr"), F.lit(1.0)), 2)


def _centre(df: DataFrame, value_col: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value_col).alias("_mean"), F.stddev_samp(value_col).alias("_std"),
        F.count(F.lit(1)).alias("_n"),
    )


def _small(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics by key, written first: the join with raw rows is then planned by their real size,
    and small ones move no raw row."""
    return settle(stats, "stats") if keys else stats


def iqr_outliers(df: DataFrame, value_col: str = "Sales", keys: Sequence[str] = (), approx: float | None = None) -> DataFrame:
    """Rows outside the 1.5 IQR fences, all columns kept.

    ``approx``: the rank error allowed for the quartiles, which then come from sketches; exact without it.
    """
    v = F.col(value_col)
    return (
        attach(known_keys(df, keys), _small(_fences(known_keys(df, keys), value_col, keys, approx), keys), keys)
        .filter((v < F.col("_low")) | (v > F.col("_high")))
        .withColumns({"outlier_score": _fence_score(v), "outlier_method": F.lit("iqr")})
        .drop("_n", "_iqr", "_low", "_high")
    )


def iqr_outlier_count(df: DataFrame, value_col: str = "Sales", keys: Sequence[str] = (), name: str = "outliers") -> DataFrame:
    """How many rows of each series lie outside the 1.5 IQR fences; series without any are absent where there are keys.

    Fences and counts both come from the counted values, so the rows are read once.
    """
    counted = counted_values(known_keys(df, keys), value_col, keys)
    outside = (F.col("_v") < F.col("_low")) | (F.col("_v") > F.col("_high"))
    found = attach(counted, _small(_fences_of(quantiles_of(counted, _QUARTERS, keys, "_n"), keys), keys), keys).filter(outside)
    n = F.sum("_c") if keys else F.coalesce(F.sum("_c"), F.lit(0))
    return found.groupBy(*keys).agg(n.alias(name))


def zscore_outliers(df: DataFrame, value_col: str = "Sales", keys: Sequence[str] = (),
                    threshold: float = 3.0) -> DataFrame:
    """Rows more than ``threshold`` sample deviations from the mean, all columns kept."""
    z = F.abs(F.try_divide(F.col(value_col) - F.col("_mean"), F.col("_std")))
    return (
        attach(known_keys(df, keys), _small(_centre(known_keys(df, keys), value_col, keys), keys), keys)
        .filter(z > threshold)
        .withColumns({"outlier_score": F.round(z, 2), "outlier_method": F.lit("zscore")})
        .drop("_mean", "_std", "_n")
    )


def detect_outliers(df: DataFrame, value_col: str = "Sales", method: str = "iqr",
                    keys: Sequence[str] = (), approx: float | None = None) -> DataFrame:
    if method == "iqr":
        return iqr_outliers(df, value_col, keys, approx)
    if method == "zscore":
        return zscore_outliers(df, value_col, keys)
    raise ValueError("unknown outlier method, use 'iqr' or 'zscore'")


def _rolling(df, order, keys, value_col, threshold, window, include_current, by_period):
    last = 0 if include_current else -1
    first = last - window + 1

    def make(frame, _):
        w = frame(first, last)
        return {
            "_mean": F.avg(value_col).over(w), "_std": F.stddev_samp(value_col).over(w),
            "_seen": F.count(value_col).over(w),
        }

    if by_period:
        w = per_series(keys, *order)
        rows = df.withColumns(make(lambda a, b: w.rowsBetween(a, b), w))
    else:
        rows = over_rows(df, order, window, make, keys)
    far = F.abs(F.try_divide(F.col(value_col) - F.col("_mean"), F.col("_std")))
    return rows.withColumn("_z", F.when(F.col("_seen") >= 3, far)).filter(F.col("_z") > threshold)


def detect_anomalies(df: DataFrame, method: str = "zscore", threshold: float = 2.5,
                     window: int = 6, keys: Sequence[str] = (), date_col: str = "Date",
                     value_col: str = "Sales", tiebreak: Sequence[str] = (),
                     include_current: bool = True, by_period: bool = False,
                     centre: DataFrame | None = None, approx: float | None = None) -> DataFrame:
    """Unusual rows with score and severity.

    ``by_period`` says that ``df`` is already rolled up to one row per period, so
    that a rolling window may hold a whole series. ``centre`` gives the statistics of the z-score
    (``Cube.centre``) where they are known, ``approx`` the rank error allowed for quartiles. Series with fewer
    than three rows have no anomalies.
    """
    df = known_keys(df, keys)
    v = F.col(value_col)
    shown = [*keys, *tiebreak, F.col(date_col).alias("Date"), v.alias("Sales")]
    if method == "iqr":
        score = _fence_score(v)
        out = attach(df, _small(_fences(df, value_col, keys, approx), keys), keys).filter(
            ((v < F.col("_low")) | (v > F.col("_high"))) & (F.col("_n") >= 3))
        return out.select(*shown, score.alias("anomaly_score"),
                          severity(score, 2, 3).alias("severity"), F.lit("iqr").alias("method"))
    if method == "zscore":
        z = F.abs(F.try_divide(v - F.col("_mean"), F.col("_std")))
        centre = _centre(df, value_col, keys) if centre is None else centre
        out = attach(df, _small(centre, keys), keys).filter((z > threshold) & (F.col("_n") >= 3))
    elif method == "rolling_deviation":
        out = _rolling(df, [date_col, *tiebreak], keys, value_col, threshold, window, include_current, by_period)
        z = F.col("_z")
    else:
        raise ValueError("unknown method, use zscore, iqr or rolling_deviation")
    score = F.round(z, 2)
    return out.select(*shown, score.alias("anomaly_score"),
                      severity(score, 3, 4).alias("severity"), F.lit(method).alias("method"))


def rolling_count(y: str, threshold: float = 2.5, window: int = 6) -> Column:
    """Number of rolling anomalies in the series array of column ``y``."""
    near = f"slice({y}, greatest(i - {window} + 2, 1), least(i + 1, {window}))"
    score = f"abs(try_divide(v - {A.mean(near)}, {A.std_samp(near)}))"
    scores = f"transform({y}, (v, i) -> CASE WHEN i >= 2 THEN {score} END)"
    return F.expr(f"CAST(size(filter({scores}, z -> z > {threshold}D)) AS BIGINT)")


def severity_counts(anomalies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many anomalies of each severity, zeros included."""
    return anomalies.groupBy(*keys).agg(*[
        F.count_if(F.col("severity") == s).alias(s) for s in ("low", "medium", "high")
    ])


def strongest_anomaly(anomalies: DataFrame, keys: Sequence[str] = (),
                      tiebreak: Sequence[str] = ()) -> DataFrame:
    """Highest score per series, the earliest row on ties."""
    first = F.min(F.struct(
        (-F.col("anomaly_score")).alias("_k"), "Date", *tiebreak, "Sales", "anomaly_score", "severity"
    ))
    return anomalies.groupBy(*keys).agg(first.alias("_f")).filter(F.col("_f").isNotNull()).select(
        *keys, F.col("_f.Date").alias("Date"), *[F.col(f"_f.{t}").alias(t) for t in tiebreak],
        F.col("_f.Sales").alias("Sales"), F.col("_f.anomaly_score").alias("anomaly_score"),
        F.col("_f.severity").alias("severity"),
    )
