"""Exact and sketched quantiles and modes that never hold a group in one task.

Equal values are counted before the shuffle. The counted values are dealt out by
ranges of (key, value), so a key of any size is spread over many tasks; the number
of rows before each range comes from one small row per key and range. A quantile
is then read from the two values whose ranks enclose it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def exact_quantiles(df: DataFrame, value: str, wanted: Mapping[str, float],
                    keys: Sequence[str] = (), count_as: str | None = None) -> DataFrame:
    """One row per key with a column per wanted quantile, linearly interpolated.

    ``count_as`` names a column for the number of known values; NaN is missing.
    The counted values are written once, so a job runs while the plan is built.
    """
    return quantiles_of(counted_values(df, value, keys), wanted, keys, count_as)


def sketch_size(error: float) -> int:
    """The ``k`` of a KLL sketch whose normalised rank error is ``error`` (at 99 % confidence)."""
    return min(max(math.ceil((2.296 / error) ** (1 / 0.9723)), 8), 65535)


def sketched_quantiles(df: DataFrame, value: str, wanted: Mapping[str, float], error: float,
                       keys: Sequence[str] = (), count_as: str | None = None) -> DataFrame:
    """Quantiles within ``error`` of their rank, from one KLL sketch per key.

    Sketches are built in each task and merged, so what is shuffled is one sketch per key and task, whatever
    the number of distinct values. A value of the column is returned, without interpolation.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sketch = rows.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", F.lit(sketch_size(error))).alias("_s"), F.count("_v").alias("_n"))
    read = [F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double("_s", F.lit(float(q)))).alias(n) for n, q in wanted.items()]
    return sketch.select(*keys, *read, *([F.col("_n").alias(count_as)] if count_as else []))


def counted_values(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Known values ``_v`` per key with their number ``_c``, written by ranges ``_part`` of (key, value)."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(
        counted.repartitionByRange(spread, *keys, "_v").withColumn("_part", F.spark_partition_id()), "counted")


def quantiles_of(counted: DataFrame, wanted: Mapping[str, float], keys: Sequence[str] = (),
                 count_as: str | None = None) -> DataFrame:
    """Exact quantiles of ``counted_values``."""
    keys, names = list(keys), list(wanted)
    parts = counted.groupBy(*keys, "_part").agg(F.sum("_c").alias("_sum"))
    along = Window.partitionBy(*(keys or [F.lit(1)]))
    parts = parts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), F.sum("_sum").over(along).alias("_n"),
        F.coalesce(F.sum("_sum").over(along.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.join(parts, same).withColumn(
        "_from", F.col("_base") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))

    def at(rank):
        holds = (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_c"))
        return F.max(F.when(holds, F.col("_v")))

    places = [(n, (F.col("_n") - 1) * F.lit(float(wanted[n]))) for n in names]
    ends = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *[
        e for i, (_, h) in enumerate(places)
        for e in (at(F.floor(h)).alias(f"_lo{i}"), at(F.ceil(h)).alias(f"_hi{i}"))])
    read = [
        F.when(F.floor(h) == F.ceil(h), F.col(f"_lo{i}"))
        .otherwise((F.ceil(h) - h) * F.col(f"_lo{i}") + (h - F.floor(h)) * F.col(f"_hi{i}")).alias(n)
        for i, (n, h) in enumerate(places)]
    return ends.select(*keys, *read, *([F.col("_n").alias(count_as)] if count_as else []))


def most_common(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per key, the smallest on ties.

    Values are counted first, so equal copies collapse before the shuffle and no
    task holds the values of a group.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    )
    best = F.min(F.struct((-F.col("_c")).alias("c"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, F.col("_best.v").alias(value)
    )
