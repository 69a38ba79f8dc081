"""Windows over rows in order, without putting a whole series in one task.

A lag or a trailing window over raw rows needs the global order of a series, and
one series, or one day of it, may hold a third of all rows. Rows are dealt out by
ranges of (keys, order, hash of the row) and written once, so that rows of one day
spread over many ranges; one small row per series and range gives every range its
starting number, and rows are numbered inside ranges. The numbers are then cut into
blocks of fixed length, and each block receives a copy of the rows before it that
its windows reach. Every window task so sees one block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

BLOCK_ROWS = 1 << 16


def _tie(df: DataFrame) -> Column:
    """64 bits of all columns that can be hashed: the place of a row among those that agree in the order."""
    plain = [F.col(f"`{n}`") for n, t in df.dtypes if "map<" not in t and "variant" not in t]
    return F.xxhash64(F.lit(0), *plain)


def with_position(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
                  name: str = "_pos") -> DataFrame:
    """Number the rows of each series from 1 in ``order``, nulls last; null keys form a series of their own.

    Rows that agree in all of ``order`` follow each other by a hash of their columns, so the numbers depend on
    the data alone (equal copies are interchangeable), and however many agree, ranges part them.
    """
    by = [F.col(c).asc_nulls_last() for c in (*keys, *order)]
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # copies have the same hash; their number of arrival parts even these
    dealt = df.withColumns({"_tie": _tie(df), "_copy": F.monotonically_increasing_id()}).repartitionByRange(
        spread, *by, "_tie", "_copy")
    rows = settle(dealt.drop("_tie", "_copy").withColumn("_part", F.spark_partition_id()), "ordered")
    counts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = F.row_number().over(
        Window.partitionBy(*keys, "_part").orderBy(*[F.col(c).asc_nulls_last() for c in order], _tie(df)))
    return rows.withColumn("_in", inside).join(start, same).select(
        *df.columns, (F.col("_before") + F.col("_in")).alias(name))


def over_rows(df: DataFrame, order: Sequence[str], lookback: int,
              make: Callable[[Callable[[int, int], object], object], Mapping[str, Column]],
              keys: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add trailing-window columns that look back at most ``lookback`` rows.

    ``make(frame, ordered)`` returns the columns: ``frame(a, b)`` is the window of
    rows ``a`` to ``b`` around the current one, ``ordered`` the bare window for lags.
    A row is copied to all following blocks that look back to it, so ``lookback`` may
    be longer than a block.
    """
    placed = with_position(df, order, keys)
    block = F.floor((F.col("_pos") - 1) / block_rows)
    last = F.floor((F.col("_pos") - 1 + lookback) / block_rows)
    spread = placed.withColumn("_own", block).withColumn("_block", F.explode(F.sequence(block, last)))
    ordered = Window.partitionBy(*keys, "_block").orderBy("_pos")
    columns = make(lambda a, b: ordered.rowsBetween(a, b), ordered)
    return (
        spread.withColumns(dict(columns)).filter(F.col("_own") == F.col("_block"))
        .drop("_pos", "_own", "_block")
    )
