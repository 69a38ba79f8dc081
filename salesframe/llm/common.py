"""Helpers that several training-data operators share.

All of them work on narrow rows (ids, digests, lengths), keep every row, and have
no step in which one key, one task or the driver holds a whole group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_written, write_table

#: What separates words: space and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def running_total(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name of ``totals``, the exact sum over all earlier rows of the same keys.

    The order is fixed by the data alone, whatever the session's settings: rows are dealt to
    slices, about the square root of their number, by a hash of the ``order`` columns; slices
    follow each other by number and rows within a slice by ``order``. So a key with a third of
    all rows is spread over all tasks, and neither a slice nor the one small row per key and
    slice that is summed up along a key is more than about that root. Rows that agree in all
    of ``order`` are interchangeable. ``df`` is read several times: pass a settled table.
    """
    slices = math.isqrt(df.count()) + 1
    # keys as columns that are never null, so that the join and the window share one shuffle of the rows
    plain = {f"_text{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}
    plain |= {f"_none{i}": F.col(k).isNull() for i, k in enumerate(keys)}
    by = [*plain, "_slice"]
    rows = df.withColumns(plain | {"_slice": F.pmod(F.xxhash64(*order), F.lit(slices))})
    per = rows.groupBy(*by).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    before = Window.partitionBy(*plain).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*by, *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in totals])
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, by).select(
        *df.columns,
        *[(F.col(f"_base_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(n) for n, v in totals.items()])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: ``node``, ``root`` (smallest node of its component).

    Alternates large-star and small-star steps until the edge set stays the same. Minima are
    pre-aggregated and joined back, so a node with very many edges is a skewed join
    (split by adaptive execution), never one group. Each round is written to the shared
    folder and read back, so a lost executor costs at most one round; what it came from is then dropped.
    """
    spark = edges.sparkSession
    flat = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    current, path = write_table(flat, "edges")
    seen = _signature(current)
    while seen[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large, step = write_table(large, "edges")
        drop_written(spark, path)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        current, path = write_table(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop_written(spark, step)
        now = _signature(current)
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def row_key(id_column: str = "doc_id", text: str = "text", *more: str) -> list[Column]:
    """128 bits, never null, that tell rows apart by id and whole text. Rows that agree are repeated rows."""
    body = text_or_empty(text)
    return [F.xxhash64(id_column, body, *more).alias("_key_a"),
            F.xxhash64(F.lit(1), body, F.lit(2), id_column, *more).alias("_key_b")]


KEY = ["_key_a", "_key_b"]


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as ``_row``, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def once(keyed: DataFrame) -> DataFrame:
    """One row of each row key; partitions by the key, so a join by it needs no further shuffle.

    Rows of one key that differ in other columns of ``_row``: the one with the smallest hash of all columns stays.
    """
    plain = keyed.schema["_row"].dataType.fields if "_row" in keyed.columns else []
    columns = [F.to_json(F.struct(F.col(f"_row.`{f.name}`"))) if "map<" in f.dataType.simpleString()
               else F.col(f"_row.`{f.name}`") for f in plain]
    first = Window.partitionBy(*KEY).orderBy(*([F.xxhash64(F.lit(i), *columns) for i in range(2)] if plain else KEY[:1]))
    return keyed.withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy")


def only_rows(docs: DataFrame, wanted: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is in ``wanted``; of repeated rows one stays.

    One shuffle of the rows, by their key.
    """
    keyed = docs.select(whole_row(docs), *row_key(id_column, text))
    return once(keyed.join(wanted.select(*KEY), KEY, "left_semi")).select("_row.*")
