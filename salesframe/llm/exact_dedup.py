"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition yields one run of digests, which is reduced (one row per digest, with its best
identifier and the number of rows), sorted by digest and written. Runs are then merged in binomial
rounds: in each round every two neighbouring runs (``fan_in``, a power of two) are exchanged by
(merged run, digest), merged in sorted order, and of equal digests only the best identifier and the
number of rows survive. A digest that a third of all rows share so reaches any one task
at most ``fan_in`` times. All steps are DataFrame functions.

Texts are equal when they are identical after deleting all characters of
``[\\x20\\x09-\\x0D]``. Equality is verified at every level by more than the digest: runs only
merge rows that also agree in byte length and a second, independent hash.

Defined cases: a null text counts as empty, all empty texts are one group; of equal texts the
row with the most code points in the original text stays, then the smallest id (null ids
last), then any one of the repeated rows, which are identical; an empty table gives no rows;
other columns are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import KEY, SPACE, only_rows, row_key, text_or_empty

#: Runs merged in one round.
FAN_IN = 2

_SAME = ["sha", "size", "check"]


def digest_runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per row of ``docs``, numbered within its run and written once."""
    bare = docs.select(
        F.col(id_column).alias("id"), F.length(text_or_empty(text)).alias("chars"),
        *row_key(id_column, text),
        F.regexp_replace(text_or_empty(text), SPACE, "").alias("bare"))
    return settle(bare.select(
        "id", "chars", *KEY, F.sha2("bare", 256).alias("sha"),
        F.octet_length("bare").alias("size"), F.hash("bare").alias("check"),
        F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row")), "runs")


def sorted_runs(runs: DataFrame) -> DataFrame:
    """Each run reduced to one row per digest and sorted by digest, written once."""
    best = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), "id", "row", *KEY)
    reduced = runs.groupBy("run", *_SAME).agg(F.min(best).alias("best"), F.count("*").alias("n"))
    return settle(reduced.sortWithinPartitions("run", *_SAME), "reduced")


def merge_runs(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The best row and the number of rows of each digest, merged over all runs."""
    last = runs.agg(F.max("run")).first()[0] or 0
    merged = sorted_runs(runs)
    while last:
        # the exchange and the sort by digest that the aggregate runs on are the merge of neighbouring runs
        merged = (merged.withColumn("run", F.expr(f"run div {fan_in}")).groupBy("run", *_SAME)
                  .agg(F.min("best").alias("best"), F.sum("n").alias("n")))
        last //= fan_in
    return merged


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    runs = digest_runs(docs, id_column, text)
    best = merge_runs(runs, fan_in).select(*_SAME, "best", "n")
    return runs.join(best, _SAME).select(
        F.col("id").alias(id_column), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``docs``, all columns, without those that a kept row equals."""
    best = merge_runs(digest_runs(docs, id_column, text), fan_in)
    return only_rows(docs, best.select("best.*"), id_column, text)
