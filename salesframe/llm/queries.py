"""The registered queries of the training-data operators and their SQL twins.

Each query applies its operator with production parameters to its whole table and
derives the agreed columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from . import (
    divergence, embed_dedup, exact_dedup, langid, license_scan, line_dedup, mixing, packing, quality, secret_scan, simhash,
    url_filter, whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op10_exact_dedup", r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY sha) AS group_size
  FROM bare WINDOW w AS (PARTITION BY sha ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha AS text_sha256 FROM ranked""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


@_query("op1_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.token_pieces(_table(spark, folder, "documents"))
    digests = settle(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"),
                     "digests")
    packed = packing.pack(digests, ["doc_id", "start", "ids_crc32"])
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@_query("op2_license_scan", license_scan.oracle())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, folder, "documents"))


@_query("op3_mixing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"))


@_query("op4_langid")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = F.expr("coalesce(crc32(cast(doc_id AS string)) % 4 = 2, false)")
    model = langid.fit(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.predict(model).alias("found")).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


@_query("op5_simhash")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, folder, "documents"))
    return groups.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def learning_labels(labels: DataFrame) -> DataFrame:
    """Labels that a classifier may learn from: those outside the held-out fifth."""
    return labels.where(F.expr("crc32(cast(doc_id AS string)) % 5 <> 0"))


@_query("op6_line_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, folder, "documents")).select("doc_id", "text", "lines", "removed_lines")


@_query("op7_secret_scan")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.secret_scan(_table(spark, folder, "documents"))
    return found.select("doc_id", "word", "nth", F.sha2("candidate", 256).alias("candidate_sha256"),
                        F.length("candidate").alias("length"), "score", "secret")


@_query("op8_embed_dedup", """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e FROM embeddings),
l AS (SELECT a.n AS a, b.n AS b FROM v a JOIN v b ON a.n <> b.n AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT n, n AS m FROM v UNION SELECT l.b, r.m FROM r JOIN l ON r.n = l.a),
c AS (SELECT r.n, min(v.vec_id) AS component_id FROM r JOIN v ON v.n = r.m GROUP BY r.n),
k AS (SELECT a AS n, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c USING (n) LEFT JOIN k USING (n)""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return embed_dedup.embedding_groups(_table(spark, folder, "embeddings"))


@_query("op9_quality")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.document_statistics(_table(spark, folder, "documents"))
    model = quality.fit(rows, learning_labels(_table(spark, folder, "labels")))
    return rows.select(
        F.col("id").alias("doc_id"), F.expr("coalesce(crc32(cast(id AS string)) % 5 = 0, false)").alias("held_out"),
        quality.score_statistics(model).alias("score")).withColumn(
        "predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


#: The rules that pages are judged by.
PAGE_RULES = [
    url_filter.rule("com/", "allow"), url_filter.rule("example.com/en/", "block"), url_filter.rule("www.example.com/en/", "allow"),
    url_filter.rule("net/es/", "block"), url_filter.rule("net/fr/", "block"),
]


@_query("op11_url_filter", url_filter.oracle(PAGE_RULES))
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, folder, "pages"), PAGE_RULES)


@_query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_table(spark, folder, "embeddings"))


@_query("op13_divergence", divergence.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))
