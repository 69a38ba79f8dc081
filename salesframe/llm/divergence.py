"""Source divergence audit over hash-consed segment trees of term counts.

Each language keeps the terms that occur in at least 30 of its documents, numbered by falling document frequency.
The counts of a group (language, source) over these numbers are the leaves of a segment tree. Trees are hash-consed:
subtrees with identical counts are one node, within a tree and between groups; rare terms stand side by side, so
whole stretches without any count are one node per level. The distance of two groups is priced by walking
both trees at once from their roots: equal pairs of nodes are met once and carry how often they occur, and only
the distinct pairs of counts at the leaves are priced.

A tree is cut into blocks of ``BLOCK`` numbers, and the groups of a language into tiles of about ``TILE``; a task has two
tiles over one block, so what it holds is bounded whatever the number of terms and sources. Distances of all
pairs of sources are the result asked for; nothing else is paired. Words are counted per task before they are shuffled.

Terms are runs of letters A-Z, a-z and all characters beyond ASCII, only A-Z lower-cased. Shares are whole numbers,
``p = 1 + floor(10**9 (count + 5) / (N + 5 V))``; all sums are exact.

Defined cases: null text, language or source count as empty texts; a group without terms is a group; a language
with no kept term has distances of 0; repeated rows and null ids are documents like any other; very long texts
are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import with_position
from ..session import settle

DOCUMENTS = 30
TOP = 50
UNIT = 1_000_000_000
PRIOR = 5
#: Term numbers in a block (a power of two), and groups in a tile.
BLOCK = 1 << 13
TILE = 32
_FLUSH = 1 << 19
#: Terms as UTF-8: letters of ASCII and every byte of the characters beyond it.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per group and term, summed up as far as a task sees them; each group once without term."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        while groups:
            (lang, source), (seen, docs) = groups.popitem()
            term = pa.concat_arrays([pa.nulls(1, pa.binary()), pa.array(seen, pa.binary())]).view(pa.string())
            yield pa.record_batch({
                "lang": pa.repeat(pa.scalar(lang), len(term)), "source": pa.repeat(pa.scalar(source), len(term)), "term": term,
                "n": pa.array(np.fromiter(chain([0], seen.values()), np.int64, len(term))),
                "docs": pa.array(np.fromiter(chain([0], map(docs.__getitem__, seen)), np.int64, len(term)))})

    held = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            seen, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            terms = _TERM.findall(text.as_py().lower())
            held -= len(seen)
            seen.update(terms)
            docs.update(set(terms))
            held += len(seen)
            if held > _FLUSH:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, occurrences ``n`` and documents ``docs``; one row with a null term per group."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for n, c in (("lang", lang), ("source", source), ("text", text))])
    return rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long").groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """The share of a term in whole billionths, smoothed, from 1."""
    upper = F.lit(UNIT).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", upper, (total + terms * PRIOR).cast("decimal(20,0)"))


class Trees:
    """Hash-consed segment trees of the rows of a count matrix whose width is a power of two.

    ``roots`` names each row's root; ``children[k]`` has the two children of each node k + 1 levels above the leaves,
    ``leaves`` the counts.
    """

    def __init__(self, counts: np.ndarray):
        self.leaves, ids = np.unique(counts, return_inverse=True)
        ids = ids.reshape(counts.shape)
        self.children: list[tuple[np.ndarray, np.ndarray]] = []
        while ids.shape[1] > 1:
            pairs = (ids[:, 0::2] << 32) | ids[:, 1::2]
            nodes, at = np.unique(pairs, return_inverse=True)
            self.children.append((nodes >> 32, nodes & 0xFFFFFFFF))
            ids = at.reshape(pairs.shape)
        self.roots = ids[:, 0]

    def leaf_pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of leaves below two roots met in one walk, and how often each occurs."""
        u, v, times = np.array([a]), np.array([b]), np.array([1])
        for left, right in reversed(self.children):
            pairs = np.concatenate([(left[u] << 32) | left[v], (right[u] << 32) | right[v]])
            found, at = np.unique(pairs, return_inverse=True)
            times = np.bincount(at, np.concatenate([times, times]), len(found)).astype(np.int64)
            u, v = found >> 32, found & 0xFFFFFFFF
        return u, v, times


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    if len(counts) and UNIT * (int(counts.max()) + PRIOR) >= 1 << 63:
        return np.array([1 + UNIT * (int(c) + PRIOR) // total for c in counts], np.int64)
    return 1 + UNIT * (counts + PRIOR) // total


def distances(counts: np.ndarray, totals: list[int], pairs: list[tuple[int, int]]) -> list[int]:
    """Exact sums of differences of shares for pairs of rows of a count matrix; ``totals`` are the shares' denominators."""
    width = counts.shape[1]
    if not width:
        return [0] * len(pairs)
    # filled up to a power of two with leaves that only meet each other and cost nothing
    trees = Trees(np.pad(counts, ((0, 0), (0, (1 << (width - 1).bit_length()) - width)), constant_values=-1))
    prices = {t: np.where(trees.leaves >= 0, _shares(trees.leaves, t), 0) for t in set(totals)}
    out = []
    for i, j in pairs:
        if trees.roots[i] == trees.roots[j] and totals[i] == totals[j]:
            out.append(0)
            continue
        u, v, times = trees.leaf_pairs(trees.roots[i], trees.roots[j])
        out.append(int((times * np.abs(prices[totals[i]][u] - prices[totals[j]][v])).sum()))
    return out


def _price(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    lang, low, high, _ = key
    rows = rows.sort_values(["tile", "source"], ignore_index=True)
    counts = np.zeros((len(rows), int(rows["width"].iloc[0])), np.int64)
    for i, (at, n) in enumerate(zip(rows["at"], rows["n"])):
        if at is not None:
            counts[i, at] = n
    tile, names = rows["tile"].to_numpy(), rows["source"].tolist()
    # two tiles: pairs across them; a tile with itself: its own pairs
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if low == high or tile[i] != tile[j]]
    found = distances(counts, rows["total"].tolist(), pairs)
    return pd.DataFrame({"lang": lang, "a": pd.Series([names[i] for i, _ in pairs], dtype=object),
                         "b": pd.Series([names[j] for _, j in pairs], dtype=object), "value": pd.Series(found, dtype="int64")})


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          least_documents: int = DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part ``pair``: the distance to each other source of the language. Part ``term``: the ``top`` terms whose
    share is furthest above the language's.
    """
    counts = settle(term_counts(docs, text, lang, source), "counts")
    kept = (counts.where("term IS NOT NULL").groupBy("lang", "term")
            .agg(F.sum("n").alias("lang_n"), (-F.sum("docs")).alias("less")).where(F.col("less") <= -least_documents))
    terms = settle(with_position(kept, ["less", "term"], ["lang"], "number"), "terms")
    own = settle(counts.join(terms, ["lang", "term"]).select(
        "lang", "source", "term", "n", "lang_n", (F.col("number") - 1).alias("number")), "kept")
    langs = terms.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = own.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("own_total"))
    groups = counts.where("term IS NULL").select("lang", "source")
    sizes = groups.groupBy(F.col("lang").alias("l2")).agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    groups = settle(
        groups.join(totals, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").drop("l", "s")
        .join(langs, F.col("lang") == F.col("l"), "left").join(sizes, F.col("lang") == F.col("l2")).select(
            "lang", "source", "tiles", F.pmod(F.xxhash64("source"), "tiles").alias("tile"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("own_total", "terms", "lang_total")]), "groups")
    return _pairs(own, groups).unionByName(_terms(own, groups, top))


def _terms(own: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    rows = own.join(groups.drop("tile", "tiles"), ["lang", "source"])
    p = share(F.col("n"), F.col("own_total"), F.col("terms"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return (rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value"))
            .where("value > 0").withColumn("rank", place).where(F.col("rank") <= top))


def _pairs(own: DataFrame, groups: DataFrame) -> DataFrame:
    block = F.floor(F.col("number") / BLOCK)
    leaves = own.groupBy("lang", "source", block.alias("block")).agg(
        F.collect_list(F.struct((F.col("number") % BLOCK).cast("int").alias("at"), "n")).alias("leaf"))
    # every group has every block of its language, also those without a count of its own, and one without terms
    last = F.greatest(F.ceil(F.col("terms") / BLOCK) - 1, F.lit(0))
    spread = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = spread.join(leaves, ["lang", "source", "block"], "left").select(
        "lang", "source", "block", "tile", "tiles", (F.col("own_total") + F.col("terms") * PRIOR).alias("total"),
        F.least(F.lit(BLOCK), F.col("terms") - F.col("block") * BLOCK).cast("int").alias("width"),
        F.col("leaf.at").alias("at"), F.col("leaf.n").alias("n"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumns(
        {"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other", "tiles")
    found = dealt.groupBy("lang", "low", "high", "block").applyInPandas(_price, "lang string, a string, b string, value long")
    found = settle(found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "distances")
    both = found.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        found.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT doc, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (l.lang_total + 5 * l.v) AS q
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) JOIN langs l USING (lang)
    LEFT JOIN totals t USING (lang, source) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, 0 FROM (SELECT DISTINCT lang, source FROM d) a
    JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source ANTI JOIN langs l ON l.lang = a.lang
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM every WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50"""
