"""Line-level duplicates by pairwise alignment.

A passage is the shortest run of consecutive lines, from a line on or up to a line, that has
``block_words`` words; every block that can be deleted is made of passages. Each passage names an
owner: the earliest document that has it (smallest id, null ids last). Every other document with it
is paired with that owner, so a passage shared by n documents makes n - 1 pairs however common it
is; rare and common ones go the same way and none is left out. So a block shared with any earlier
document is looked for, whatever the owners of its single lines. For each pair all lines it shares are aligned by patience
diff: lines unique on both sides, in the longest order common to both, are anchors; the gaps
between anchors are aligned again, from their ends inward and by lines unique within the gap.
Aligned lines that follow each other on both sides are a block, and blocks of at least
``block_words`` words are deleted from the later document.

Defined cases: lines are compared without the white space around them, and empty lines are never
shared, counted or deleted; a null text stays null and has no lines; repeated rows (same id and
text) are one document and are treated alike; of documents with equal ids the row key decides which
is earlier; an empty table gives no rows; other columns are carried along, but for those named ``lines``
and ``removed_lines``, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import KEY, once, row_key, whole_row

#: Words from which on an aligned block is deleted.
BLOCK_WORDS = 5

_ASCII_SPACE = " \t\n\v\f\r"


def text_lines(text: str | None) -> list[str]:
    """The non-empty lines of a text, without the white space around them."""
    return [x for x in (line.strip(_ASCII_SPACE) for line in text.split("\n")) if x] if isinstance(text, str) else []


# --- alignment of one pair ---------------------------------------------------

def _longest_rise(values: list[int]) -> list[int]:
    """Positions of a longest strictly rising subsequence."""
    tails, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    found, i = [], at[-1] if at else -1
    while i >= 0:
        found.append(i)
        i = back[i]
    return found[::-1]


def patience(later: dict[int, int], earlier: dict[int, int]) -> list[tuple[int, int]]:
    """Aligned positions of two documents given as {position: line number}, shared lines only."""
    matched: list[tuple[int, int]] = []
    stack = [(0, max(later, default=-1) + 1, 0, max(earlier, default=-1) + 1)]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and a in later and later[a] == earlier.get(c):
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and b - 1 in later and later[b - 1] == earlier.get(d - 1):
            b, d = b - 1, d - 1
            matched.append((b, d))
        left, right = _unique(later, a, b), _unique(earlier, c, d)
        both = sorted((p, right[line]) for line, p in left.items() if line in right)
        anchors = [both[i] for i in _longest_rise([o for _, o in both])]
        matched += anchors
        for (p, o), (q, r) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]) if anchors else ():
            if q - p > 1 and r - o > 1:
                stack.append((p + 1, q, o + 1, r))
    return sorted(matched)


def _unique(lines: dict[int, int], low: int, high: int) -> dict[int, int]:
    """Position of each line that occurs once from low to high - 1."""
    found: dict[int, int] = {}
    for p in (range(low, high) if high - low < len(lines) else (p for p in lines if low <= p < high)):
        line = lines.get(p)
        if line is not None:
            found[line] = -1 if line in found else p
    return {line: p for line, p in found.items() if p >= 0}


def common_blocks(shared: list[tuple[list[int], list[int], int]], block_words: int) -> list[int]:
    """Positions to delete, from (positions in the later, in the earlier document, words) per shared line."""
    if len(shared) == 1 and len(shared[0][0]) == 1 and len(shared[0][1]) == 1:
        return list(shared[0][0]) if shared[0][2] >= block_words else []
    later = {p: i for i, (ps, _, _) in enumerate(shared) for p in ps}
    earlier = {p: i for i, (_, ps, _) in enumerate(shared) for p in ps}
    found, block, words = [], [], 0
    last = (-2, -2)
    for p, o in [*patience(later, earlier), (-9, -9)]:
        if (p, o) != (last[0] + 1, last[1] + 1):
            if words >= block_words:
                found += block
            block, words = [], 0
        if p >= 0:
            block.append(p)
            words += shared[later[p]][2]
        last = (p, o)
    return found


# --- the whole table ---------------------------------------------------------

def passages(digests: list[bytes], words: list[int], block_words: int) -> set[bytes]:
    """Digests of the shortest runs of ``block_words`` words from each line on and up to each line."""
    runs, start, total = set(), 0, 0
    for end, n in enumerate(words):  # up to each line
        total += n
        while total - words[start] >= block_words and start < end:
            total -= words[start]
            start += 1
        if total >= block_words:
            runs.add((start, end + 1))
    end = total = 0
    for start, n in enumerate(words):  # from each line on
        while total < block_words and end < len(words):
            total += words[end]
            end += 1
        if total >= block_words and end > start:
            runs.add((start, end))
        total -= n
    return {md5(b"".join(digests[i:j])).digest() for i, j in runs}


def _occurrences(block_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, a, b, body in zip(batch["id"], *(batch[k] for k in KEY), batch["body"]):
                lines = text_lines(body)
                digests, words = [md5(x.encode()).digest() for x in lines], [len(x.split()) for x in lines]
                out.append((key, a, b, [int.from_bytes(x[:8], "little", signed=True) for x in digests], words,
                            list(passages(digests, words, block_words))))
            yield pd.DataFrame(out, columns=["id", *KEY, "lines", "words", "passages"])
    return run


def pair_blocks(later: list[int], words: list[int], earlier: list[int], block_words: int) -> list[int]:
    """Positions to delete from a document, given the digests of all lines of it and of an earlier one."""
    at: dict[int, tuple[list[int], list[int], int]] = {}
    for i, line in enumerate(later):
        at.setdefault(line, ([], [], words[i]))[0].append(i)
    for i, line in enumerate(earlier):
        if line in at:
            at[line][1].append(i)
    return common_blocks([x for x in at.values() if x[1]], block_words)


def duplicate_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """Row key and ``removed``, the places among its non-empty lines, of each document that loses lines."""
    kind = docs.schema[id_column].dataType
    schema = T.StructType([
        T.StructField("id", kind), *[T.StructField(k, T.LongType()) for k in KEY],
        T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType())),
        T.StructField("passages", T.ArrayType(T.BinaryType()))])
    rows = settle(docs.select(F.col(id_column).alias("id"), *row_key(id_column, text), F.col(text).alias("body"))
                  .mapInPandas(_occurrences(block_words), schema), "lines")
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", *KEY)
    found = rows.select("id", *KEY, F.explode("passages").alias("passage"))
    owners = settle(
        found.groupBy("passage").agg(F.min(own).alias("doc"), F.count("*").alias("n"))
        .where("n > 1").select("passage", *[F.col(f"doc.{k}").alias(f"own{k}") for k in KEY]), "owners")
    pairs = settle(found.select(*KEY, "passage").join(owners, "passage").where(" OR ".join(f"{k} <> own{k}" for k in KEY))
                   .select(*KEY, *[f"own{k}" for k in KEY]).distinct(), "pairs")
    bodies = settle(once(rows.select(*KEY, "lines", "words")), "bodies")  # nothing between shuffle and join, so hot owners can be split
    both = (pairs.join(bodies, KEY)
            .join(bodies.select(*[F.col(k).alias(f"own{k}") for k in KEY], F.col("lines").alias("own_lines")),
                  [f"own{k}" for k in KEY]))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def delete(lines: pd.Series, words: pd.Series, own_lines: pd.Series) -> pd.Series:
        return pd.Series([pair_blocks(x.tolist(), w.tolist(), y.tolist(), block_words)
                          for x, w, y in zip(lines, words, own_lines)], dtype=object)

    gone = both.select(*KEY, delete("lines", "words", "own_lines").alias("gone")).where("size(gone) > 0")
    return gone.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("removed"))


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs``, all columns, without the lines that an earlier document has; ``lines`` and ``removed_lines`` added."""
    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.LongType())]))
    def without(texts: pd.Series, removed: pd.Series) -> pd.DataFrame:
        out = []
        for body, gone in zip(texts, removed):
            if not isinstance(body, str):
                out.append((None, 0))
                continue
            gone, kept, place = set(() if gone is None else gone), [], 0
            for line in body.split("\n"):
                if line.strip(_ASCII_SPACE):
                    if place not in gone:
                        kept.append(line)
                    place += 1
                else:
                    kept.append(line)
            out.append(("\n".join(kept), place))
        return pd.DataFrame(out, columns=["text", "lines"])

    gone = settle(duplicate_lines(docs, id_column, text, block_words), "removed")
    keyed = docs.select(whole_row(docs), *row_key(id_column, text))
    found = keyed.join(gone, KEY, "left").select(
        "_row", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("_gone"),
        without(F.col(f"_row.`{text}`"), F.col("removed")).alias("_new"))
    kept = [c for c in docs.columns if c not in ("lines", "removed_lines")]
    return found.select(*[F.col("_new.text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in kept],
                        F.col("_new.lines").alias("lines"), F.col("_gone").alias("removed_lines"))
