"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. It is seen as two halves of 32 bits; if two fingerprints differ
in at most ``2 * t + 1`` bits, some half differs in at most ``t``. With t = 1 (three bits) the
anchors of a half are the words of a covering code: the perfect (31, 26) Hamming code with
one free bit, covering radius 1. Each half is replicated to every anchor within covering
radius plus threshold, 1 + 1 = 2: the nearest anchor of one half is then at most 2 away from
the other, so no pair is lost. That makes 17 anchors (2 for a half that is an anchor), out
of 2**27. Fingerprints are compared per anchor, all 64 bits.

Equal fingerprints are one row before they are replicated, so groups of exact copies cost
nothing. Per anchor only a spanning forest of the links leaves the task, not all pairs;
forests are joined by ``components``.

Defined cases: a null or empty text has no words and the fingerprint zero, linked like any
other; fewer words than a shingle make one shingle; repeated rows share a fingerprint and
so a component; a null id takes part, but is never the smallest id of a component that has
any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import KEY, components, only_rows, row_key

SHINGLE = 3
SEED = 42
#: Largest number of differing bits of a link; the code below is made for it.
BITS = 3

_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text as a signed 64-bit number.

    A-Z are lower-cased, words are what ASCII white space parts, shingles are words joined by
    a space, repeats included. A bit is set if it is in more than half of the shingles' hashes.
    """
    words = text.encode().lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0] + [e + 1 for e in ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:at + _CHUNK], last[at:at + _CHUNK])],
                          np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Id, row key and fingerprint of every row, written once."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return settle(docs.select(F.col(id_column).alias("id"), *row_key(id_column, text), of(F.col(text)).alias("fp")),
                  "fingerprints")


# --- the covering code of a half --------------------------------------------

#: A word's syndrome is the exclusive or of the numbers 1 to 31 of its set bits; bit 0 is free.
_SYNDROME = np.zeros((4, 256), np.uint32)
for _byte in range(4):
    for _value in range(256):
        for _bit in range(8):
            if _value >> _bit & 1:
                _SYNDROME[_byte, _value] ^= 8 * _byte + _bit


def _toward(syndrome: int) -> list[int]:
    """Flips of at most two bits that lead from a word of this syndrome to an anchor."""
    if not syndrome:
        return [0, 1]
    near = [1 << syndrome, 1 << syndrome | 1]
    return near + [1 << i | 1 << (i ^ syndrome) for i in range(1, 32) if i < i ^ syndrome]


_FLIPS = [np.array(_toward(s), np.uint32) for s in range(32)]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 32-bit words: positions in ``half`` and the anchors within distance two of each."""
    syndrome = np.zeros(len(half), np.uint32)
    for byte in range(4):
        syndrome ^= _SYNDROME[byte, half >> np.uint32(8 * byte) & np.uint32(255)]
    rows, found = [], []
    for s in np.unique(syndrome):
        at = np.flatnonzero(syndrome == s)
        rows.append(np.repeat(at, len(_FLIPS[s])))
        found.append((half[at][:, None] ^ _FLIPS[s][None, :]).ravel())
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), half)


def _replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words = batch["fp"].to_numpy(np.int64).view(np.uint64)
        for side in (0, 1):
            half = (words >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows, found = anchors(half)
            yield pd.DataFrame({"anchor": found.astype(np.int64) * 2 + side, "fp": words[rows].view(np.int64)})


# --- comparison per anchor ---------------------------------------------------

def forest(words: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints.

    Visits linked fingerprints breadth first and never looks at a visited one again, so a
    dense group costs about one pass.
    """
    child, parent = [], []
    rest = words
    while len(rest) > 1:
        seed, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, (1 << 22) // len(rest))
            head, front = front[:step], front[step:]
            hit = (np.bitwise_count(head[:, None] ^ rest[None, :]) <= bits).any(axis=0)
            if hit.any():
                new, rest = rest[hit], rest[~hit]
                child.append(new)
                parent.append(np.full(len(new), seed))
                front = np.concatenate([front, new])
    empty = np.zeros(0, words.dtype)
    return (np.concatenate(child), np.concatenate(parent)) if child else (empty, empty)


_SMALL = 8


def _links(anchor: np.ndarray, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of each anchor; both arrays sorted by anchor."""
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[first, len(anchor)])
    small = np.repeat(size < _SMALL, size)
    a, b = [], []
    for shift in range(1, min(_SMALL, len(words))):
        near = (anchor[shift:] == anchor[:-shift]) & small[shift:]
        if not near.any():
            break
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(words[at + shift] ^ words[at]) <= bits]
        a.append(words[at + shift])
        b.append(words[at])
    for i in np.flatnonzero(size >= _SMALL):
        child, parent = forest(words[first[i]:first[i] + size[i]], bits)
        a.append(child)
        b.append(parent)
    empty = np.zeros(0, words.dtype)
    return np.concatenate([*a, empty]), np.concatenate([*b, empty])


def _compare(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by anchor; the last anchor of a batch may go on in the next
        anchor, words = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(done_anchor, done_words):
            a, b = _links(done_anchor, done_words, bits)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

        for batch in batches:
            anchor = batch["anchor"].to_numpy(np.int64)
            words = batch["fp"].to_numpy(np.int64).view(np.uint64)
            if not len(anchor):
                continue
            pending.append((anchor, words))
            if anchor[0] == anchor[-1] and pending[0][0][-1] == anchor[-1]:
                continue
            anchor, words = (np.concatenate(x) for x in zip(*pending))
            cut = np.searchsorted(anchor, anchor[-1])
            pending = [(anchor[cut:], words[cut:])]
            if cut:
                yield flush(anchor[:cut], words[:cut])
        if pending:
            yield flush(*(np.concatenate(x) for x in zip(*pending)))
    return run


def near_links(words: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints ``fp`` at most ``bits`` bits apart, directly or by steps."""
    if bits > 3:
        raise ValueError("the covering code of a half is made for at most three differing bits")
    replicas = words.select("fp").mapInPandas(_replicate, "anchor long, fp long")
    return (replicas.repartition("anchor").sortWithinPartitions("anchor")
            .mapInPandas(_compare(bits), "a long, b long"))


def simhash_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                   bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: id, ``fp``, ``component_id`` and the row that stays."""
    rows = fingerprints(docs, id_column, text, shingle)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", *KEY))
    words = settle(rows.groupBy("fp").agg(first.alias("first")), "words")
    found = components(near_links(words, bits))
    rooted = words.join(found, words["fp"] == found["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    least = rooted.groupBy("root").agg(F.min("first").alias("stay"))
    named = settle(rooted.select("fp", "root").join(least, "root").select("fp", "stay"), "named")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_column), "fp", F.col("stay.id").alias("component_id"), "stay")


def hex_digits(word: str = "fp"):
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(word), 16, "0"))


def simhash_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                  bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, all columns, with only the row of smallest id of each component."""
    groups = simhash_groups(docs, id_column, text, shingle, bits)
    return only_rows(docs, groups.select("stay.*"), id_column, text)
