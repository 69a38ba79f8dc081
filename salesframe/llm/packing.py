"""Packing of tokenised documents into fixed-length training sequences.

Shortest-pack-first over the length histogram: lengths are placed longest first, each into
the packs with most room left, and packs of the same content are one *pattern* with a
count. The plan so depends on the histogram alone (at most ``capacity`` numbers), however
many documents there are. Patterns are then joined back to the pieces by their rank among
the pieces of equal length. A plan has at most two patterns per length and 63 different
lengths per pattern at a capacity of 2048, which bounds the broadcast side of that join.

A document is its token ids followed by an end id. Documents longer than a sequence are cut
every ``capacity`` ids; the rest of a document is one piece.

Defined cases: a null or empty text is the end id alone; repeated rows are packed one by
one; pieces that agree in id, start and ids are interchangeable; ids of any type, null too,
are carried along; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import running_total

CAPACITY = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"

#: Ids kept in memory before a task hands rows on.
_FLUSH = 1 << 20


# --- tokens ------------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


@functools.cache
def encoder(path: str | None = None):
    """A function from a text to its ids for a byte-level vocabulary file.

    Ids are those of the file's own library. Ordinary texts go through a faster
    implementation over the same vocabulary; texts that spell out a special token don't.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in own.get_vocab(False).items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return own.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)
    return encode


def token_pieces(docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """The pieces of every document: id, ``start``, ``length``, ``ids``, ``doc_tokens``.

    ``ids`` holds little-endian unsigned 32-bit numbers.
    """
    kind = docs.schema[id_column].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            keys, rows, held = batch.column("id"), [], 0
            for at, body in enumerate(batch.column("body")):  # one text at a time leaves the batch
                ids = array("I", encode(body.as_py()))
                ids.append(end_id)
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    rows.append((at, start, len(piece), piece.tobytes(), len(ids)))
                held += len(ids)
                if held >= _FLUSH or at == batch.num_rows - 1:
                    at_row, starts, lengths, raw, sizes = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(at_row)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                         pa.array(raw, pa.binary()), pa.array(sizes, pa.int64())], names=names)
                    rows, held = [], 0

    names = [id_column, "start", "length", "ids", "doc_tokens"]
    schema = T.StructType([
        T.StructField(n, k) for n, k in zip(names, (kind, T.LongType(), T.LongType(), T.BinaryType(), T.LongType()))])
    return docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body")).mapInArrow(
        cut, schema)


# --- plan --------------------------------------------------------------------

def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns as (count, lengths): shortest pack first, lengths longest first."""
    if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    room: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for free in sorted((r for r in room if r >= length), reverse=True):
            while left and room[free]:
                count, pattern = room[free].pop()
                used = min(count, left)
                if count > used:
                    room[free].append((count - used, pattern))
                room.setdefault(free - length, []).append((used, pattern + [length]))
                left -= used
        if left:
            room.setdefault(capacity - length, []).append((left, [length]))
    return [x for free in sorted(room) for x in room[free]]


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Where ranks of a length go: (length, first rank, rank after, count, sequence, offset, used).

    Ranks from the first on fill one place of all ``count`` sequences of a pattern, then the
    next place of the same length.
    """
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            times = pattern.count(length)
            first = taken.get(length, 0)
            taken[length] = first + count * times
            rows.append((length, first, first + count * times, count, sequence, offset, sum(pattern)))
            offset += length * times
        sequence += count
    return rows


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id``, ``offset`` and ``sequence_tokens``.

    ``order`` names the columns that tell pieces apart. ``pieces`` is read several times:
    pass a settled table. Sequences are to be padded to ``capacity``.
    """
    spark = pieces.sparkSession
    histogram = {n: c for n, c in pieces.groupBy(length).count().collect()}  # at most capacity rows
    schema = "_length long, _first long, _after long, _count long, _sequence long, _at long, _used long"
    places = F.broadcast(spark.createDataFrame(slots(plan(histogram, capacity)), schema))
    ranked = running_total(pieces, [length], order, {"_rank": F.lit(1)})
    number = F.col("_rank") - F.col("_first")
    return ranked.join(places, (F.col(length) == F.col("_length")) & (F.col("_rank") >= F.col("_first"))
                       & (F.col("_rank") < F.col("_after"))).select(
        *pieces.columns, (F.col("_sequence") + F.pmod(number, F.col("_count"))).alias("sequence_id"),
        (F.col("_at") + F.col(length) * F.floor(number / F.col("_count"))).alias("offset"),
        F.col("_used").alias("sequence_tokens"))


def pack_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Packed pieces of ``docs`` with their ids."""
    pieces = settle(token_pieces(docs, id_column, text, capacity, end_id, path), "pieces")
    return pack(pieces, [id_column, "start", "ids"], capacity)
