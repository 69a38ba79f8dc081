"""Embedding whitening with an exact bit-sliced scatter matrix.

Entries become whole numbers, ``x = floor(256 c)``. Each distinct vector counts once (the fit list). A batch of
them is shifted to be non-negative and cut into bit planes: plane b of dimension i packs bit b of all rows into
64-bit words. A cross-product of two dimensions is then a weighted sum of popcounts of ANDed planes,
``sum over a, b of 2**(a+b) * popcount(plane(i, a) & plane(j, b))``, exact whatever the number of rows; the shift is
taken out again in whole numbers. Sums leave a task as four 32-bit limbs and are added up by Spark, so nothing
is rounded before ``n P - S S'``, the centred scatter, has been formed. Only then comes ``eigh``, in one task
per vector length over one matrix of that length's dimensions.

Vectors are shuffled once, as compact codes (one byte an entry where it fits), and copies meet before
that. What a task holds is one batch of rows and one matrix; the driver receives four directions per length.

Defined cases: rows whose vector is null or holds null or non-finite entries go; an empty vector has no component
and so no row; vectors of each length are whitened by themselves; fewer dimensions than components give as many
components; a component without variance (equal vectors, dependent dimensions) has a null ``whitened`` and counts as 0
explained if nothing varies; ``deviation`` is null where it exceeds 64 bits; entries beyond 64 bits count as the
largest or least such number; repeated rows and null ids each have their rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

SCALE = 256
COMPONENTS = 4
#: Rows whose planes are held at once; a multiple of 64.
BATCH = 1 << 14
_MASK = (1 << 32) - 1
_KINDS = ("<i1", "<i2", "<i4", "<i8")
_SUMS = "dims int, i int, j int, l0 long, l1 long, l2 long, l3 long"


class Model(NamedTuple):
    """What whitening needs of a fit: ``directions`` has one row per component."""
    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: list[float]


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """``floor(256 c)`` as 64-bit integers; what lies beyond them is the largest or least."""
    with np.errstate(over="ignore"):
        x = np.floor(vectors.astype(np.float64) * SCALE)
    top = x >= 2.0 ** 63
    out = np.where(top, 0, np.maximum(x, -2.0 ** 63)).astype(np.int64)
    out[top] = 2 ** 63 - 1
    return out


def encode(x: np.ndarray) -> list[bytes]:
    """One code per row, the same for equal rows only: the narrowest width that holds the row, then its entries."""
    low, high = x.min(axis=1), x.max(axis=1)
    width = np.zeros(len(x), int)
    for at, kind in enumerate(_KINDS[:3], 1):
        info = np.iinfo(kind)
        width[(low < info.min) | (high > info.max)] = at
    out = np.empty(len(x), object)
    for at in np.unique(width):
        rows = np.nonzero(width == at)[0]
        raw, step = x[rows].astype(_KINDS[at]).tobytes(), x.shape[1] << at
        out[rows] = [bytes([at]) + raw[k * step:(k + 1) * step] for k in range(len(rows))]
    return out.tolist()


def decode(codes: list[bytes]) -> Iterator[np.ndarray]:
    """The rows of codes, one matrix per length of vectors."""
    found: dict[tuple[int, int], list[bytes]] = {}
    for code in codes:
        found.setdefault((code[0], len(code)), []).append(code[1:])
    by_length: dict[int, list[np.ndarray]] = {}
    for (at, size), raw in found.items():
        length = (size - 1) >> at
        by_length.setdefault(length, []).append(
            np.frombuffer(b"".join(raw), _KINDS[at]).astype(np.int64).reshape(-1, length))
    for parts in by_length.values():
        yield np.concatenate(parts)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all bit planes of unsigned rows ``y``, with the dimension and the bit of each plane, by dimension."""
    bits = [int(top).bit_length() for top in y.max(axis=0)]
    words, dims, place = [], [], []
    for b in range(max(bits)):
        has = [i for i, n in enumerate(bits) if n > b]
        packed = np.packbits(((y[:, has] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        words.append(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64))
        dims += has
        place += [b] * len(has)
    if not words:
        return np.zeros((0, 1), np.uint64), np.zeros(0, int), np.zeros(0, int)
    order = np.lexsort((place, dims))
    return np.concatenate(words)[order], np.array(dims)[order], np.array(place)[order]


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products (upper triangle) of whole-number rows, by popcounts of ANDed bit planes."""
    rows, length = x.shape
    least = x.min(axis=0)
    words, dims, place = bit_planes(x.view(np.uint64) - least.view(np.uint64))
    size = max(abs(int(x.min())), abs(int(x.max())), 1).bit_length() + 1
    kind = np.int64 if 2 * size + rows.bit_length() < 62 else object
    one = np.ones(len(place), kind)
    sums, cross = np.zeros(length, kind), np.zeros((length, length), kind)
    counts = np.bitwise_count(words).sum(axis=1, dtype=np.int64).astype(kind)
    np.add.at(sums, dims, counts * (one << place.astype(kind)))
    first = np.searchsorted(dims, dims)
    for p in range(len(words)):
        at = first[p]
        both = np.bitwise_count(words[at:] & words[p]).sum(axis=1, dtype=np.int64).astype(kind)
        np.add.at(cross[dims[p]], dims[at:], both * (one[at:] << (place[at:] + place[p]).astype(kind)))
    shift = least.astype(kind)
    cross = cross + np.outer(shift, sums) + np.outer(sums, shift) + rows * np.outer(shift, shift)
    return sums + rows * shift, cross


def _limbs(numbers: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as four limbs of 32 bits, the last one signed."""
    if numbers.dtype != object:
        sign = numbers >> 63
        return [numbers & _MASK, (numbers >> 32) & _MASK, sign & _MASK, sign]
    return [((numbers >> 32 * k) & _MASK).astype(np.int64) for k in range(3)] + [(numbers >> 96).astype(np.int64)]


def _partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per length: the number of rows (i = j = -1), sums (j = -1) and cross-products of a partition."""
    totals: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for x in decode(batch["code"].tolist()):
            length = x.shape[1]
            for at in range(0, len(x), BATCH):
                part = x[at:at + BATCH]
                sums, cross = scatter(part)
                table = np.zeros((length + 1, length + 1), sums.dtype)
                table[0, 0], table[1:, 0], table[1:, 1:] = len(part), sums, cross
                limbs = _limbs(table)
                own = totals.get(length)
                totals[length] = limbs if own is None else [a + b for a, b in zip(own, limbs)]
    for length, limbs in totals.items():
        for i in range(length + 1):
            js = np.r_[0, np.arange(max(i, 1), length + 1)] if i else np.zeros(1, int)
            yield pd.DataFrame({"dims": length, "i": i - 1, "j": js - 1} | {f"l{k}": limbs[k][i, js] for k in range(4)})


def _solve(components: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        length = int(rows["dims"].iloc[0])
        value = sum(rows[f"l{k}"].to_numpy().astype(object) * (1 << 32 * k) for k in range(4))
        table = np.zeros((length + 1, length + 1), object)
        table[rows["i"] + 1, rows["j"] + 1] = value
        n, sums, cross = table[0, 0], table[1:, 0], table[1:, 1:]
        cross = np.triu(cross) + np.triu(cross, 1).T
        centred = n * cross - np.outer(sums, sums)  # whole numbers: n**2 times the covariance
        values, vectors = np.linalg.eigh((centred / (n * n)).astype(np.float64))
        pick = np.argsort(-values, kind="stable")[:components]
        directions = vectors[:, pick].T
        directions *= np.sign(directions[np.arange(len(pick)), np.abs(directions).argmax(axis=1)])[:, None]
        trace = sum(centred.diagonal()) / (n * n)
        noise = max(values.max(), 0.0) * length * np.finfo(float).eps
        e = np.where(values[pick] > noise, values[pick], 0.0)
        return pd.DataFrame({
            "dims": [length], "n": [n], "sums": [[str(s) for s in sums]], "directions": [directions.ravel()],
            "eigenvalues": [e], "explained": [e / trace if trace else e]})
    return run


def fit(codes: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length of vectors from a settled table of distinct ``code``."""
    sums = codes.mapInPandas(_partial_sums, _SUMS).groupBy("dims", "i", "j").agg(
        *[F.sum(f"l{k}").alias(f"l{k}") for k in range(4)])
    solved = sums.groupBy("dims").applyInPandas(
        _solve(components), "dims int, n long, sums array<string>, directions array<double>, eigenvalues array<double>, "
                            "explained array<double>")
    return {r.dims: Model(r.n, [int(s) for s in r.sums], np.array(r.directions).reshape(-1, r.dims),
                          np.array(r.eigenvalues), r.explained) for r in solved.collect()}


def deviations(x: np.ndarray, model: Model) -> np.ndarray:
    """``n x - S``, exact."""
    top = max(abs(int(x.min())), abs(int(x.max())))
    small = model.n * top + max(map(abs, model.sums)) < 1 << 62
    kind = np.int64 if small else object
    return x.astype(kind) * model.n - np.array(model.sums, kind)


def whiten(x: np.ndarray, model: Model) -> tuple[list, np.ndarray]:
    """Per row the squared length of ``n x - S`` (None beyond 64 bits), and whitened components (NaN without variance)."""
    off = deviations(x, model)
    top = int(np.abs(off).max())
    if off.dtype == object or top * top * x.shape[1] >= 1 << 63:
        squares = [s if s < 1 << 63 else None for s in (off.astype(object) ** 2).sum(axis=1)]
    else:
        squares = (off * off).sum(axis=1).tolist()
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(model.eigenvalues > 0, 1 / np.sqrt(model.eigenvalues), np.nan)
        return squares, (off / model.n).astype(np.float64) @ model.directions.T * scaled


def _moments(models: dict[int, Model]):
    """Per length and pair of components, a partition's rows, means and centred products of whitened values."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in decode(batch["code"].tolist()):
                model = models[x.shape[1]]
                live = np.nonzero(model.eigenvalues > 0)[0]
                if not len(live):
                    continue
                w = whiten(x, model)[1][:, live]
                mean = w.mean(axis=0)
                own = (w - mean).T @ (w - mean)
                a, b = np.indices(own.shape)
                yield pd.DataFrame({"dims": x.shape[1], "same": (a == b).ravel(), "a": a.ravel(), "b": b.ravel(), "n": len(w),
                                    "ma": mean[a].ravel(), "mb": mean[b].ravel(), "c": own.ravel()})
    return run


def identity_errors(codes: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest difference between the covariance of whitened vectors and the identity, measured over the fit list."""
    parts = codes.mapInPandas(_moments(models), "dims int, same boolean, a int, b int, n long, ma double, mb double, c double")
    n = F.sum("n")
    off = F.sum(F.col("n") * F.col("ma") * F.col("mb")) - F.sum(F.col("n") * F.col("ma")) * F.sum(F.col("n") * F.col("mb")) / n
    cov = parts.groupBy("dims", "same", "a", "b").agg(((F.sum("c") + off) / n).alias("cov"))
    return {r.dims: r.error for r in cov.groupBy("dims").agg(
        F.max(F.abs(F.col("cov") - F.col("same").cast("int"))).alias("error")).collect()}


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
             components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``vectors`` and component: id, ``component`` (from 1), ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``.
    """
    v = F.col(vector)
    if vectors.schema[vector].dataType.elementType.typeName() != "float":
        v = v.cast("array<double>")
    rows = vectors.select(F.col(id_column).alias("id"), v.alias("v")).where(
        (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))

    @F.pandas_udf("binary")
    def code(v: pd.Series) -> pd.Series:
        return pd.Series(_by_length(v, lambda x: encode(x)), dtype=object)

    codes = settle(rows.select(code("v").alias("code")).distinct(), "codes")
    models = fit(codes, components)
    errors = identity_errors(codes, models)

    @F.pandas_udf("deviation long, whitened array<double>")
    def score(v: pd.Series) -> pd.DataFrame:
        def one(x: np.ndarray) -> list:
            squares, w = whiten(x, models[x.shape[1]])
            return list(zip(squares, w))
        found = _by_length(v, one)
        return pd.DataFrame({"deviation": pd.array([f[0] for f in found], "Int64"), "whitened": [f[1] for f in found]})

    def per_length(value) -> Column:
        choice = F.lit(None)
        for length in sorted(models):
            choice = F.when(F.col("dims") == length, value(length)).otherwise(choice)
        return choice

    found = rows.select("id", F.size("v").alias("dims"), score("v").alias("s")).select(
        "id", "dims", "s.deviation", F.posexplode("s.whitened").alias("at", "w"))
    explained = per_length(lambda k: F.element_at(F.array(*[F.lit(float(e)) for e in models[k].explained]), F.col("at") + 1))
    return found.select(
        F.col("id").alias(id_column), (F.col("at") + 1).alias("component"),
        per_length(lambda k: F.lit(models[k].n)).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("w"), F.col("w")).alias("whitened"), explained.cast("double").alias("explained"),
        per_length(lambda k: F.lit(errors.get(k))).cast("double").alias("identity_error"))


def _by_length(v: pd.Series, make) -> list:
    """``make`` of the whole numbers of each length of vectors, put back in the order of rows."""
    lengths = np.array([len(x) for x in v], int)
    out = np.empty(len(v), object)
    for length in np.unique(lengths):
        at = np.nonzero(lengths == length)[0]
        made = make(whole_numbers(np.stack([v.iloc[k] for k in at])))
        for k, value in zip(at, made):
            out[k] = value
    return out.tolist()
