"""Near-duplicate embeddings by int8 tile products with exact error bounds.

Vectors are scaled to length one and quantised to int8 codes, one scale per tile, together
with the length of each vector's own quantisation error. For codes p, q the true cosine
differs from the scaled product of the codes by at most ``|p'| e_q + e_p |q'| + e_p e_q`` (p', q' the
decoded vectors, e their errors); only pairs whose product plus this bound reaches the
threshold are computed again, in double precision. Products of codes run as matrix
products; their sums stay below 2**24, where single precision holds every integer.

Equal vectors are one class first, so copies cost nothing. Classes are hashed into blocks;
each pair of blocks is one task, so the work is spread evenly whatever the data. A block has
about 16 times the square root of the number of classes, which keeps what is sent (classes
times blocks) well below what is computed. A task returns link counts per class and a
spanning forest of its links, never the links themselves.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing and stay; vectors of different lengths do not link; repeated rows are other
vectors that link; a null id takes part, and is the id of a component only if it has no
other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import components

THRESHOLD = 0.95
#: Codes per side of one tile product.
TILE = 2048
_PAIRS = 1 << 16
#: For the rounding of the bounds themselves.
_SLACK = 1e-6


def quantise(units: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, their common scale, and per vector decoded length and error."""
    scale = max(float(np.abs(units).max(initial=0.0)), 1e-300) / 127
    codes = np.rint(units / scale).astype(np.int8)
    decoded = codes * scale
    return codes, scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(units - decoded, axis=1)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of unit vectors with cosine >= threshold."""
    (p, ps, pl, pe), (q, qs, ql, qe) = quantise(x), quantise(y)
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = p.astype(exact) @ q.astype(exact).T
    # a bound for a row takes the largest error of the other tile; each pair found is then held to its own bound
    least = (threshold - _SLACK - pl * qe.max() - pe * (ql + qe).max()) / (ps * qs)
    a, b = np.nonzero(product >= np.floor(least)[:, None])
    own = product[a, b] * (ps * qs) + pl[a] * qe[b] + pe[a] * (ql[b] + qe[b]) >= threshold - _SLACK
    a, b = a[own], b[own]
    if not len(a):
        return a, b
    rows, cols = np.unique(a), np.unique(b)
    if len(rows) * len(cols) <= 4 * len(a):  # a dense group: one product of its vectors
        near = x[rows] @ y[cols].T >= threshold
        i, j = np.searchsorted(rows, a), np.searchsorted(cols, b)
        good = near[i, j]
    else:
        good = np.concatenate([np.einsum("ij,ij->i", x[a[at:at + _PAIRS]], y[b[at:at + _PAIRS]]) >= threshold
                               for at in range(0, len(a), _PAIRS)])
    return a[good], b[good]


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest (member, root) with the same components as the links."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    left, right = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _block_pair(threshold: float, kind: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        sides = [rows[rows["block"] == k] for k in dict.fromkeys(key)]
        for length in sorted(set.intersection(*[set(s["dims"]) for s in sides])):
            own = [s[s["dims"] == length] for s in sides]
            x = [unit(np.frombuffer(b"".join(s["raw"]), kind).reshape(-1, length)) for s in own]
            ids = [s["cls"].to_numpy() for s in own]
            weights = [s["n"].to_numpy() for s in own]
            links = [np.zeros(len(i), np.int64) for i in ids]
            a, b = [], []
            other = len(own) - 1
            for i in range(0, len(x[0]), TILE):
                for j in range(i if not other else 0, len(x[other]), TILE):
                    p, q = tile_links(x[0][i:i + TILE], x[other][j:j + TILE], threshold)
                    p, q = p + i, q + j
                    if not other:
                        p, q = p[p < q], q[p < q]
                    np.add.at(links[0], p, weights[other][q])
                    np.add.at(links[other], q, weights[0][p])
                    member, root = star(ids[0][p], ids[other][q])
                    a.append(member)
                    b.append(root)
            for i, n in zip(ids, links):
                out.append(pd.DataFrame({"a": i[n > 0], "b": pd.array([None] * int((n > 0).sum()), "Int64"), "n": n[n > 0]}))
            a, b = star(np.concatenate(a), np.concatenate(b))
            out.append(pd.DataFrame({"a": a, "b": pd.array(b, "Int64"), "n": 0}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
    return run


def embedding_groups(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
                     threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id`` and ``kept``."""
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    v = F.col(vector)
    fits = (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(
        v, lambda c: c != 0)
    rows = vectors.select(F.col(id_column).alias("id"), F.when(fits, v).alias("v"))
    classes = settle(
        rows.where("v is not null").groupBy("v")
        .agg(F.count("*").alias("n"), F.min("id").alias("least"))
        .withColumn("cls", F.monotonically_increasing_id()), "classes")
    blocks = max(1, round(classes.count() ** 0.5 / 16))

    @F.pandas_udf("binary")
    def packed(x: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(c, kind).tobytes() for c in x], dtype=object)

    own = classes.select("cls", "n", F.size("v").alias("dims"), packed("v").alias("raw"),
                         F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns(
        {"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    found = settle(dealt.groupBy("low", "high").applyInPandas(_block_pair(threshold, kind), "a long, b long, n long"),
                   "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    rooted = components(found.where("b is not null"))
    named = classes.join(counts, "cls", "left").join(
        rooted.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
        "v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(named.join(least, "root").select(F.col("v").alias("class_v"), "n_links", "component_id"), "named")
    found = rows.join(named, F.col("v") == F.col("class_v"), "left")
    lone = F.col("v").isNull()
    component = F.when(lone, F.col("id")).otherwise(F.col("component_id"))
    return found.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (lone | F.col("id").eqNullSafe(component)).alias("kept"))
