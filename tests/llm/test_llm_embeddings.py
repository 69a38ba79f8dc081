"""Embedding near-duplicates and components against brute force."""

import random

import numpy as np
import pytest

from salesframe.llm import common, embed_dedup


def brute(rows, threshold=0.95):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for (_, v), k in zip(rows, ok)]
    up, links = list(range(n)), [0] * n

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        least[i] = min(ids) if ids else None
    return sorted((repr(rows[i][0]), links[i], repr(least[i]), rows[i][0] == least[i]) for i in range(n))


def odd_vectors(kind):
    rng = np.random.default_rng(4)
    rows = [(0, None), (1, []), (2, [0.0] * 16), (3, [float("nan")] + [1.0] * 15), (4, [None] + [1.0] * 15),
            (5, [float("inf")] + [1.0] * 15), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (None, [1.0, 2.0])]
    i = 10
    for _ in range(12):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8))):
            v = (centre + rng.normal(size=16) * rng.choice([0.05, 0.3])) * rng.choice([1, 1e-20, 1e15])
            rows.append((i, np.array(v, kind).astype(float).tolist()))
            i += 1
    same = np.array(rng.normal(size=16), kind).astype(float).tolist()
    return rows + [(200 + k, same) for k in range(30)] + [(200, same)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_groups(spark, kind):
    rows = odd_vectors(np.float32 if kind == "float" else np.float64)
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr(
        "*", "1 AS id", "2 AS v", "3 AS n_links", "4 AS block")
    got = embed_dedup.embedding_groups(frame).collect()
    assert sorted((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in got) == brute(rows)
    assert embed_dedup.embedding_groups(frame.where("false")).count() == 0


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 24)), rng.normal(size=(200, 24))
    y[:100] = x[:100] + rng.normal(size=(100, 24)) * 0.35
    x, y = embed_dedup.unit(x), embed_dedup.unit(y)
    for threshold in (0.95, 0.5, -2.0):
        a, b = embed_dedup.tile_links(x, y, threshold)
        assert set(zip(a.tolist(), b.tolist())) == set(map(tuple, np.argwhere(x @ y.T >= threshold).tolist()))
    codes, scale, length, error = embed_dedup.quantise(x)
    assert codes.dtype == np.int8 and np.allclose(np.linalg.norm(x - codes * scale, axis=1), error)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(60)] + [(9000, 9000)]
    pairs += [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    rng.shuffle(pairs)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_total(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, "a", "b"]), i, rng.randrange(9)) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, i long, v long")
    from pyspark.sql import functions as F
    got = common.running_total(frame, ["k"], ["i"], {"before": F.col("v"), "place": F.lit(1)}).collect()
    assert len(got) == 300
    for k in (None, "a", "b"):
        own = sorted((r.place, r.before, r.v) for r in got if r.k == k)
        assert [p for p, *_ in own] == list(range(len(own)))
        assert all(b == sum(x[2] for x in own[:i]) for i, (_, b, _) in enumerate(own))
