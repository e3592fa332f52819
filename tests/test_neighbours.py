"""Neighbours of every row against all pairs, on clusters, copies and odd vectors."""

import math
import random

import numpy as np
import pytest

from nearfield.operators import vectors


def plain(rows, k):
    """The k best others by cosine, from all pairs; rows: id -> vector."""
    out = []
    length = {i: math.sqrt(sum(x * x for x in v)) for i, v in rows.items()}
    for q, x in rows.items():
        sims = []
        for n, y in rows.items():
            if n != q:
                over = length[q] * length[n]
                sims.append((-round(sum(a * b for a, b in zip(x, y)) / over, 9) if over else 0.0, n))
        out += [(q, n, rank + 1) for rank, (_, n) in enumerate(sorted(sims)[:k])]
    return sorted(out)


def found(df, k, **options):
    return sorted((r.q, r.n, r["rank"]) for r in vectors.neighbours(df, k, "id", "v", **options).collect())


def clustered(seed, groups, size, width=6, spread=0.02):
    rng = random.Random(seed)
    rows, n = {}, 0
    for _ in range(groups):
        centre = [rng.gauss(0, 1) for _ in range(width)]
        for _ in range(size):
            rows[n] = [c + rng.gauss(0, spread) for c in centre]
            n += 7
    return rows


@pytest.mark.parametrize(("k", "block"), [(3, 32), (1, 4096)])
def test_as_all_pairs(spark, k, block):
    rng = random.Random(1)
    rows = clustered(2, 12, 15) | {-i: [rng.gauss(0, 1) for _ in range(6)] for i in range(1, 60)}
    df = spark.createDataFrame(list(rows.items()), "id long, v array<double>")
    assert found(df, k, block=block) == plain(rows, k)


def test_products_are_few_on_clusters(spark):
    rows = clustered(3, 40, 50)
    df = spark.createDataFrame(list(rows.items()), "id long, v array<double>")
    made = spark.sparkContext.accumulator(0)
    assert found(df, 3, block=32, products=made) == plain(rows, 3)
    assert 0 < made.value < len(rows) ** 2 / 4


@pytest.mark.parametrize("block", [4, 4096])
def test_copies_and_zero_vectors(spark, block):
    rows = {i: [1.0, 0.0] for i in range(9)} | {20 + i: [0.0, 0.0] for i in range(4)} | {40: [1.0, 1e-3], 41: [0.0, 1.0], 42: [0.0, -2.0], 43: [0.0, 1.0]}
    df = spark.createDataFrame(list(rows.items()), "id long, v array<double>")
    for k in (1, 3, 30):
        assert found(df, k, block=block) == plain(rows, k)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [1.0, 1.0]), (5, None), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, []), (None, [1.0, 2.0]), (10, [2.0, 1.0]), (10, [5.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert found(df, 5) == plain({2: [0.0, 1.0], 4: [1.0, 1.0], 10: [2.0, 1.0]}, 5)
    assert found(df.where("id = 5"), 5) == [] and found(df.where("false"), 5) == [] and found(df.where("id = 2"), 5) == []


@pytest.mark.parametrize("columns", [3, 4096])
def test_best_of_a_block_by_definition(monkeypatch, columns):
    """Near copies, which single precision can't tell apart, included; nothing is sorted whole."""
    monkeypatch.setattr(vectors, "_COLUMNS", columns)
    rng = np.random.default_rng(5)
    y = np.concatenate([rng.standard_normal((40, 8)), 1 + 1e-8 * rng.standard_normal((40, 8)), np.zeros((3, 8))])
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    ns, qs, k = np.arange(len(y)) * 2, np.concatenate([np.arange(30, 90), [7]]), 5
    x = np.concatenate([y[qs[:-1] // 2], y[3:4]])
    sim = np.round(x @ y.T, 12)
    sim[qs[:, None] == ns[None, :]] = -np.inf
    r, c, s = vectors._best(x, y, qs, ns, k)
    want = np.sort(-sim, axis=1)[:, :k] * -1
    assert np.bincount(r).tolist() == [k] * len(x) and np.allclose(s.reshape(-1, k), want, rtol=0, atol=2e-12)
    assert all(qs[a] != ns[b] for a, b in zip(r, c))
