"""Hard negatives against a brute-force version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, dim):
    """anchor, positive, rank, negative, scores, in whole numbers of Python."""
    sound = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            sound.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    for a in sorted({i for i, _, _ in sound if i % 50 == 0}):
        _, label, v = min(r for r in sound if r[0] == a)
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, n) for i, n, w in sound)
        for p, i, _ in [s for s in scored if s[2] == label and s[1] != a][:5]:
            fits = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a, i, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fits)]
    return sorted(out)


def some(seed, n, dim, spread=0.3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dim))
    v = centres[r.integers(5, size=n)] + spread * r.normal(size=(n, dim))
    return [(int(i), [float(x) for x in w], int(label)) for i, w, label in zip(r.permutation(n), v, r.integers(4, size=n), strict=True)]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed,dim,spread", [(1, 4, 0.3), (2, 8, 2.0), (3, 2, 0.6)])
def test_against_brute_force(spark, seed, dim, spread):
    rows = some(seed, 900, dim, spread)
    found = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), shard_rows=100, block_rows=7)
    assert got(found) == brute(rows, dim) != []


def test_odd_rows(spark):
    """Nulls, other lengths, repeated rows and ids, ties, zero vectors, and columns with clashing names."""
    r = random.Random(4)
    rows = [(i, [float(r.randrange(3)), float(r.randrange(3)), 1.0], r.randrange(3)) for i in range(200)] + [(k, [0.0] * 3, 1) for k in (50, 51, 300)]
    rows += rows[:30] + [(None, [1.0] * 3, 1), (100, None, 1), (101, [1.0] * 3, None), (102, [1.0, None, 2.0], 0), (103, [float("nan"), 1.0, 1.0], 0), (104, [float("inf"), 1.0, 1.0], 0), (150, [1.0, 2.0], 0), (105, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cell", F.lit("x")).withColumn("v", F.lit(2)).withColumn("id", F.lit(7))
    assert got(negatives.hard_negatives(df, shard_rows=40)) == brute(rows, 3) != []


def test_a_third_are_one_vector_and_one_label(spark):
    rows = some(5, 600, 4) + [(1000 + k, [1.0, 0.5, 0.25, 1.0], 2) for k in range(300)]
    assert got(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), shard_rows=64, block_rows=5)) == brute(rows, 4)


def test_large_components(spark):
    rows = [(i, [float(x) * 40_000 for x in v], label) for i, v, label in some(6, 200, 3)]
    assert got(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 3) != []


@pytest.mark.parametrize("rows", [[], [(50, None, None)], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1)], [(50, [1.0], 1), (51, [0.7], 2)]])
def test_too_few(spark, rows):
    found = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA))
    assert found.collect() == []
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_bounds_hold_and_prune():
    """No product leaves a ball's bounds; on clustered vectors most products are never taken, and results are whole."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(40, 16)) * 300
    x = np.floor(centres[r.integers(40, size=4000)] + r.normal(size=(4000, 16)) * 10).astype(np.int64)
    labels, ids = r.integers(3, size=4000), np.arange(4000)
    tree = negatives.BallTree(ids, labels, x)
    q = x[:100]
    norms = np.sqrt((q.astype(float) ** 2).sum(1))

    def under(node):
        _, _, _, kids, rows = tree.nodes[node]
        return rows if kids is None else np.concatenate([under(k) for k in kids])

    for node, (centre, radius, *_) in enumerate(tree.nodes):
        lo, hi = negatives.bounds(q.astype(float), norms, centre, radius)
        products = q @ tree.x[under(node)].T
        assert (products >= lo[:, None]).all() and (products <= hi[:, None]).all()
    every = q @ x.T
    for same, low, high in ((True, np.full(100, -(1 << 62)), np.full(100, 1 << 62)), (False, every.max(1) // 2, every.max(1) * 95 // 100)):
        tree.compared = 0
        best = tree.search(ids[:100], labels[:100], q, low, high, 5, same)
        assert tree.compared < 0.3 * every.size, (same, tree.compared / every.size)
        for k, (s, c) in enumerate(best):
            fits = ((labels == labels[k]) == same) & (every[k] >= low[k]) & (every[k] <= high[k]) & ~(same & (ids == k))
            order = np.lexsort((ids[fits], -every[k][fits]))[:5]
            assert list(s) == list(every[k][fits][order]) and list(c) == list(ids[fits][order])
