"""Reduction to few dimensions: neighbours, weights, and layouts that keep neighbourhoods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import clustering, reduction


def blobs(n, seed, dim=20, groups=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 3
    label = rng.integers(0, groups, n)
    return centres[label] + 0.6 * rng.normal(size=(n, dim)), label


def frame(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>").repartition(3)


def cosine_distances(x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("block, least", [(4096, 1.0), (40, 0.95)])
def test_neighbours(spark, block, least):
    x, _ = blobs(160, 3)
    got = {}
    for r in reduction.neighbours(frame(spark, x), 8, block).collect():
        got.setdefault(r.k, set()).add(r.other)
    want = np.argsort(cosine_distances(x), 1)[:, :8]
    assert all(len(v) == 8 for v in got.values()) and np.mean([len(got[k] & set(want[k])) / 8 for k in range(160)]) >= least


def test_descent_ships_a_vector_once_a_block(spark):
    """not once a pair of neighbours' neighbours."""
    x, _ = blobs(600, 4, dim=400)
    rows = frame(spark, x)

    def shuffled():
        jvm, lists = spark._jvm, spark._jvm.java.util.ArrayList
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(lists(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), lists())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    got = reduction.neighbours(rows, 12, 100).count()
    assert got == 600 * 12 and shuffled() - before < 60 * x.nbytes


def test_weights(spark):
    x, _ = blobs(60, 4)
    d = cosine_distances(x)
    near = np.argsort(d, 1)[:, :6]
    df = spark.createDataFrame([(i, int(j), float(d[i, j])) for i in range(60) for j in near[i]], "k long, other long, d double")
    got = {(r.k, r.other): r.w for r in reduction.fuzzy_weights(df).collect()}
    one = np.zeros((60, 60))
    for i in range(60):
        rest = d[i, near[i]] - d[i, near[i, 0]]
        lo, hi = 1e-9, 1e3
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if np.exp(-rest / mid).sum() > np.log2(6) else (mid, hi)
        one[i, near[i]] = np.exp(-rest / lo)
    both = one + one.T - one * one.T
    assert set(got) == set(zip(*np.nonzero(both))) and all(abs(got[p] - both[p]) < 1e-4 for p in got)


def test_curve():
    a, b = reduction.curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01  # the usual values at this distance


def trust(x, y, k=10):
    """How few of a row's neighbours in the layout are far from it in the original (1: none)."""
    dx, dy = cosine_distances(x), np.linalg.norm(y[:, None] - y[None], axis=2)
    np.fill_diagonal(dy, np.inf)
    rank = np.argsort(np.argsort(dx, 1), 1) + 1
    near = np.argsort(dy, 1)[:, :k]
    n = len(x)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(0, np.take_along_axis(rank, near, 1) - k).sum()


@pytest.mark.parametrize("block, rounds", [(4096, 1), (60, 4)])
def test_layout_keeps_neighbourhoods_and_feeds_clusters(spark, block, rounds):
    x, label = blobs(200, 5)
    df = frame(spark, x)
    got = reduction.reduce(df, "k", "v", dims=2, near=10, epochs=80, rounds=rounds, block=block).orderBy("k").collect()
    y = np.array([r.reduced for r in got])
    assert y.shape == (200, 2) and np.isfinite(y).all() and trust(x, y) > 0.9
    centre = np.array([y[label == g].mean(0) for g in range(4)])
    assert (np.argmin(np.linalg.norm(y[:, None] - centre, axis=2), 1) == label).mean() > 0.95
    again = reduction.reduce(df.repartition(5), "k", "v", dims=2, near=10, epochs=80, rounds=rounds, block=block).orderBy("k").collect()
    assert np.allclose(y, np.array([r.reduced for r in again]))


def test_reduced_rows_give_the_planted_clusters(spark):
    x, label = blobs(150, 6)
    reduced = reduction.reduce(frame(spark, x), "k", "v", dims=5, near=10, epochs=80)
    found = {r.k: r.cluster for r in clustering.density_clusters(reduced, "k", "reduced", (10,), metric="euclidean").collect()}
    pure = [{label[k] for k in found if found[k] == c} for c in set(found.values())]
    assert len(found) > 100 and all(len(p) == 1 for p in pure) and len(set().union(*pure)) == 4


def test_small_and_odd_tables(spark):
    one = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "k string, v array<float>").withColumn("p", F.lit("clash"))
    rows = reduction.reduce(one, "k", "v", epochs=5).collect()
    assert [r.k for r in rows] == ["a"] and len(rows[0].reduced) == 5
    assert reduction.reduce(one.limit(0), "k", "v").count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "k long, v array<float>")
    assert np.isfinite([r.reduced for r in reduction.reduce(same, "k", "v", epochs=20).collect()]).all()
