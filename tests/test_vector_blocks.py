"""Cosine joins in blocks around pivots: the same pairs as all pairs, fewer blocks shipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import retention, vectors
from tidewake.plans import core, scoring  # noqa: F401
from tidewake.plans.registry import QUERIES


def brute(v, least):
    u = v / np.maximum(np.linalg.norm(v, axis=1), 1e-10)[:, None]
    s = np.round(u @ u.T, 6)
    return {(i, j): s[i, j] for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= least}


def clustered(n, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    return centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, 8))


@pytest.mark.parametrize("least", [-0.2, 0.0, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("block", [16, 2048])
def test_pairs_equal_all_pairs(spark, least, block):
    rng = np.random.default_rng(3)
    v = np.concatenate([clustered(80, 1), rng.normal(size=(40, 8)), np.zeros((2, 8)), np.ones((30, 8))])  # copies, zeros
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(999, None)], "k long, v array<double>").repartition(3)
    got = {(r.a, r.b): r.score for r in vectors.similar_pairs(df, "k", "v", least, block).collect()}
    want = brute(v, least)
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 2e-6 for p in want)
    assert vectors.similar_pairs(df.limit(0), "k", "v", least, block).count() == 0


@pytest.mark.parametrize("block", [16, 2048])
def test_pairs_carry_a_column_and_are_capped_in_tasks(spark, block):
    """F21 to F24: pairs need no join with the rows (F22), and a cap isn't put on all pairs (F23)."""
    v = np.concatenate([clustered(150, 1), np.ones((30, 8))])
    df = spark.createDataFrame([(k, x.tolist(), None if k % 7 == 0 else k % 5) for k, x in enumerate(v)], "k long, v array<double>, label int").repartition(3)
    want = brute(v, 0.9)
    got = vectors.similar_pairs(df, "k", "v", 0.9, block, carry="label").collect()
    label = lambda k: None if k % 7 == 0 else k % 5
    assert {(r.a, r.b) for r in got} == set(want) and len(got) == len(want) and all((r.a_label, r.b_label) == (label(r.a), label(r.b)) for r in got)
    all_, few = vectors.similar_pairs(df, "k", "v", 0.9, block), vectors.similar_pairs(df, "k", "v", 0.9, block, most=2)
    top = lambda m: {tuple(r) for r in retention.cap_matches(m, 2).select("a", "b", "score").collect()}
    assert top(few) == top(all_) and few.count() < all_.count()
    assert block == 16 or few.count() == len(top(few))


def test_queries_join_no_pairs(spark):
    d = "/root/testdata/sf0.001"
    for name in ("c11_both_in_set", "c12_two_labels"):
        plan = QUERIES[name](spark, d)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")], name


def test_blocks_that_are_shipped(spark):
    """Of clustered vectors most pairs of blocks are ruled out; a lower threshold rules out fewer; blocks are bounded, copies too."""
    v = np.concatenate([clustered(600, 5), np.tile(clustered(1, 6), (200, 1))])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "k long, v array<double>")
    rows, pivots = vectors.angular_blocks(df, 32)
    sizes = [r["count"] for r in rows.groupBy("own").count().collect()]
    every = len(sizes) * (len(sizes) + 1) // 2
    shipped = [vectors.near_blocks(rows, pivots, float(np.arccos(least))).count() for least in (0.99, 0.9, -0.99)]
    assert sum(sizes) == 800 and max(sizes) < 64
    assert shipped[0] < every / 4 and shipped[0] <= shipped[1] < shipped[2] <= every


def test_blocks_in_groups(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP", 3)
    v = clustered(150, 7, 0.4)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "k long, v array<double>").withColumn("extra", F.lit(1))
    assert {(r.a, r.b) for r in vectors.similar_pairs(df, "k", "v", 0.8, 16).collect()} == set(brute(v, 0.8))


def test_blocks_are_shares_of_a_table_and_pairs_are_exact():
    """Copies shipped don't grow with the table until blocks are full; single precision only chooses what is computed again."""
    import numpy as np

    from tidewake.operators import vectors

    assert vectors.block_rows(2000, 64) == 4096 and vectors.block_rows(120_000, 64) == 15_000 and vectors.block_rows(10**8, 64) == 1 << 15
    rng = np.random.default_rng(8)
    u, v = (vectors._unit(rng.normal(size=(n, 16))) for n in (150, 90))
    got = {(i, j): s for some in vectors.close_pairs(u, v, 0.3) for i, j, s in zip(*some)}
    s = np.round(u @ v.T, 6)
    assert got == {(i, j): s[i, j] for i, j in zip(*np.nonzero(s >= 0.3))}


@pytest.mark.parametrize("least", [-0.2, 0.5, 0.9])
@pytest.mark.parametrize("block", [16, 64])
def test_threshold_components_equal_those_of_all_pairs(spark, least, block):
    """One, many or few rows outside the largest component; only edges that join something leave a task."""
    rng = np.random.default_rng(11)
    v = np.concatenate([clustered(90, 2), rng.normal(size=(30, 8)), np.zeros((2, 8)), np.ones((20, 8))])
    want = {i: i for i in range(len(v))}
    for _ in v:
        for i, j in brute(v, least):
            want[i] = want[j] = min(want[i], want[j])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(999, None)], "k long, v array<double>").repartition(3)
    assert {r.node: r.component for r in vectors.threshold_components(df, "k", "v", least, block).collect()} == want
    assert vectors.threshold_components(df.limit(0), "k", "v", least, block).count() == 0


def test_a_dense_graph_leaves_a_task_as_a_forest():
    v = vectors._unit(1 + 0.01 * np.random.default_rng(2).normal(size=(300, 8)))
    one = np.arange(300)
    assert len(vectors.joining(v, v, one, one, 0.9)) == 299 and len(vectors.joining(v[:200], v[200:], one[:200], one[200:], 0.9)) == 299
    assert len(vectors.joining(v, v, one * 0, one * 0, 0.9)) == 0
