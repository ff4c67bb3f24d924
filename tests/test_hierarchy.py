"""Clusters of trees that are halved until they fit a task equal those of one task."""

import numpy as np
import pytest

from tidewake.operators import clustering, hierarchy


def points(n, seed, ties):
    rng = np.random.default_rng(seed)
    x = np.concatenate([c + rng.normal(scale=s, size=(n // 4, 3)) for c, s in zip(rng.normal(scale=3, size=(4, 3)), (0.1, 0.3, 0.6, 2.0))])
    return np.round(x, 1) if ties else x


def edges_of(x, size):
    d = clustering.distances(x, x)
    core = np.sort(d, 1)[:, max(1, size // 2)]
    return clustering.forest(clustering.reach(d, core, core))


@pytest.mark.parametrize("most, ties", [(11, True), (30, False), (10_000, True)])
def test_halved_trees_give_the_same_clusters(spark, most, ties):
    trees, pts, want = [], [], {}
    for seed, size in ((1, 3), (2, 5)):
        x = points(72, seed, ties)
        g = f"{size}/s"
        tree = edges_of(x, size)
        trees += [(g, size, a, b, w) for w, a, b in tree]
        pts += [(g, k) for k in range(len(x))]
        labels = clustering.tree_labels(len(x), tree, size).tolist()
        want |= {(g, k): labels.index(c) for k, c in enumerate(labels) if c >= 0}
    got = hierarchy.clusters_of_trees(spark.createDataFrame(trees, "g string, size int, a long, b long, w double"), spark.createDataFrame(pts, "g string, k long"), most)
    assert len(set(want.values())) > 3 and {(r.g, r.k): r.cluster for r in got.collect()} == want


def test_trees_fit_their_tasks(spark):
    tree = edges_of(points(80, 5, False), 3)
    cut = hierarchy.halved(spark.createDataFrame([("3/s", 3, a, b, w) for w, a, b in tree], "g string, size int, a long, b long, w double"), 9)
    sizes = [r["count"] for r in cut.groupBy("p").count().collect()]
    assert sum(sizes) == len(tree) and max(sizes) <= 9 and len(sizes) > 8


def test_spanning_forest_by_rounds(spark):
    """Ties, two graphs, one in two pieces: the same edges as one pass over sorted ones."""
    rng = np.random.default_rng(9)
    rows = [("p", int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(1, 6, 300)) if a < b]
    rows += [("q", a, b, 1.0) for a, b in ((1, 2), (2, 3), (1, 3), (7, 8))]
    rows = sorted(set(rows))
    got = {tuple(r) for r in hierarchy.spanning_forest(spark.createDataFrame(rows, "g string, a long, b long, w double")).collect()}
    want = set()
    for g in "pq":
        mine = [r for r in rows if r[0] == g]
        a, b, w = (np.array([r[k] for r in mine]) for k in (1, 2, 3))
        want |= {mine[k] for k in clustering.lightest(w, a, b, 41)}
    assert got == want
    assert hierarchy.spanning_forest(spark.createDataFrame([], "g string, a long, b long, w double")).count() == 0


def test_clusters_chosen_in_rounds(spark):
    """A deep tree of clusters: rounds choose as one task does."""
    rng = np.random.default_rng(2)
    rows = [("g", f"c:{k}", None if k == 0 else f"c:{max(0, k - int(rng.integers(1, 4)))}", float(rng.integers(0, 9))) for k in range(60)] + [("h", "c:0", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, id string, parent string, mass double")
    one = df.groupBy("g").applyInArrow(hierarchy.choose, "g string, id string, chosen string")
    rounds = hierarchy.choose_in_rounds(df)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in rounds.collect()} and one.where("chosen is not null").count() > 5


def test_density_clusters_without_a_task_for_a_shard(spark):
    x = points(96, 4, True)
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-10)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    got = {(r.k, r.resolution): r.cluster for r in clustering.density_clusters(df, "k", "v", (3, 10), block=30, most_edges=20).collect()}
    want = {}
    for size in (3, 10):
        labels, name = clustering.density_labels(u, size).tolist(), clustering.RESOLUTIONS[size]
        want |= {(k, name): f"0/{name}/{labels.index(c)}" for k, c in enumerate(labels) if c >= 0}
    assert want and got == want
