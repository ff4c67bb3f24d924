import numpy as np

from tidewake.operators import clustering, density


def rows(n=400, copies=40):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 8))
    x[:copies] = x[0]
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_within_gives_all_pairs_near_either_row():
    x, y = rows()[:150], rows()[150:]
    d = clustering.distances(x, y)
    by_left, by_right = np.full(150, 0.5), np.where(np.arange(250) % 2, 0.7, -1.0)
    got = {(i, j) for p, q, _ in density.within(x, y, by_left, by_right, True) for i, j in zip(p.tolist(), q.tolist())}
    want = set(map(tuple, np.argwhere((d <= by_left[:, None]) | (d <= by_right)).tolist()))
    assert len(want) > 50 and want <= got and len(got) < len(want) + 20


def test_few_pairs_come_before_the_bounds_and_clusters_are_those_of_the_whole(spark, monkeypatch):
    """Pairs of blocks hand out no forests of their own: what is left besides rows' nearest others is less than a pair a row."""
    x, left = rows(), []
    inner = density.before_bounds
    monkeypatch.setattr(density, "before_bounds", lambda *a: left.append(inner(*a)) or left[0])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    got = {(r.k, r.resolution): r.cluster for r in clustering.density_clusters(df, "k", "v", (3, 10), block=90).collect()}
    want = {}
    for size in (3, 10):
        labels, name = clustering.density_labels(x, size).tolist(), clustering.RESOLUTIONS[size]
        want |= {(k, name): f"0/{name}/{labels.index(c)}" for k, c in enumerate(labels) if c >= 0}
    assert want and got == want
    assert left[0].count() < len(x)
