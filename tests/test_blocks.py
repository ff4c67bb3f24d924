"""Blocks that meet in tasks are stored once: no row is repeated for each block that its own one meets."""

import numpy as np
from pyspark.sql import functions as F

from tidewake.operators import blocks, follows, graph, sets, temporal


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_blocks_are_packed_once_and_meet(spark):
    rows = spark.createDataFrame([(k % 3, k, f"v{k}") for k in range(20)], "own int, k long, v string")
    b = blocks.packed(rows, ("own",), 3, "blocks")
    assert b.count() == 3
    assert sorted(v for r in b.select("data").collect() for v in blocks.unpacked(_binary(r.data)).column("v").to_pylist()) == sorted(f"v{k}" for k in range(20))
    x, y = (blocks.side(b, n) for n in "xy")
    assert sorted((r.x_own, r.y_own) for r in blocks.met(x, y, F.col("x_own") <= F.col("y_own")).select("x_own", "y_own").collect()) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    assert blocks.met(x, y).count() == 9


def _binary(data):
    import pyarrow as pa

    return pa.scalar(bytes(data), pa.binary())


def test_mean_jaccard_repeats_no_sets(spark):
    rng = np.random.default_rng(3)
    rows = [(m % 2, m, f"w{x}") for m in range(60) for x in rng.integers(0, 40, 5)]
    got = sets.mean_jaccard(spark.createDataFrame(rows, "g int, m int, w string"), "g", "m", "w", 4)
    assert "Generate" not in plan(got) and "CartesianProduct" in plan(got)
    assert got.count() == 2


def events_of(spark, sources: int = 30):
    rng = np.random.default_rng(11)
    rows = [(int(s), int(t)) for s, t in zip(rng.integers(0, sources, 600), rng.integers(0, 2000, 600))]
    return spark.createDataFrame(rows, "s long, t long").select("s", F.timestamp_seconds("t").alias("ts"))


def test_triples_of_blocks_repeat_no_timelines(spark):
    df = events_of(spark)
    assert follows.are_dense(df, "s", "ts", 50)
    for got in (graph.follow_clustering(df, "s", "ts", 50, 9), follows.follow_degrees(df, "s", "ts", 50, 9)):
        assert "Generate" not in plan(got) and "CartesianProduct" in plan(got)


def test_pairs_of_blocks_of_sources_repeat_no_timelines(spark, monkeypatch):
    monkeypatch.setattr(follows, "LEAST", 50)
    got = follows.whole_follows(events_of(spark), "s", "ts", 50)
    assert "Union" not in plan(got) and "CartesianProduct" in plan(got)


def test_pairs_of_blocks_of_series_repeat_no_values(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(t) * 3600, float(v)) for k, t, v in zip(rng.integers(0, 20, 300), rng.integers(0, 12, 300), rng.normal(size=300))]
    series = spark.createDataFrame(rows, "k long, t long, v double").select("k", F.timestamp_seconds("t").alias("at"), "v")
    got = temporal.aligned_series(series, "k", "at", "v", 3, 6)
    assert "Generate" not in plan(got) and "CartesianProduct" in plan(got)
    hours = {}
    for k, t, _ in rows:
        hours.setdefault(k, set()).add(t)
    want = {(a, b): len(hours[a] & hours[b]) for a in hours for b in hours if a < b and len(hours[a] & hours[b]) >= 3}
    assert {(r.a, r.b): r.points for r in got.collect()} == want
