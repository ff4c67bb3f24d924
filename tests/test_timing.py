"""Gaps and bursts of a stream equal those of the batch."""

import numpy as np
from pyspark.sql import functions as F

from tidewake.operators import temporal
from tidewake.streaming import timing


def run(spark, path, parts, **options):
    """Each part is a file, read one a batch; the last rows of every key."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "k string, t double").coalesce(1).write.parquet(f"{path}/staged-{k}")
    import glob
    import os
    import time

    os.makedirs(f"{path}/in")
    for k in range(len(parts)):
        for f in glob.glob(f"{path}/staged-{k}/*.parquet"):
            os.rename(f, f"{path}/in/{k}.parquet")
            os.utime(f"{path}/in/{k}.parquet", (time.time() - 100 + k,) * 2)
    out = []
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema("k string, t double").option("maxFilesPerTrigger", 1).parquet(f"{path}/in").select("k", (F.col("t") * 1000000).cast("long").alias("us")).select("k", F.timestamp_micros("us").alias("ts"))
    q = timing.timing_scores(stream, "k", "ts", **options).writeStream.outputMode("update").foreachBatch(lambda df, i: out.extend((i, r) for r in df.collect())).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    q.awaitTermination(300)
    q.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return out


def test_streamed_scores_equal_those_of_the_batch(spark, tmp_path):
    """Out of order within the watermark, equal times, single posts, nulls; a last post far ahead closes all."""
    rng = np.random.default_rng(4)
    rows = [(f"k{a}", float(b)) for a, b in zip(rng.integers(0, 4, 200), np.round(rng.uniform(0, 20_000, 200), 3))] + [("one", 5000.0), ("k0", 5000.0), ("k0", 5000.0)]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 3000))
    parts = [rows[:70], rows[70:140] + [(None, 9000.0), ("k1", None)], rows[140:], [("end", 60_000.0)], [("end", 60_001.0)]]
    got = {r.k: r for _, r in run(spark, str(tmp_path), parts)}
    df = spark.createDataFrame(rows, "k string, t double").select("k", F.timestamp_micros((F.col("t") * 1000000).cast("long")).alias("ts"))
    gaps, bursts = {r.k: r for r in temporal.gaps(df, "k", "ts").collect()}, {r.k: r for r in temporal.burst(df, "k", "ts").collect()}
    assert set(gaps) <= set(got) and len(gaps) == 5
    for k, g in gaps.items():
        assert got[k].n == g.n and got[k].buckets == bursts[k].buckets and abs(got[k].burst - bursts[k].burst) < 1e-9
        assert (g.gap_mean is None and np.isnan(got[k].gap_mean or np.nan)) or (abs(got[k].gap_mean - g.gap_mean) < 1e-6 and abs(got[k].gap_std - g.gap_std) < 1e-6)


def test_idle_keys_are_forgotten(spark, tmp_path):
    hour = 3600.0
    parts = [[("a", 0.0), ("a", 60.0), ("b", 0.0)], [("end", 10 * hour)], [("end", 20 * hour)], [("a", 21 * hour), ("b", 21 * hour)], [("end", 40 * hour)], [("end", 41 * hour)]]
    parts = [[(k, t + 100 * hour) for k, t in part] for part in parts]
    got = [r for _, r in run(spark, str(tmp_path), parts, keep_hours=5) if r.k == "a"]
    assert got[0].n == 2 and got[-1].n == 1  # begun anew
