"""Time-ordered operators: gaps, bursts, cadence, derivatives and correlated series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators import blocks


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def _since_last(ts: str, w) -> Column:
    """Seconds since the row before, from whole microseconds: no digits are lost."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return (t - F.lag(t).over(w)) / 1_000_000


def gaps(posts: DataFrame, key: str, ts: str) -> DataFrame:
    """mean, population deviation and count of the seconds between successive posts of a key."""
    w = Window.partitionBy(key).orderBy(ts)
    d = posts.where(F.col(ts).isNotNull()).withColumn("_gap", _since_last(ts, w))
    return d.groupBy(key).agg(F.count("*").alias("n"), F.avg("_gap").alias("gap_mean"), F.stddev_pop("_gap").alias("gap_std"))


def burst(posts: DataFrame, key: str, ts: str, width: str = "15 minutes") -> DataFrame:
    """z-score of a key's last non-empty bucket among its non-empty buckets, clipped to +-10."""
    counts = posts.where(F.col(ts).isNotNull()).groupBy(key, F.window(F.col(ts).cast("timestamp"), width).getField("start").alias("bucket")).agg(F.count("*").alias("cnt"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    per = counts.groupBy(key).agg(F.count("*").alias("buckets"), F.avg("cnt").alias("mean"), F.stddev_pop("cnt").alias("std"), F.max_by("cnt", "bucket").alias("newest"), F.min("first").alias("first"), F.max("last").alias("last"))
    flat = (seconds(F.col("last")) - seconds(F.col("first")) < 60) | (F.col("buckets") < 2) | (F.col("std") < 0.01)
    z = F.try_divide(F.col("newest") - F.col("mean"), F.col("std"))
    return per.select(key, "buckets", F.when(flat, 0.0).otherwise(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), z))).alias("burst"))


def coordination(gap_stats: DataFrame) -> DataFrame:
    """The multiplier of regular timing, from ``gaps``."""
    cov = F.col("gap_std") / F.col("gap_mean")
    value = F.when((F.col("n") < 5) | F.col("gap_mean").isNull() | (F.col("gap_mean") < 1), 1.0).when(cov < 0.3, 1 + (0.3 - cov) * 3).when(cov < 0.5, 1 + (0.5 - cov)).otherwise(1.0)
    return gap_stats.withColumn("coordination", F.least(F.lit(2.0), value)).withColumn("temporal_sync", (F.col("n") >= 5) & (F.col("gap_mean") >= 1) & (cov < 0.5))


def batch_cadence(gap_stats: DataFrame, feed_share: Column, period: float = 900.0) -> DataFrame:
    """Whether posts come in a feed's batches: gaps near a multiple of ``period``, or very even ones."""
    return gap_stats.withColumn("batch_artifact", batch_artifact(F.col("n"), F.col("gap_mean"), F.col("gap_std"), feed_share, period))


def batch_artifact(n: Column, gap_mean: Column, gap_std: Column, feed_share: Column, period: float = 900.0) -> Column:
    cov = gap_std / gap_mean
    rest = F.pmod(gap_mean, F.lit(period))
    near = F.least(rest, F.lit(period) - rest) < 60
    all_feed = (feed_share >= 1) & ((cov < 0.15) | (near & (cov < 0.25)))
    mostly = (feed_share >= 0.80) & ((cov < 0.20) | (near & (cov < 0.30)))
    return F.coalesce((n >= 5) & (gap_mean >= 1) & (all_feed | mostly), F.lit(False))


def derivatives(series: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """First and second derivative per hour of each key's series, and the rank from the newest."""
    w = Window.partitionBy(key).orderBy(ts)
    hours = _since_last(ts, w) / 3600
    out = series.withColumn("d1", F.when(hours > 0, (F.col(value) - F.lag(value).over(w)) / hours))
    return out.withColumn("d2", F.col("d1") - F.lag("d1").over(w)).withColumn("newest", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts))))


#: Keys of a block of series at most, numbers of its matrix about, pairs that are weighed at once.
KEYS, NUMBERS, CELLS = 4096, 1 << 21, 1 << 20


def aligned_series(series: DataFrame, key: str, at: str, value: str, least: int = 3, block: int | None = None, above: float | None = None) -> DataFrame:
    """(a, b, points, r, sa, sb) of keys a < b with at least ``least`` common points: count, correlation and deviations over those.

    Keys are dealt into blocks by hash (of as many keys as their points in time allow, if ``block`` is not given), which are stored once; each pair of blocks is
    met in one task that multiplies matrices of values and of what is present, some rows at a time. So no point in time that many keys share is a join key, and only
    pairs with enough points leave a task; with ``above`` (over 0) only those whose correlation is over it or so near that rounding decides.
    """
    kind = series.schema[key].dataType.simpleString()
    s = series.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("k"), F.col(at).alias("at")).agg(F.avg(value).alias("v"))
    rows = s.groupBy("k").agg(F.collect_list(F.struct(F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.coalesce("v", F.lit(float("nan"))).alias("v"))).alias("p"))
    rows = rows.select("k", F.transform("p", lambda x: x["at"]).alias("at"), F.transform("p", lambda x: x["v"].cast("double")).alias("v"))
    size = series.agg(F.count_distinct(key).alias("keys"), F.count_distinct(at).alias("times")).first()
    count = max(1, -(-size["keys"] // (block or max(64, min(KEYS, NUMBERS // max(1, size["times"]))))))
    dealt = blocks.packed(rows.select("k", "at", "v", F.pmod(F.xxhash64("k"), F.lit(count)).cast("int").alias("own")), ("own",), count, "series")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, *data in zip(*(batch.column(c).to_pylist() for c in ("x_own", "y_own")), *(batch.column(c) for c in ("x_data", "y_data"))):
                yield from weighed(x, y, [blocks.unpacked(d) for d in (data if x < y else data[:1])])

    def weighed(x: int, y: int, sides: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        own_ = np.repeat([x, y][: len(sides)], [t.num_rows for t in sides])
        group = pa.concat_tables(sides).combine_chunks()
        keys = group.column("k")
        lists = group.column("at").combine_chunks()
        flat, lengths = np.asarray(lists.flatten()), np.asarray(lists.value_lengths())
        times, place = np.unique(flat, return_inverse=True)
        v = np.full((len(keys), len(times)), np.nan)
        v[np.repeat(np.arange(len(keys)), lengths), place] = np.asarray(group.column("v").combine_chunks().flatten())
        order = np.argsort(np.array(keys.to_pylist(), object), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        there = np.isfinite(v)
        centre = np.where(there.any(1), np.nansum(np.where(there, v, 0), 1) / np.maximum(1, there.sum(1)), 0)  # moments about a near point keep their digits
        z = np.where(there, v - centre[:, None], 0.0)
        i_, j_ = np.flatnonzero(own_ == x), np.flatnonzero(own_ == y)
        m, w = there.astype(float), z * z
        zt, mt, wt = (t[j_].T.copy() for t in (z, m, w))
        step = max(1, CELLS // max(1, len(j_)))
        for start in range(0, len(i_), step):
            some = i_[start : start + step]
            n = m[some] @ mt
            good = n >= least
            if x == y:
                good &= rank[some][:, None] < rank[j_]
            sums = [z[some] @ mt, m[some] @ zt, w[some] @ mt, m[some] @ wt, z[some] @ zt]
            with np.errstate(divide="ignore", invalid="ignore"):
                if above is not None and above > 0:
                    mx, my = sums[0] / n, sums[1] / n
                    va, vb, cov = sums[2] / n - mx * mx, sums[3] / n - my * my, sums[4] / n - mx * my
                    good &= (cov > 0) & (cov * cov >= (above - 1e-6) ** 2 * va * vb)
                i, j = np.nonzero(good)
                if not len(i):
                    continue
                n, (sx, sy, sxx, syy, sxy) = n[i, j], (t[i, j] for t in sums)
                va, vb, cov = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2, sxy / n - sx * sy / n**2
                sa, sb = np.sqrt(np.maximum(0, va)), np.sqrt(np.maximum(0, vb))
                r = np.where((sa > 0) & (sb > 0), cov / (sa * sb), np.nan)
            first, second = some[i], j_[j]
            swap = rank[first] > rank[second]
            a, b = np.where(swap, second, first), np.where(swap, first, second)
            out = [keys.take(pa.array(a)), keys.take(pa.array(b)), pa.array(n.astype(np.int64)), pa.array(r), pa.array(np.where(swap, sb, sa)), pa.array(np.where(swap, sa, sb))]
            yield from pa.table(out, ["a", "b", "points", "r", "sa", "sb"]).to_batches()

    pairs = blocks.met(blocks.side(dealt, "x"), blocks.side(dealt, "y"), F.col("x_own") <= F.col("y_own"))
    return pairs.mapInArrow(run, f"a {kind}, b {kind}, points long, r double, sa double, sb double")


def correlated_series(series: DataFrame, key: str, at: str, value: str, least: int = 3, above: float = 0.7) -> DataFrame:
    """(a, b, points, r) of keys whose values at common points correlate by over ``above``."""
    pairs = aligned_series(series, key, at, value, least, above=above)
    return pairs.where((F.col("sa") >= 0.01) & (F.col("sb") >= 0.01) & ~F.isnan("r") & (F.col("r") > above)).select("a", "b", "points", "r")
