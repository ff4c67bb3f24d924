"""Gaps and bursts of a stream, key by key, with state that is bounded by the watermark and by how long a key may be idle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMS = ["n", "first", "last", "gap_mean", "gap_m2", "buckets", "cnt_mean", "cnt_m2", "bucket", "cnt"]


def add_to(n: int, mean: float, m2: float, x: float) -> tuple[int, float, float]:
    """Count, mean and sum of squared deviations with one value more."""
    n += 1
    d = x - mean
    mean += d / n
    return n, mean, m2 + d * (x - mean)


class Timing(StatefulProcessor):
    """Posts wait in a map until the watermark has passed them, so they are counted in the order of time, whatever order they come in.

    What is counted leaves ten numbers a key. After ``keep`` milliseconds without posts a key begins anew, and its numbers are dropped.
    """

    def __init__(self, key: str, width: int, keep: int):
        self.key, self.width, self.keep = key, width, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "c long")
        self.sums = handle.getValueState("sums", "n long, first long, last long, gap_mean double, gap_m2 double, buckets long, cnt_mean double, cnt_m2 double, bucket long, cnt long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for part in rows:
            for at, c in part.groupby("at_").size().items():
                at = int(at)
                held = self.waiting.getValue((at,))[0] if self.waiting.containsKey((at,)) else 0
                self.waiting.updateValue((at,), (held + int(c),))
                newest = at if newest is None else max(newest, at)
        if newest is not None:
            self.handle.registerTimer(newest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] < passed)
        s = dict(zip(SUMS, self.sums.get())) if self.sums.exists() else None
        if not ready:
            if s is not None and s["last"] + self.keep * 1000 <= passed:
                self.sums.clear()
            return
        for at, c in ready:
            self.waiting.removeKey((at,))
            s = self._counted(s, at, c)
        self.sums.update(tuple(s[x] for x in SUMS))
        # a timer that the watermark has passed already would never fire
        self.handle.registerTimer(max((s["last"] // 1000) + self.keep, passed // 1000) + 1)
        yield pd.DataFrame({self.key: [key[0]], "n": [s["n"]], "gap_mean": [s["gap_mean"] if s["n"] > 1 else None], "gap_std": [math.sqrt(max(0.0, s["gap_m2"]) / (s["n"] - 1)) if s["n"] > 1 else None], "buckets": [s["buckets"] + 1], "burst": [self._burst(s)]})

    def _counted(self, s: dict | None, at: int, c: int) -> dict:
        bucket = at // (self.width * 1000)
        if s is None or at - s["last"] >= self.keep * 1000:
            s = dict(n=0, first=at, last=at, gap_mean=0.0, gap_m2=0.0, buckets=0, cnt_mean=0.0, cnt_m2=0.0, bucket=bucket, cnt=0)
        for k in range(c):
            if s["n"]:
                _, s["gap_mean"], s["gap_m2"] = add_to(s["n"] - 1, s["gap_mean"], s["gap_m2"], 0.0 if k else (at - s["last"]) / 1e6)
            s["n"] += 1
        if bucket != s["bucket"]:  # the one before is complete
            s["buckets"], s["cnt_mean"], s["cnt_m2"] = add_to(s["buckets"], s["cnt_mean"], s["cnt_m2"], s["cnt"])
            s["bucket"], s["cnt"] = bucket, 0
        s["cnt"] += c
        s["last"] = at
        return s

    @staticmethod
    def _burst(s: dict) -> float:
        n, mean, m2 = add_to(s["buckets"], s["cnt_mean"], s["cnt_m2"], s["cnt"])
        std = math.sqrt(max(0.0, m2) / n)
        if s["last"] - s["first"] < 60_000_000 or n < 2 or std < 0.01:
            return 0.0
        return max(-10.0, min(10.0, (s["cnt"] - mean) / std))

    def close(self) -> None:
        pass


def timing_scores(posts: DataFrame, key: str, ts: str = "published_at", late: str = "2 hours", width_minutes: int = 15, keep_hours: int = 48) -> DataFrame:
    """A stream of (key, n, gap_mean, gap_std, buckets, burst), in update mode: what ``temporal.gaps`` and ``temporal.burst`` give of all posts that
    the watermark has passed.

    Rows with a null key or time, and rows later than the watermark, are left out; posts of equal times are gaps of zero. State is the posts
    within ``late``, and ten numbers for each key that has posted within ``keep_hours``; a key that comes back later begins anew.
    """
    spark = posts.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = posts.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_")).withWatermark(ts, late)
    kind = posts.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(Timing(key, width_minutes * 60_000, keep_hours * 3_600_000), f"`{key}` {kind}, n long, gap_mean double, gap_std double, buckets long, burst double", "Update", "EventTime")
