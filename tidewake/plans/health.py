"""Health of jobs: counts observed while a job runs, heartbeats, stale stages, and retries of what lands files."""

from __future__ import annotations

import json
import os
import random
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df``, and an observation that holds the named aggregates after its first action: counters without a second pass."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in counts.items())), seen


def heartbeat(path: str, stage: str, status: str, **facts) -> dict:
    """Replace the heartbeat file (on the driver's disk) at once; readers see the old one or the new one."""
    said = {"stage": stage, "status": status, "at": datetime.now(timezone.utc).isoformat(), **facts}
    temp = f"{path}.tmp"
    with open(temp, "w") as f:
        json.dump(said, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)
    return said


def stale_stages(beats: list[dict], now: datetime, seconds: int = 3600) -> list[str]:
    return sorted(b["stage"] for b in beats if (now - datetime.fromisoformat(b["at"])).total_seconds() > seconds)


def with_retry(call: Callable[[], object], retries: int = 3, base: float = 2.0, most: float = 30.0, retry_on: tuple[type[Exception], ...] = (OSError,), sleep: Callable[[float], None] = time.sleep):
    """The call's result; after each failure a pause that doubles, up to ``most`` seconds and a tenth of jitter; the last failure is raised."""
    for k in range(retries + 1):
        try:
            return call()
        except retry_on:
            if k == retries:
                raise
            sleep(min(most, base * 2**k) * (1 + random.random() / 10))
    return None


#: Free space under which ingest pauses, in GB.
LEAST_FREE_GB = 1.0


def disk_state(spark: SparkSession, path: str, least_free_gb: float = LEAST_FREE_GB) -> dict:
    """path, free_gb, total_gb, used_percent and paused (under ``least_free_gb`` are free) of the file system that holds ``path``.

    Asked through Spark's file systems, so it tells of the store that all machines write to, not of the driver's disk.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getStatus(where)
    free, total, used = (x / 1024**3 for x in (status.getRemaining(), status.getCapacity(), status.getUsed()))
    return {"path": path, "free_gb": round(free, 2), "total_gb": round(total, 2), "used_percent": round(100 * used / max(total, 1e-9), 1), "paused": free < least_free_gb}


def should_pause_ingest(spark: SparkSession, path: str, least_free_gb: float = LEAST_FREE_GB) -> bool:
    return disk_state(spark, path, least_free_gb)["paused"]
