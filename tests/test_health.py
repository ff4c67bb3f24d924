from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewake.plans import cycle, health, storage
from tidewake.plans.views import posts
from tests.conftest import DATA


def test_observed_counts(spark):
    df, seen = health.observed(spark.range(10), "ids", rows=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))
    assert df.count() == 10 and seen.get == {"rows": 10, "even": 5}


def test_heartbeat_and_stale_stages(tmp_path):
    beat = health.heartbeat(str(tmp_path / "beat"), "scores", "ok", groups=3)
    assert beat["groups"] == 3 and (tmp_path / "beat").exists() and not (tmp_path / "beat.tmp").exists()
    now = datetime.now(timezone.utc)
    assert health.stale_stages([beat], now) == [] and health.stale_stages([beat], now + timedelta(hours=2)) == ["scores"]


def test_retries():
    tries, pauses = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert health.with_retry(call, sleep=pauses.append) == "done" and len(pauses) == 2 and 2 <= pauses[0] <= 2.2 and 4 <= pauses[1] <= 4.4
    with pytest.raises(OSError):
        health.with_retry(lambda: (_ for _ in ()).throw(OSError()), retries=1, sleep=pauses.append)


def test_whole_cycle(spark):
    p = posts(spark, DATA).select("post_id", "source", "url", "title", "content", "language", "published_at", "polarity", "tone", "themes", "vector", "feed", "tone_parts")
    done = cycle.run_cycle(p, f"{storage.shared_dir(spark)}/cycle", F.lit("2024-01-20 00:00:00").cast("timestamp"), least=0.35)
    assert done["posts"].count() == done["vectors"].count() > 0
    n = done["members"].select("cluster_id").distinct().count()
    assert n == done["scores"].count() == done["phases"].count() == done["fingerprints"].count() > 0
    empty = cycle.run_cycle(p.limit(0), f"{storage.shared_dir(spark)}/cycle-empty", F.lit("2024-01-20 00:00:00").cast("timestamp"))
    assert all(t.count() == 0 for t in empty.values())
