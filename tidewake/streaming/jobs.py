"""Structured Streaming forms: deduplicated ingest, windowed bursts, scored batches written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewake.functions import text as tx


def deduplicated(posts: DataFrame, ts: str = "published_at", content: str = "content", late: str = "48 hours") -> DataFrame:
    """The first of equal contents within the watermark: state is bounded by the 48 hours that clustering looks back."""
    return posts.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["content_hash"])


def relevant(posts: DataFrame, content: str = "content") -> DataFrame:
    return posts.where(tx.relevance(F.col(content)))


def window_counts(posts: DataFrame, key: str, ts: str = "published_at", width: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """(key, start, cnt) of tumbling windows; rows later than the watermark join no window."""
    return posts.withWatermark(ts, late).groupBy(key, F.window(ts, width)).agg(F.count("*").alias("cnt")).select(key, F.col("window.start").alias("start"), "cnt")


def session_counts(posts: DataFrame, key: str, ts: str = "published_at", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return posts.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("cnt")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "cnt")


def each_batch_once(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each micro-batch goes to a folder of its own id: a batch that runs again replaces its folder, so rows are written once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
