"""Where tables that jobs share live, and writing them safely."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and one machine does all."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def swapped(df: DataFrame, table: str) -> str:
    """Write a new generation of ``table`` beside the old ones and give its path: a path that is being read is never overwritten."""
    path = f"{table.rstrip('/')}/generation={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what several branches of a job read is computed once, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
