"""Tables by generations: whole old or whole new rows, failed and overtaken writes, appends, clean-up."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidewake.sources import generations


@pytest.fixture
def table(tmp_path):
    return f"file://{tmp_path}/t"


def values(spark, table):
    return sorted(r.id for r in generations.read(spark, table).collect())


def test_readers_follow_the_manifest(spark, table):
    """A frame planned before a write still gives the old rows whole; one planned after gives the new."""
    generations.write(spark.range(10).repartition(3), table)
    before = generations.read(spark, table)
    assert before.count() == 10
    generations.write(generations.read(spark, table).where("id >= 5"), table)  # a table may be rebuilt from itself
    assert values(spark, table) == [5, 6, 7, 8, 9]
    generations.write(spark.range(100, 102), table, "append")
    assert values(spark, table) == [5, 6, 7, 8, 9, 100, 101]
    generations.write(spark.range(0), table)
    assert values(spark, table) == []


def test_a_failed_write_leaves_nothing(spark, table):
    generations.write(spark.range(3), table)
    files = set(glob.glob(table[7:] + "/**/*", recursive=True))
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        generations.write(bad, table)
    assert values(spark, table) == [0, 1, 2] and set(glob.glob(table[7:] + "/**/*", recursive=True)) == files


def test_an_overtaken_write_fails(spark, table):
    generations.write(spark.range(3), table)
    late = generations.GenerationWriter(table, spark.range(1).schema, True)
    generations.write(spark.range(4), table)
    with pytest.raises(RuntimeError, match="came first"):
        late.commit([])
    assert values(spark, table) == [0, 1, 2, 3]


def test_other_columns_and_missing_tables(spark, table):
    with pytest.raises(Exception, match="no table"):
        generations.read(spark, table)
    generations.write(spark.range(3), table)
    with pytest.raises(Exception, match="other columns"):
        generations.write(spark.range(3).withColumn("x", F.lit(1)), table, "append")


def test_sweep(spark, table):
    for n in (3, 4, 5):
        generations.write(spark.range(n), table)
    generations.write(spark.range(50, 51), table, "append")
    path = table[7:]
    os.makedirs(f"{path}/generation=killed")
    open(f"{path}/generation=killed/x.parquet", "w").close()  # a write that never committed
    assert generations.sweep(table) == []  # too young
    gone = generations.sweep(table, older_than=-1)
    assert "generation=killed/x.parquet" in gone and values(spark, table) == [0, 1, 2, 3, 4, 50]
    live = generations.manifest(table)
    assert sorted(os.path.relpath(f, path) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)) == live["files"] and len(glob.glob(f"{path}/generation=*")) == 2
