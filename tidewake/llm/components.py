"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(``node``, ``component``): the least node reachable, for each node that has an edge and isn't the least itself.

    ``edges`` has two long columns, ``a`` and ``b``. Each round is stored in the shared folder, so lineages stay short and a lost executor
    costs one round at most. A node's minimum is pre-aggregated before each shuffle, and joins on a node can be split where it is hot.
    Nothing is collected but a count and a sum of hashes a round.
    """
    low_high = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stored(low_high.distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are stored, so that the joins with them have shuffles of their own on both sides and a hot node can be split
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # a node that is its neighbourhood's minimum keeps its edges above; the others hand theirs to the minimum and hold on to it
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = stored(large, "edges")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = seen
    raise RuntimeError("components did not settle")
