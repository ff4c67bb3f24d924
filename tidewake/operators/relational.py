"""Latest rows, upserts, memberships, caps and lookups, each as one join or window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.plans.storage import kept


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order; Spark keeps one row a key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def upsert(old: DataFrame, new: DataFrame, key: str, mode: str = "replace") -> DataFrame:
    """``replace``: new rows win; ``ignore``: old rows win. Keys must be unique on each side: then an anti join and a union do it."""
    if mode == "ignore":
        old, new = new, old
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def dedup_content(posts: DataFrame, content: str, *order: Column) -> DataFrame:
    """The first writer of each content; the hash is made once, before the shuffle."""
    return latest(posts.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256)), "content_hash", *order)


def other_endpoint(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair seen from both ends: an equi-join on ``node`` instead of an OR."""
    rest = [c for c in pairs.columns if c not in (a, b)]
    return pairs.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest).unionByName(pairs.select(F.col(b).alias("node"), F.col(a).alias("other"), *rest))


def union_feeds(*feeds: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), feeds)


def registry_lookup(domains: DataFrame, domain: str, registry: DataFrame, default: tuple[str, float] = ("unknown", 0.50)) -> DataFrame:
    """category and score of the first registry fragment (by ``priority``) that the domain contains.

    Domains are made distinct first; the registry is a literal of fixed size, so it is broadcast.
    """
    names = domains.select(domain).distinct()
    hit = names.join(F.broadcast(registry), F.contains(F.col(domain), F.col("fragment"))).groupBy(domain).agg(F.min(F.struct("priority", "category", "score")).alias("hit"))
    scored = names.join(hit, domain, "left").select(domain, F.coalesce("hit.category", F.lit(default[0])).alias("category"), F.coalesce("hit.score", F.lit(default[1])).alias("score"))
    return domains.join(scored, domain, "left")


def unordered_pairs(df: DataFrame, key: str, block: int = 1024) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct keys. Keys are dealt into blocks; pairs of blocks are join keys, so the pairs are dealt evenly too."""
    keys = kept(df.select(F.col(key).alias("k")).where("k is not null").distinct(), "keys")
    blocks = max(1, -(-keys.count() // block))
    own = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.struct(F.least(i, own).alias("x"), F.greatest(i, own).alias("y")))
    dealt = keys.select("k", own.alias("own"), F.explode(cells).alias("cell")).select("k", "own", "cell.*")
    left, right = dealt.where("own = x").select(F.col("k").alias("j"), "x", "y"), dealt.where("own = y").select("k", "x", "y")
    return left.join(right, ["x", "y"]).where("x < y OR j < k").select(F.least("j", "k").alias("a"), F.greatest("j", "k").alias("b"))
