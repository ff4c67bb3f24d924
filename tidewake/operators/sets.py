"""Set operators over exploded (group, member, item) rows: similarity, concentration, continuity, counted terms, entropy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewake.operators import blocks
from tidewake.plans.storage import kept


def entropy(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, h, distinct values, rows): Shannon entropy in bits, by two partial aggregations."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    # sum of -p log2 p = log2 n - sum(c log2 c) / n, so no join back to the total is needed
    per = counts.groupBy(key).agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return per.select(key, F.greatest(F.lit(0.0), F.log2("n") - F.col("s") / F.col("n")).alias("h"), "k", "n")


def pair_overlap(items: DataFrame, a: str, b: str, group: tuple[str, ...], item: str, member: str, spread: int = 2000) -> DataFrame:
    """(group, a, b, shared, size_a, size_b) of members a < b that share an item; sizes are of distinct items.

    An item of over ``spread`` members has one side dealt into as many parts and the other repeated for each: many tasks share its pairs.
    """
    one = items.select(*group, member, item).distinct()
    sizes = one.groupBy(*group, member).agg(F.count("*").alias("size"))
    keys = [*group, item]
    hot = one.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > spread).select(*keys, F.ceil(F.col("n") / spread).cast("int").alias("parts"))
    dealt, parts = one.join(hot, keys, "left"), F.coalesce("parts", F.lit(1))
    left = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts").withColumnRenamed(member, a)
    right = dealt.withColumn("part", F.pmod(F.xxhash64(member), parts).cast("int")).drop("parts").withColumnRenamed(member, b)
    shared = left.join(right, [*keys, "part"]).where(F.col(a) < F.col(b)).groupBy(*group, a, b).agg(F.count("*").alias("shared"))
    for side in (a, b):
        shared = shared.join(sizes.withColumnRenamed(member, side).withColumnRenamed("size", f"size_{side}"), [*group, side])
    return shared


#: Members of a block of sets, pairs of a common item that are counted at once.
MEMBERS, PAIRS = 1024, 1 << 22


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many items each left set shares with each right one; sets hold small numbers. Bitmaps are multiplied if that is less work than items' pairs."""
    out = np.zeros((len(left), len(right)))
    if not len(left) or not len(right):
        return out
    (li, lx), (ri, rx) = ((np.repeat(np.arange(len(side)), [len(s) for s in side]), np.concatenate(side) if side else np.zeros(0, np.int64)) for side in (left, right))
    items = np.intersect1d(lx, rx)
    if not len(items):
        return out
    lk, rk = np.isin(lx, items), np.isin(rx, items)
    li, lx, ri, rx = li[lk], np.searchsorted(items, lx[lk]), ri[rk], np.searchsorted(items, rx[rk])
    lc, rc = np.bincount(lx, minlength=len(items)), np.bincount(rx, minlength=len(items))
    if len(left) * len(right) * len(items) / 64 < (lc * rc).sum():
        for at in range(0, len(items), 4096):
            wide = min(4096, len(items) - at)
            a, b = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
            for m, i, x in ((a, li, lx), (b, ri, rx)):
                here = (x >= at) & (x < at + wide)
                m[i[here], x[here] - at] = 1
            out += a @ b.T
        return out
    li, ri = li[np.argsort(lx, kind="stable")], ri[np.argsort(rx, kind="stable")]
    ls, rs = np.cumsum(lc) - lc, np.cumsum(rc) - rc
    ends = np.cumsum(lc * rc)
    at = 0
    while at < len(items):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        for k in range(at, to) if to - at < 64 else [slice(at, to)]:
            n, m, x, y = (np.atleast_1d(v[k]) for v in (lc, rc, ls, rs))
            each = np.repeat(np.arange(len(n)), n * m)
            place = np.arange(len(each)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
            codes = li[x[each] + place // m[each]] * len(right) + ri[y[each] + place % m[each]]
            out += np.bincount(codes, minlength=out.size).reshape(out.shape)
        at = to
    return out


def jaccard_sum(left: list[np.ndarray], right: list[np.ndarray], same: bool) -> float:
    """The sum of Jaccard similarities of all pairs across, or within (each pair once)."""
    shared = shared_counts(left, right)
    size = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right]) - shared
    j = np.divide(shared, size, out=np.zeros_like(shared), where=size > 0)
    return float(np.triu(j, 1).sum() if same else j.sum())


def mean_jaccard(items: DataFrame, group: str, member: str, item: str, block: int = MEMBERS) -> DataFrame:
    """(group, members, jaccard): the mean over all pairs of members' sets; pairs without a common item add nothing but count.

    A group's members are dealt into blocks, each of which is stored once; each pair of blocks is counted in one task, by products of bitmaps or by items'
    pairs, and only sums leave the task. Small groups share blocks. Null items belong to no set.
    """
    one = items.select(F.col(group).alias("g"), F.col(member).alias("m"), F.col(item).alias("i"))
    sets_ = one.groupBy("g", "m").agg(F.collect_set("i").alias("s"))
    sets_ = kept(sets_, "sets")
    sizes = sets_.groupBy("g").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / block).cast("int"))
    shared_by = F.when(F.col("n") <= block, F.pmod(F.xxhash64("g"), F.lit(max(1, -(-total // block)))).cast("long")).otherwise(F.xxhash64("g"))
    dealt = sets_.where(F.size("s") > 0).join(sizes, "g").select("g", "s", F.pmod(F.xxhash64("m"), parts).cast("int").alias("own"), shared_by.alias("task"), (parts > 1).alias("more"))
    kind = dealt.schema["g"].dataType
    name = to_arrow_type(kind)

    def coded(t: pa.Table) -> pa.Table:
        lists = t.column("s").combine_chunks()
        return pa.table({"g": t.column("g"), "s": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int32), lists.flatten().dictionary_encode())})

    def of_groups(t: pa.Table) -> tuple[pa.Array, dict[object, list[np.ndarray]]]:
        """The items, and each group's sets of places among these."""
        lists = t.column("s").chunk(0)
        own = np.split(lists.values.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()[1:-1])
        groups = t.column("g").chunk(0).dictionary_encode()
        by = groups.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(by, kind="stable")
        heads = np.flatnonzero(np.diff(by[order], prepend=-1))
        return lists.values.dictionary, {groups.dictionary[by[rows[0]]].as_py(): [own[k] for k in rows] for rows in np.split(order, heads[1:])}

    def summed(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), name), pa.array(list(found.values()), pa.float64())], ["g", "s"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                yield summed({g: jaccard_sum(own, own, True) for g, own in of_groups(blocks.unpacked(data))[1].items()})

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x_data"), batch.column("y_data")):
                (first, left), (second, right) = of_groups(blocks.unpacked(x)), of_groups(blocks.unpacked(y))
                both = pa.concat_arrays([first, second]).dictionary_encode().indices.to_numpy().astype(np.int64)
                code, other = both[: len(first)], both[len(first) :]
                yield summed({g: jaccard_sum([code[s] for s in left[g]], [other[s] for s in right[g]], False) for g in left if g in right})

    schema = f"g {kind.simpleString()}, s double"
    dealt = blocks.packed(dealt, ("task", "own", "more"), max(1, -(-total // block)), "blocks", coded)
    x, y = (blocks.side(dealt.where("more").drop("more"), n) for n in "xy")
    sums = dealt.select("data").mapInArrow(within, schema).unionByName(blocks.met(x, y, (F.col("x_task") == F.col("y_task")) & (F.col("x_own") < F.col("y_own"))).select("x_data", "y_data").mapInArrow(across, schema))
    sums = sums.groupBy("g").agg(F.sum("s").alias("s"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sizes.join(sums, "g", "left").select(F.col("g").alias(group), F.col("n").alias("members"), F.coalesce(F.try_divide(F.col("s"), pairs), F.lit(0.0)).alias("jaccard"))


def top_terms(terms: DataFrame, key: str, term: str, k: int) -> DataFrame:
    """(key, term, cnt, rank): the k most counted terms, ties by value."""
    counts = terms.groupBy(key, term).agg(F.count("*").alias("cnt"))
    w = Window.partitionBy(key).orderBy(F.desc("cnt"), term)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def concentration(posts: DataFrame, entities: DataFrame, key: str, member: str, entity: str) -> DataFrame:
    """(key, concentration, shared): how far few entities dominate a group's posts.

    Under 30 % of posts with entities, or under three such posts: (0.5, 0). Else 0.6 of the top entity's share of the sets and 0.4 of the
    count of entities in at least a fifth of all sets, three of which are enough.
    """
    one = entities.select(key, member, entity).distinct()
    n = posts.groupBy(key).agg(F.count_distinct(member).alias("n"))
    sets = one.groupBy(key).agg(F.count_distinct(member).alias("sets"))
    counts = one.groupBy(key, entity).agg(F.count("*").alias("c")).join(sets, key)
    per = counts.groupBy(key).agg(F.max(F.col("c") / F.col("sets")).alias("top"), F.count_if(F.col("c") >= 0.20 * F.col("sets")).alias("shared"), F.first("sets").alias("sets"))
    enough = (F.col("sets") >= 3) & (F.col("sets") >= 0.30 * F.col("n"))
    joined = n.join(per, key, "left")
    value = F.col("top") * 0.6 + F.least(F.lit(1.0), F.col("shared") / 3) * 0.4
    return joined.select(key, F.when(enough, value).otherwise(0.5).alias("concentration"), F.when(enough, F.col("shared")).otherwise(0).alias("shared"))


def continuity(posts: DataFrame, entities: DataFrame, key: str, member: str, entity: str, generic: list[str], k: int = 3) -> DataFrame:
    """(key, continuity): the share of posts that touch one of the group's k most counted entities, generic ones aside."""
    one = entities.select(key, member, entity).distinct().where(~F.col(entity).isin(generic))
    top = top_terms(one, key, entity, k).select(key, entity)
    touched = one.join(top, [key, entity], "left_semi").groupBy(key).agg(F.count_distinct(member).alias("t"))
    n = posts.groupBy(key).agg(F.count_distinct(member).alias("n"))
    return n.join(touched, key, "left").select(key, (F.coalesce("t", F.lit(0)) / F.col("n")).alias("continuity"))


def pmi_pairs(entities: DataFrame, member: str, entity: str, k: int = 30) -> DataFrame:
    """(x, y, c, pmi): pointwise mutual information of the k most counted entities, over members."""
    one = entities.select(member, entity).distinct()
    n = one.agg(F.count_distinct(member).alias("n"))
    counts = one.groupBy(entity).agg(F.count("*").alias("c")).orderBy(F.desc("c"), entity).limit(k)
    few = one.join(F.broadcast(counts), entity)  # k rows
    x, y = few.select(member, F.col(entity).alias("x"), F.col("c").alias("cx")), few.select(member, F.col(entity).alias("y"), F.col("c").alias("cy"))
    both = x.join(y, member).where("x < y").groupBy("x", "y").agg(F.count("*").alias("c"), F.first("cx").alias("cx"), F.first("cy").alias("cy"))
    return both.crossJoin(F.broadcast(n)).select("x", "y", "c", F.ln(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy"))).alias("pmi"))  # n: one row
