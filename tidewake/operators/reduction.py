"""Fewer dimensions that keep neighbourhoods: neighbours by descent, fuzzy weights, a layout by attraction and repulsion in blocks.

Nearest neighbours start as those in a row's own block and get better in rounds: a neighbour's neighbour is likely a neighbour. Distances become
weights by each row's own scale. The layout pulls neighbours together and pushes sampled others apart; in an outer round each block is one task
that moves its own rows for some epochs while neighbours elsewhere, and a bounded sample of all rows, stand still.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewake.operators.vectors import _matrix, angular_blocks
from tidewake.plans.storage import kept

#: Rows of a block, rounds of descent at most, share of changed neighbours that ends them, rows that repel all blocks, negatives an edge.
BLOCK, DESCENTS, FEW, SAMPLE, NEGATIVES = 2048, 8, 0.005, 1024, 5
#: Rows (of the lowest hashes) whose leading axes the layout starts from; rows whose neighbours' cosines are held at once.
FITTED, CENTRES = 4096, 512


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    v = _matrix(column)
    return v / np.maximum(np.linalg.norm(v, axis=1), 1e-10)[:, None]


def neighbours(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(k, other, d): each row's ``k`` nearest others by cosine distance, ties to the smaller. ``rows``: k, v (unique keys).

    Exact in one block. Else approximate: rounds of descent take the neighbours of a row's neighbours and of the rows that it is a neighbour of (of
    each row the ``k`` nearest such), until fewer than ``FEW`` of all neighbours change.
    """
    placed, _ = angular_blocks(rows.select("k", "v"), block)
    kind, name = placed.schema["k"].dataType.simpleString(), to_arrow_type(placed.schema["k"].dataType)

    def within(group: pa.Table) -> pa.Table:
        group = group.sort_by("k")
        v = _unit(group.column("v"))
        d = np.round(1 - v @ v.T, 9)
        np.fill_diagonal(d, np.inf)
        m = min(k, len(v) - 1)
        near = np.argsort(d, 1, kind="stable")[:, :m]
        at = np.repeat(np.arange(len(v)), m)
        keys = group.column("k").combine_chunks()
        return pa.table({"k": keys.take(pa.array(at)).cast(name), "other": keys.take(pa.array(near.ravel())).cast(name), "d": pa.array(np.take_along_axis(d, near, 1).ravel())})

    found = kept(placed.select("own", "k", "v").groupBy("own").applyInArrow(within, f"k {kind}, other {kind}, d double"), "neighbours")
    if placed.select("own").distinct().count() <= 1:
        return found
    nearest = lambda df, by: df.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("d", "other" if by == "k" else "k"))).where(F.col("r") <= k).drop("r")
    n = rows.count()
    # small blocks, and rows whose neighbours are all in their own: pairs by hash as well
    start = rows.select("k", F.pmod(F.xxhash64("k"), F.lit(max(1, n // (k + 1)))).alias("h"))
    loose = start.join(start.withColumnRenamed("k", "other"), "h").where("k < other").select("k", "other")
    v = placed.select("k", "v")
    joined = loose.join(v.withColumnRenamed("v", "x"), "k").join(v.select(F.col("k").alias("other"), F.col("v").alias("y")), "other")

    def distance(batches):
        for b in batches:
            d = np.round(1 - (_unit(b.column("x")) * _unit(b.column("y"))).sum(1), 9)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("other"), pa.array(d)], ["k", "other", "d"])

    def better(found: DataFrame, more: DataFrame) -> DataFrame:
        """The nearest of both; ``new`` are those that weren't found before."""
        all_ = found.select("k", "other", "d", F.lit(False).alias("new")).unionByName(more.select("k", "other", "d", F.lit(True).alias("new")))
        return kept(nearest(all_.groupBy("k", "other").agg(F.min("d").alias("d"), F.min("new").alias("new")), "k"), "neighbours")

    def around(links: pa.Table, others: pa.Table) -> pa.Table:
        """Pairs among each row's neighbours, of which one is new, that are nearer than the last neighbour of either."""
        if not links.num_rows or not others.num_rows:
            return pa.table({"k": pa.array([], name), "other": pa.array([], name), "d": pa.array([], pa.float64())})
        others = others.sort_by("to")
        keys, u = others.column("to").combine_chunks(), _unit(others.column("v"))
        bound = others.column("bound").to_numpy()
        last = pc.fill_null(pc.index_in(others.column("last"), value_set=keys), -1).to_numpy()
        # a last neighbour that isn't here: ties with it are handed out and settled later
        last = np.where(last < 0, len(keys), last)
        centre, to, new = links.column("k").combine_chunks().dictionary_encode().indices.to_numpy(), pc.index_in(links.column("other"), value_set=keys).to_numpy(), links.column("new").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((to, centre))
        centre, to, new = centre[order], to[order], new[order]
        first = np.flatnonzero(np.diff(centre, prepend=-1))
        count = np.diff(first, append=len(centre))
        place = np.arange(len(centre)) - np.repeat(first, count)
        wide = int(count.max())
        idx, fresh = np.full((len(first), wide), -1, np.int64), np.zeros((len(first), wide), bool)
        idx[centre, place], fresh[centre, place] = to, new
        p, q = np.triu_indices(wide, 1)
        pairs, ds = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(idx), CENTRES):
            some, f = idx[at : at + CENTRES], fresh[at : at + CENTRES]
            c, e = np.nonzero((some[:, p] >= 0) & (some[:, q] >= 0) & (f[:, p] | f[:, q]))
            if not len(c):
                continue
            w = u[np.maximum(some, 0)]
            d = np.round(1 - np.matmul(w, w.transpose(0, 2, 1))[c, p[e], q[e]], 9)
            x, y = some[c, p[e]], some[c, q[e]]  # x < y: neighbours are in order
            close = (d < bound[x]) | ((d == bound[x]) & (y < last[x])) | (d < bound[y]) | ((d == bound[y]) & (x < last[y]))
            pairs, at_ = np.unique(np.concatenate([pairs, x[close] * len(keys) + y[close]]), return_index=True)
            ds = np.concatenate([ds, d[close]])[at_]
        x, y = np.divmod(pairs, max(1, len(keys)))
        x, y, d = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([ds, ds])
        fine = (d < bound[x]) | ((d == bound[x]) & (y < last[x]))
        x, y, d = x[fine], y[fine], d[fine]
        order = np.lexsort((y, d, x))
        x, y, d = x[order], y[order], d[order]
        first = np.flatnonzero(np.diff(x, prepend=-1))
        keep = np.arange(len(x)) - np.repeat(first, np.diff(first, append=len(x))) < k
        return pa.table({"k": keys.take(pa.array(x[keep])).cast(name), "other": keys.take(pa.array(y[keep])).cast(name), "d": pa.array(d[keep])})

    first = kept(joined.select("k", "other", "x", "y").mapInArrow(distance, f"k {kind}, other {kind}, d double"), "distances")
    found = better(found, first.unionByName(first.select(F.col("other").alias("k"), F.col("k").alias("other"), "d"))).withColumn("new", F.lit(True))
    own = placed.select("k", "own")
    for _ in range(DESCENTS):
        # a block's task gets the neighbours of its rows, and each of those rows' vectors once, however many of its rows they are near to
        back = nearest(found, "other").select(F.col("other").alias("k"), F.col("k").alias("other"), "new")
        links = found.select("k", "other", "new").unionByName(back).groupBy("k", "other").agg(F.max("new").alias("new"))
        links = kept(links.join(own, "k").select("own", "k", "other", "new"), "links")
        last = found.groupBy("k").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("bound"), F.max(F.struct("d", "other")).alias("m")).select(F.col("k").alias("other"), "bound", F.col("m.other").alias("last"))
        needed = links.select("own", "other").distinct().join(last, "other", "left").join(v.withColumnRenamed("k", "other"), "other").fillna(float("inf"), ["bound"]).select(F.col("own").alias("block"), F.col("other").alias("to"), "bound", "last", "v")
        near = links.groupBy("own").cogroup(needed.groupBy("block")).applyInArrow(around, f"k {kind}, other {kind}, d double")
        found = better(found, near)
        if found.where("new").count() <= FEW * k * n:
            break
    return found.select("k", "other", "d")


def fuzzy_weights(near: DataFrame) -> DataFrame:
    """(k, other, w), both ways: a row's nearest neighbour has weight 1, the others fall off by a scale at which all sum to log2 of their number; the two
    directions are joined as probabilities that aren't exclusive."""
    kind = near.schema["k"].dataType
    lists = near.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("d", "other"))).alias("s")).select("k", F.transform("s", lambda x: x["other"]).alias("other"), F.transform("s", lambda x: x["d"]).alias("d"))

    def weigh(batches):
        for b in batches:
            lists_ = b.column("d")
            sizes = np.asarray(lists_.value_lengths()).astype(np.int64)
            d = np.full((len(sizes), max(1, sizes.max(initial=0))), np.inf)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            d[row, place] = np.asarray(lists_.flatten())
            rest = np.maximum(0, d - d[:, :1])  # the nearest has weight 1
            goal, lo, hi = np.log2(np.maximum(2, sizes)), np.full(len(d), 1e-9), np.full(len(d), 1e3)
            for _ in range(64):
                mid = np.sqrt(lo * hi)
                high = np.exp(-rest / mid[:, None]).sum(1) > goal
                hi, lo = np.where(high, mid, hi), np.where(high, lo, mid)
            w = np.exp(-rest / np.sqrt(lo * hi)[:, None])[row, place]
            keys = b.column("k").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([keys, b.column("other").flatten(), pa.array(w)], ["k", "other", "w"])

    one = lists.mapInArrow(weigh, f"k {kind.simpleString()}, other {kind.simpleString()}, w double")
    pair = one.select(F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("s"), F.count("*").alias("c"), F.try_divide(F.sum("w") * F.sum("w") - F.sum(F.col("w") * F.col("w")), F.lit(2.0)).alias("p"))
    joined = pair.select("a", "b", F.round(F.col("s") - F.when(F.col("c") > 1, F.col("p")).otherwise(0.0), 9).alias("w"))
    return joined.select(F.col("a").alias("k"), F.col("b").alias("other"), "w").unionByName(joined.select(F.col("b").alias("k"), F.col("a").alias("other"), "w"))


def curve(min_dist: float) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^2b), the nearest to 1 up to ``min_dist`` and exp(min_dist - x) beyond (least squares)."""
    x = np.linspace(0.01, 3, 300)
    y = np.where(x < min_dist, 1, np.exp(min_dist - x))
    p = np.log([1.5, 0.9])
    for _ in range(100):
        a, b = np.exp(p)
        u = a * x ** (2 * b)
        f = 1 / (1 + u)
        j = np.stack([-f * f * u, -f * f * u * 2 * b * np.log(x)], 1)  # by the logarithms of a and b
        step = np.linalg.solve(j.T @ j + 1e-9 * np.eye(2), j.T @ (y - f))
        p = p + np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-10:
            break
    return float(np.exp(p[0])), float(np.exp(p[1]))


def move(at: np.ndarray, fixed: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, ab: tuple[float, float], rates: np.ndarray, rng: np.random.Generator, far: np.ndarray) -> np.ndarray:
    """Positions after an epoch for each rate. Edges go from row i to place j of ``at`` and ``fixed`` together; ``far`` are rows that repel all."""
    a, b = ab
    at, n, m = at.copy(), len(at), len(at) + len(fixed) + len(far)
    per, w = np.maximum(np.bincount(i, w, n) + 1e-12, 1)[:, None], w.astype(np.float32)
    every = np.concatenate([at, fixed, far]).astype(np.float32)
    for rate in rates:
        every[:n] = at  # forces in single precision, sums and positions in double
        mine = every[i]
        d = mine - every[j]
        s = (d * d).sum(1) + np.float32(1e-12)
        near = s ** np.float32(b)
        force = np.clip((-2 * a * near / s / (1 + a * near)).astype(np.float32)[:, None] * d, -4, 4) * 2
        for other in rng.integers(0, m, (NEGATIVES, len(i))):
            d = mine - every[other]
            s = (d * d).sum(1)
            push = (2 * b / ((np.float32(0.001) + s) * (1 + a * s ** np.float32(b)))).astype(np.float32)
            push[other == i] = 0
            force += np.clip(push[:, None] * d, -4, 4)
        force *= w[:, None]
        at += rate * np.stack([np.bincount(i, force[:, c], n) for c in range(at.shape[1])], 1) / per
    return at


def axes_of(v: np.ndarray, dims: int, spread: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """The middle of rows, and their leading axes, scaled so that rows spread by about ``spread``; axes that rows don't have are zero."""
    centre = v.mean(0)
    values, vectors = np.linalg.eigh((v - centre).T @ (v - centre))
    axes = np.zeros((v.shape[1], dims))
    m = min(dims, v.shape[1])
    axes[:, :m] = vectors[:, ::-1][:, :m]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(dims)] + 1e-300)  # either sign is an axis: take the one
    return centre, axes * spread / max(((v - centre) @ axes).std(), 1e-9) if values[-1] > 1e-9 else axes * 0


def reduce(df: DataFrame, key: str, vector: str, dims: int = 5, near: int = 15, min_dist: float = 0.0, seed: int = 42, epochs: int = 200, rounds: int = 10, block: int = BLOCK) -> DataFrame:
    """(key, reduced): rows in ``dims`` dimensions in which near rows (cosine) stay near.

    ``near`` neighbours each, fewer in a table of fewer rows. One block has all its epochs at once; several share them over ``rounds`` outer rounds,
    between which positions are stored. The layout starts from the leading axes of a bounded sample. Results depend on the seed, the keys and the
    vectors alone. Null vectors give no row. Keys must be unique.
    """
    single = df.schema[vector].dataType.elementType.simpleString() == "float"  # shipped as they are
    rows = kept(df.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), (F.col(vector) if single else F.transform(vector, lambda x: x.cast("double"))).alias("v")), "rows")
    kind, name = rows.schema["k"].dataType.simpleString(), to_arrow_type(rows.schema["k"].dataType)
    if rows.isEmpty():
        return rows.select(F.col("k").alias(key), F.lit(None).cast("array<double>").alias("reduced"))
    n = rows.count()
    weights = kept(fuzzy_weights(neighbours(rows, min(near, n - 1), block)) if n > 1 else rows.select("k", F.col("k").alias("other"), F.lit(0.0).alias("w")), "weights")
    placed, _ = angular_blocks(rows, block)
    own = kept(placed.select("k", "own"), "own")
    outer = 1 if n <= block else rounds
    ab = curve(min_dist)
    coin = lambda c: (F.pmod(F.xxhash64("k", F.lit(seed), F.lit(c)), F.lit(1 << 30)) / (1 << 30) - 0.5) * 0.1
    sample = _unit(placed.orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(FITTED).select("v").toArrow().column("v"))
    centre, axes = axes_of(sample, dims)

    def lists(at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dims), pa.array(np.ascontiguousarray(at).ravel()))

    def project(batches):
        for b in batches:
            at = np.round((_unit(b.column("v")) - centre) @ axes, 6)  # products differ in their last digits by the rows of a batch, and a layout by more
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("own"), lists(at)], ["k", "own", "p"])

    start = placed.select("k", "own", "v").mapInArrow(project, f"k {kind}, own string, p array<double>")
    pos = kept(start.select("k", "own", F.zip_with("p", F.array(*(coin(c) for c in range(dims))), lambda x, y: x + y).alias("p")), "positions")
    steps = np.linspace(1, 0, epochs, endpoint=False)
    def mover(k: int, far: np.ndarray):
        rates = steps[k * epochs // outer : (k + 1) * epochs // outer]
        def moved(mine: pa.Table, links: pa.Table) -> pa.Table:
            if not mine.num_rows:
                return pa.table({"k": pa.array([], name), "own": pa.array([], pa.string()), "p": pa.array([], pa.list_(pa.float64()))})
            mine = mine.sort_by("k")
            keys, own_ = mine.column("k").combine_chunks(), mine.column("own")[0].as_py()
            at = _matrix(mine.column("p"))
            if links.num_rows:
                links = links.sort_by([("a", "ascending"), ("b", "ascending")])
                i, j = pc.index_in(links.column("a"), value_set=keys).to_numpy(), pc.index_in(links.column("b"), value_set=keys)
                away = links.filter(j.is_null())  # positions elsewhere, each once
                names = away.column("b").unique()
                code = pc.index_in(away.column("b"), value_set=names).to_numpy()
                still = _matrix(away.column("q"))[np.unique(code, return_index=True)[1]] if len(code) else np.zeros((0, dims))
                j = pc.fill_null(j, -1).to_numpy().astype(np.int64)
                j[j < 0] = len(keys) + code
                rng = np.random.default_rng([seed, k, zlib.crc32(own_.encode())])
                at = move(at, still, i, j, links.column("w").to_numpy(), ab, rates, rng, far)
            return pa.table({"k": keys.cast(name), "own": pa.array([own_] * len(keys)), "p": lists(at)})

        return moved

    links = kept(weights.join(own, "k").select(F.col("own").alias("at"), F.col("k").alias("a"), F.col("other").alias("b"), "w"), "links")
    for k in range(outer):
        far = np.array([r.p for r in pos.orderBy(F.xxhash64("k", F.lit(seed + k)), "k").limit(SAMPLE).select("p").collect()], float) if outer > 1 else np.zeros((0, dims))
        edges = links.join(pos.select(F.col("k").alias("b"), F.col("p").alias("q")), "b").select("at", "a", "b", "w", "q")
        pos = kept(pos.groupBy("own").cogroup(edges.groupBy("at")).applyInArrow(mover(k, far), f"k {kind}, own string, p array<double>"), "positions")
    return pos.select(F.col("k").alias(key), F.col("p").alias("reduced"))
