"""Edges that hold the spanning trees of all rows by mutual reachability, from two looks at all pairs.

The first look finds each row's ``most`` nearest others. Their edges, joined to one tree by edges to some sampled rows, bound every other pair:
in a merge tree's order of rows the heaviest edge between two rows is the heaviest merge between their places, so a pair of blocks has a bound
for each row on either side. The second look keeps only pairs that come before their bound. Both multiply bounded matrices, in single precision
first for unit vectors, and test what is near enough again in double.

Why one tree serves all sizes: pairs at or beyond both rows' ``most``-th distances weigh their distance whatever the size, others are among
the nearest and weigh most by the largest size; so what a path outweighs by the largest size, it outweighs by each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewake.operators import hierarchy, vectors
from tidewake.operators.components import components
from tidewake.operators.relational import top_per_key
from tidewake.plans.storage import kept

#: Rows of a block at most, rows of a side of distances held at once, cells so, pairs measured at once, rows that bound a block's neighbours at first, sampled rows of a shard that join parts.
BLOCK, TILE, CELLS, PAIRS, FEW, SAMPLE = 1 << 15, 1 << 11, 1 << 21, 1 << 18, 2048, 2048


def matrix(column: pa.ChunkedArray, metric: str) -> np.ndarray:
    x = vectors._matrix(column)
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-10)[:, None] if metric == "cosine" else x


def measured(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows to the rows in the same place, as ``clustering.distances`` has them."""
    s = (x**2).sum(1) + (y**2).sum(1) - 2 * np.einsum("ij,ij->i", x, y)
    return np.sqrt(np.round(np.maximum(0, s), 12))


def within(left: np.ndarray, right: np.ndarray, by_left: np.ndarray, by_right: np.ndarray, single: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of at least all pairs of rows that are no farther apart than either row's bound, some at a time."""
    kind = np.float32 if single else np.float64
    p, q = (left**2).sum(1), (right**2).sum(1)
    margin = 2 * vectors.SINGLE if single else 1e-11 * (1 + p.max(initial=0) + q.max(initial=0))
    a = np.column_stack([left, p, np.ones(len(p))]).astype(kind)
    b = np.column_stack([-2 * right, np.ones(len(q)), q]).astype(kind).T.copy()
    low, high = ((by * np.abs(by) + margin).astype(kind) for by in (by_left, by_right))  # under 0: nothing is within it
    for at in range(0, len(left), TILE):
        for to in range(0, len(right), TILE):
            s = a[at : at + TILE] @ b[:, to : to + TILE]
            near = s <= low[at : at + TILE, None]
            near |= s <= high[to : to + TILE]
            flat = _places(near)
            for some in range(0, len(flat), PAIRS):
                i, j = np.divmod(flat[some : some + PAIRS], near.shape[1])
                i, j = i + at, j + to
                yield i, j, measured(left[i], right[j])


def _places(near: np.ndarray) -> np.ndarray:
    """Places of the few that are true, looked for eight at once."""
    flat = near.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    row, bit = np.nonzero(flat.reshape(-1, 8)[words])
    return words[row] * 8 + bit


class Nearest:
    """The ``most`` nearest others of each row, ties to the smaller ``other``, of pairs that come in parts."""

    def __init__(self, most: int):
        self.most, self.parts, self.held, self.upto = most, [], 0, 1 << 21

    def add(self, row: np.ndarray, other: np.ndarray, d: np.ndarray) -> None:
        self.parts.append((row, other, d))
        self.held += len(row)
        if self.held > self.upto:
            self.parts = [self.first()]
            self.held = len(self.parts[0][0])
            self.upto = max(1 << 21, 2 * self.held)

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, other, d = (np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((other, d, row))
        row, other, d = row[order], other[order], d[order]
        new = np.flatnonzero(np.diff(row, prepend=-1))
        keep = np.arange(len(row)) - np.repeat(new, np.diff(new, append=len(row))) < self.most
        return row[keep], other[keep], d[keep]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (shard, blocks, own, ...) for each pair x <= y of blocks that theirs is in."""
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("x"), F.greatest(i, F.col("own")).alias("y")))
    return rows.withColumn("cell", F.explode(cells)).select("*", "cell.x", "cell.y").drop("cell")


def _sides(group: pa.Table, by: str) -> tuple[pa.Table, np.ndarray, np.ndarray, bool]:
    group = group.take(pc.sort_indices(group, [(by, "ascending")]))
    own, x, y = group.column("own").to_numpy(), group.column("x")[0].as_py(), group.column("y")[0].as_py()
    return group, np.flatnonzero(own == x), np.flatnonzero(own == y), x == y


def _tasks(dealt: DataFrame, pairs: int):
    return dealt.repartition(max(1, min(4096, pairs)), "shard", "x", "y").groupBy("shard", "x", "y")


def nearest(rows: DataFrame, most: int, metric: str, pairs: int) -> DataFrame:
    """(shard, k, others, near) of each row's nearest others and their distances, in order. ``rows``: shard, k, v, blocks, own; ``pairs`` of blocks."""
    kind, name = rows.schema["k"].dataType.simpleString(), to_arrow_type(rows.schema["k"].dataType)
    flat = f"shard string, k {kind}, other {kind}, d double"

    def table(shard: str, keys: pa.ChunkedArray, row: np.ndarray, other: np.ndarray, d: np.ndarray) -> pa.Table:
        keys = keys.combine_chunks()
        return pa.table({"shard": pa.array([shard] * len(row), pa.string()), "k": keys.take(pa.array(row)).cast(name), "other": keys.take(pa.array(other)).cast(name), "d": pa.array(d)})

    def inside(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("k", "ascending")]))
        x = matrix(group.column("v"), metric)
        some = x[np.linspace(0, len(x) - 1, min(len(x), FEW)).astype(int)]
        bound = np.full(len(x), np.inf)
        if len(some) > most:  # itself may be one of them
            step = max(1, CELLS // len(some))
            p, q = (x**2).sum(1), (some**2).sum(1)
            for at in range(0, len(x), step):
                s = p[at : at + step, None] + q - 2 * x[at : at + step] @ some.T
                bound[at : at + step] = np.sqrt(np.maximum(0, np.partition(s, most, 1)[:, most]) + 1e-9)
        out = Nearest(most)
        for i, j, d in within(x, x, bound, np.full(len(x), -1.0) if np.isfinite(bound).all() else bound, metric == "cosine"):
            fine = i != j
            out.add(i[fine], j[fine], d[fine])
        return table(group.column("shard")[0].as_py(), group.column("k"), *out.first())

    def across(group: pa.Table) -> pa.Table:
        group, left, right, _ = _sides(group, "k")
        x, bound = matrix(group.column("v"), metric), group.column("bound").to_numpy()
        out = Nearest(most)
        for i, j, d in within(x[left], x[right], bound[left], bound[right], metric == "cosine"):
            i, j = left[i], right[j]
            for a, b in ((i, j), (j, i)):
                fine = d <= bound[a]
                out.add(a[fine], b[fine], d[fine])
        return table(group.column("shard")[0].as_py(), group.column("k"), *out.first())

    def first(group: pa.Table) -> pa.Table:
        group = group.sort_by([("shard", "ascending"), ("k", "ascending"), ("d", "ascending"), ("other", "ascending")])
        n = group.num_rows
        same = np.zeros(n, bool)
        if n > 1:
            same[1:] = np.logical_and(*(pc.equal(group.column(c).slice(1), group.column(c).slice(0, n - 1)).to_numpy() for c in ("shard", "k")))
        new = np.flatnonzero(~same)
        count = np.diff(new, append=n)
        keep = np.flatnonzero(np.arange(n) - np.repeat(new, count) < most)
        starts = np.concatenate([[0], np.cumsum(np.minimum(count, most))]).astype(np.int32)
        kept_, heads = group.take(pa.array(keep)), group.take(pa.array(new))
        lists = {c: pa.ListArray.from_arrays(pa.array(starts), kept_.column(n).combine_chunks()) for c, n in (("others", "other"), ("near", "d"))}
        return pa.table({"shard": heads.column("shard"), "k": heads.column("k"), **lists})

    def reduced(found: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("shard", "k"), F.lit(max(1, min(4096, 4 * pairs))))
        return kept(found.groupBy(part.alias("part")).applyInArrow(first, f"shard string, k {kind}, others array<{kind}>, near array<double>"), "nearest")

    own = kept(rows.groupBy("shard", "own").applyInArrow(inside, flat), "nearest")
    bound = own.groupBy("shard", "k").agg(F.when(F.count("*") >= most, F.max("d")).otherwise(float("inf")).alias("bound"))
    bounded = kept(rows.join(bound, ["shard", "k"], "left").fillna(float("inf"), ["bound"]), "bounded")
    return reduced(own.unionByName(_tasks(_dealt(bounded).where("x <> y"), pairs).applyInArrow(across, flat)))


def parts_of(edges: DataFrame, most: int) -> DataFrame:
    """(shard, k, c): the component of each end of ``edges`` (shard, a, b), by its least; a task for a shard of at most ``most`` edges, else rounds."""
    kind, name = edges.schema["a"].dataType.simpleString(), to_arrow_type(edges.schema["a"].dataType)
    per = kept(edges.groupBy("shard").agg(F.count("*").alias("m")), "sizes")

    def run(group: pa.Table) -> pa.Table:
        names, codes = np.unique(np.concatenate([group.column(c).to_numpy(zero_copy_only=False) for c in "ab"]), return_inverse=True)
        up = list(range(len(names)))
        for i, j in zip(codes[: group.num_rows].tolist(), codes[group.num_rows :].tolist()):
            while up[i] != i:
                up[i] = i = up[up[i]]
            while up[j] != j:
                up[j] = j = up[up[j]]
            up[max(i, j)] = min(i, j)
        top = np.array(up)
        while (top != (far := top[top])).any():
            top = far
        keys = pa.array(names).cast(name)
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()] * len(names), pa.string()), "k": keys, "c": keys.take(pa.array(top))})

    few = edges.join(per.where(F.col("m") <= most), "shard", "left_semi").groupBy("shard").applyInArrow(run, f"shard string, k {kind}, c {kind}")
    many = per.where(F.col("m") > most).select("shard")
    if many.isEmpty():
        return few
    node = lambda c: F.struct("shard", F.col(c).alias("k"))
    found = components(edges.join(many, "shard").select(node("a").alias("p"), node("b").alias("q")), "p", "q")
    return few.unionByName(found.select("node.shard", "node.k", F.col("component.k").alias("c")))


def bridges(rows: DataFrame, edges: DataFrame, metric: str, most: int) -> DataFrame:
    """(shard, a, b, d): edges that join each shard's components to one, found among a sample of its rows. ``rows``: shard, k, v, core, own; ``edges``: shard, a, b."""
    kind, name = rows.schema["k"].dataType.simpleString(), to_arrow_type(rows.schema["k"].dataType)
    label = kept(parts_of(edges, most), "parts")
    out = None

    def run(mine: pa.Table, some: pa.Table) -> pa.Table:
        rows_ = []
        if mine.num_rows and some.num_rows:
            c, codes = np.unique(np.concatenate([t.column("c").to_numpy(zero_copy_only=False) for t in (mine, some)]), return_inverse=True)
            of, to = codes[: mine.num_rows], codes[mine.num_rows :]
            x, y = (matrix(t.column("v"), metric) for t in (mine, some))
            r, s = (t.column("core").to_numpy() for t in (mine, some))
            step = max(1, CELLS // len(y))
            best, w = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
            for at in range(0, len(x), step):
                d = (x[at : at + step] ** 2).sum(1)[:, None] + (y**2).sum(1) - 2 * x[at : at + step] @ y.T
                d = np.maximum(np.sqrt(np.maximum(0, d)), np.maximum(r[at : at + step, None], s))
                d[of[at : at + step, None] == to] = np.inf
                best[at : at + step] = d.argmin(1)
                w[at : at + step] = d.min(1)
            order = np.lexsort((w, of))
            order = order[np.flatnonzero(np.diff(of[order], prepend=-1))]
            order = order[np.isfinite(w[order])]
            d = measured(x[order], y[best[order]])
            keys = [t.column("k").to_pylist() for t in (mine, some)]
            rows_ = [(mine.column("shard")[0].as_py(), c[of[i]], c[to[best[i]]], keys[0][i], keys[1][best[i]], float(w[i]), float(e)) for i, e in zip(order.tolist(), d)]
        kinds = (pa.string(), name, name, name, name, pa.float64(), pa.float64())
        return pa.table({n: pa.array([r[k] for r in rows_], t) for k, (n, t) in enumerate(zip(("shard", "c", "to", "k", "other", "w", "d"), kinds))})

    while True:
        open_ = kept(label.groupBy("shard").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("shard"), "open")
        if open_.isEmpty():
            return out if out is not None else edges.select("shard", "a", "b", F.lit(0.0).alias("d")).limit(0)
        here = kept(rows.join(open_, "shard", "left_semi").join(label, ["shard", "k"]).select("shard", "own", "k", "v", "core", "c"), "apart")
        some = kept(top_per_key(here.withColumn("h", F.xxhash64("k")), "shard", SAMPLE, F.col("h"), F.col("k")).drop("h", "own"), "sample")
        to_all = kept(some.join(here.select("shard", "own").distinct(), "shard"), "sample")
        near = here.groupBy("shard", "own").cogroup(to_all.groupBy("shard", "own")).applyInArrow(run, f"shard string, c {kind}, to {kind}, k {kind}, other {kind}, w double, d double")
        best = kept(near.groupBy("shard", "c").agg(F.min_by(F.struct("to", "k", "other", "d"), F.struct("w", "k", "other")).alias("m")).select("shard", "c", "m.*"), "bridges")
        new = best.select("shard", F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b"), "d")
        out = new if out is None else out.unionByName(new)
        far = parts_of(best.select("shard", F.col("c").alias("a"), F.col("to").alias("b")), most).select("shard", F.col("k").alias("c"), F.col("c").alias("next"))
        label = kept(label.join(far, ["shard", "c"], "left").select("shard", "k", F.coalesce("next", "c").alias("c")), "parts")


def placed(tree: DataFrame, points: DataFrame, most: int) -> DataFrame:
    """(g, k, at, w, a, b) of each point: its place in the order of its tree's merges, and the merge before it (none: the first).

    ``tree``: g, a, b, w, a spanning tree of each graph's ``points`` (g, k). The larger side of a merge comes first, so the heaviest edge
    between two points is the heaviest merge after the one's place up to the other's.
    """
    halves = hierarchy.halved(tree.withColumn("size", F.lit(1)), most)
    kind, name = points.schema["k"].dataType.simpleString(), to_arrow_type(points.schema["k"].dataType)

    def order(group: pa.Table) -> pa.Table:
        e = group.column("e").combine_chunks()
        e = e.chunk(0) if isinstance(e, pa.ChunkedArray) else e
        t = pa.table({c: e.field(c) for c in "wab"} | {c: group.column(c) for c in ("x", "y", "nx", "ny")}).sort_by([(c, "ascending") for c in "wab"])
        names, codes = np.unique(np.concatenate([t.column(c).to_numpy(zero_copy_only=False) for c in "xy"]), return_inverse=True)
        x, y = codes[: t.num_rows], codes[t.num_rows :]
        size = np.zeros(len(names), np.int64)
        size[x], size[y] = t.column("nx").to_numpy(), t.column("ny").to_numpy()
        up, held, head, tail = list(range(len(names))), size.tolist(), list(range(len(names))), list(range(len(names)))
        after, before = [-1] * len(names), [-1] * len(names)

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
            i, j = root(i), root(j)
            if held[i] < held[j]:
                i, j = j, i
            up[j] = i
            held[i] += held[j]
            after[tail[i]], before[head[j]], tail[i] = head[j], k, tail[j]
        at, place, offset = head[root(0)], np.zeros(len(names), np.int64), 0
        while at >= 0:
            place[at] = offset
            offset += int(size[at])
            at = after[at]
        merge = pa.array(np.array(before), mask=np.array(before) < 0)
        g, p = (group.column(c)[0].as_py() for c in ("g", "p"))
        out = {"g": pa.array([g] * len(names), pa.string()), "name": pa.array(names.tolist(), pa.string()), "p": pa.array([p] * len(names), pa.string()), "at": pa.array(place)}
        return pa.table(out | {c: t.column(c).take(merge).cast(pa.float64() if c == "w" else name) for c in "wab"})

    all_ = kept(halves.groupBy("p").applyInArrow(order, f"g string, name string, p string, at long, w double, a {kind}, b {kind}"), "order")
    while not all_.where("p <> g").isEmpty():
        over = all_.select("g", F.col("name").alias("p"), F.col("p").alias("next"), F.col("at").alias("more"))
        all_ = kept(all_.join(over, ["g", "p"], "left").select("g", "name", F.coalesce("next", "p").alias("p"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"), "w", "a", "b"), "order")
    named = points.select("g", "k", F.concat("g", F.lit("\u0001"), F.col("k").cast("string")).alias("name"))
    return named.join(all_.select("g", "name", "at"), ["g", "name"]).drop("name").join(all_.where("w is not null").select("g", "at", "w", "a", "b"), ["g", "at"], "left").select("g", "k", "at", "w", "a", "b")


def before_bounds(rows: DataFrame, metric: str, pairs: int) -> DataFrame:
    """(shard, a, b, d) of pairs that come before the heaviest edge between them in the tree whose order ``rows`` are in: by the greater of
    distance and both cores, then keys. ``rows``: shard, k, v, core, at, w, a, b, blocks, own (by place)."""
    kind, name = rows.schema["k"].dataType.simpleString(), to_arrow_type(rows.schema["k"].dataType)
    heaviest = kept(rows.groupBy("shard", "own").agg(F.max(F.struct("w", "a", "b")).alias("m")), "heaviest")
    x, y = (heaviest.select("shard", F.col("own").alias(c)) for c in "xy")
    between = heaviest.select("shard", "own", "m")
    mid = x.join(y, "shard").where("x < y").join(between, "shard").where("x < own AND own < y").groupBy("shard", "x", "y").agg(F.max("m").alias("m"))
    mid = kept(mid.select("shard", "x", "y", F.col("m.w").alias("mw"), F.col("m.a").alias("ma"), F.col("m.b").alias("mb")), "between")
    dealt = _dealt(rows).join(mid, ["shard", "x", "y"], "left")

    def run(group: pa.Table) -> pa.Table:
        group, left, right, one = _sides(group, "at")
        n = group.num_rows
        x, core = matrix(group.column("v"), metric), group.column("core").to_numpy()
        values = lambda c: group.column(c).to_numpy(zero_copy_only=False)
        has = np.asarray(group.column("w").is_valid())
        filled = lambda c, k: pc.if_else(group.column(c).is_valid(), group.column(c), group.column(k)).to_numpy(zero_copy_only=False)
        named, codes = np.unique(np.concatenate([values("k"), filled("a", "k"), filled("b", "k"), filled("ma", "k")[:1], filled("mb", "k")[:1]]), return_inverse=True)
        key, a, b = codes[:n], np.append(codes[n : 2 * n], codes[3 * n]), np.append(codes[2 * n : 3 * n], codes[3 * n + 1])
        mw = group.column("mw")[0].as_py()
        w = np.append(np.where(has, pc.fill_null(group.column("w"), 0.0).to_numpy(), -1.0), -1.0 if mw is None else mw)
        by_rank = np.lexsort((b, a, w))
        rank = np.empty(n + 1, np.int64)
        rank[by_rank] = np.arange(n + 1)
        w, a, b = w[by_rank], a[by_rank], b[by_rank]  # by rank from here
        out = []

        def across(i: np.ndarray, j: np.ndarray, least: int) -> None:
            after = np.append(rank[i[1:]], least)
            s, t = np.maximum(np.maximum.accumulate(after[::-1])[::-1], least), np.maximum.accumulate(rank[j])
            for p, q, d in within(x[i], x[j], np.maximum(w[s], 0), np.maximum(w[t], 0), metric == "cosine"):
                r, p, q = np.maximum(s[p], t[q]), i[p], j[q]
                e, lo, hi = np.maximum(d, np.maximum(core[p], core[q])), np.minimum(key[p], key[q]), np.maximum(key[p], key[q])
                fine = (e < w[r]) | ((e == w[r]) & ((lo < a[r]) | ((lo == a[r]) & (hi < b[r]))))
                if fine.any():
                    out.append((lo[fine], hi[fine], d[fine]))

        def inside(i: np.ndarray) -> None:
            if len(i) > 1:
                half = len(i) // 2
                across(i[:half], i[half:], 0)
                inside(i[:half])
                inside(i[half:])

        if one:
            inside(left)
        elif len(left) and len(right):
            across(left, right, int(rank[n]))
        lo, hi, d = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        keys = pa.array(named.tolist(), name) if not pa.types.is_temporal(name) else pa.array(named).cast(name)
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()] * len(lo), pa.string()), "a": keys.take(pa.array(lo)), "b": keys.take(pa.array(hi)), "d": pa.array(d)})

    return _tasks(dealt, pairs).applyInArrow(run, f"shard string, a {kind}, b {kind}, d double")
