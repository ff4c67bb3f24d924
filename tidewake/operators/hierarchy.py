"""Density clusters of spanning trees that no task holds whole.

A minimum spanning forest comes from Boruvka rounds over stored edges. Its merges are then taken in order by halving: the edges under a cut form
components, which are independent of each other and are single vertices for the edges over the cut; so both halves are smaller
trees, which are halved again until each fits a task. A task merges its tree's vertices by weight and knows of a vertex only how
many points it holds: where it has enough to be a cluster, what happens to that cluster goes under the vertex's name, and names are
resolved by pointer jumping once all tasks are done. What is left is the tree of clusters, whose masses decide which are kept.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.operators.components import components
from tidewake.operators.relational import top_per_key
from tidewake.plans.storage import kept

#: Edges, or clusters, that one task takes; edges of which a cut is the median.
MOST, SAMPLE = 1 << 21, 501
#: Masses this close (relative) are equal.
CLOSE = 1e-9
ROW = "g string, size int, kind string, name string, to string, mass double, n long, birth double"


def level(w: float) -> float:
    return 1 / w if w > 0 else 1e12


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(g, a, b, w) of each graph's minimum spanning forest; equal weights go by a, then b. Every round takes each component's first edge out."""
    cur = kept(edges.select("g", F.col("a").alias("x"), F.col("b").alias("y"), F.struct("w", "a", "b").alias("e")).where("x <> y"), "edges")
    tree = None
    while not cur.isEmpty():
        out = cur.select("g", F.col("x").alias("c"), F.col("y").alias("o"), "e").unionByName(cur.select("g", F.col("y").alias("c"), F.col("x").alias("o"), "e"))
        best = kept(out.groupBy("g", "c").agg(F.min(F.struct("e", "o")).alias("m")).select("g", "c", "m.e", "m.o"), "lightest")
        taken = best.select("g", "e").distinct()
        tree = taken if tree is None else tree.unionByName(taken)
        found = components(best.select(F.struct("g", "c").alias("p"), F.struct("g", F.col("o").alias("c")).alias("q")), "p", "q")
        label = found.select(F.col("node.g").alias("g"), F.col("node.c").alias("c"), F.col("component.c").alias("to"))
        for side in ("x", "y"):
            cur = cur.join(label.withColumnRenamed("c", side), ["g", side]).drop(side).withColumnRenamed("to", side)
        cur = cur.where("x <> y").groupBy("g", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("e").alias("e"))
        cur = kept(cur, "edges")
    if tree is None:
        return edges.limit(0).select("g", "a", "b", "w")
    return tree.select("g", "e.a", "e.b", "e.w")


def halved(tree: DataFrame, most: int) -> DataFrame:
    """(g, size, p, x, y, nx, ny, e): edges with the tree ``p`` that they are merged in, their vertices there, and the points those hold."""
    name = lambda c: F.concat(F.col("g"), F.lit("\u0001"), F.col(c).cast("string"))
    one = F.lit(1).cast("long")
    cur = kept(tree.select("g", "size", F.col("g").alias("p"), name("a").alias("x"), name("b").alias("y"), one.alias("nx"), one.alias("ny"), F.struct("w", "a", "b").alias("e")), "trees")
    for k in range(64):
        big = kept(cur.groupBy("p").agg(F.count("*").alias("m")).where(F.col("m") > most).select("p"), "large")
        if big.isEmpty():
            return cur
        large = cur.join(big, "p")
        some = top_per_key(large.withColumn("h", F.xxhash64("e")), "p", SAMPLE, F.col("h"), F.col("e"))
        cuts = some.groupBy("p").agg(F.sort_array(F.collect_list("e")).alias("s")).select("p", F.col("s")[F.floor(F.size("s") / 2).cast("int")].alias("cut"))
        large = kept(large.join(cuts, "p").withColumn("light", F.col("e") < F.col("cut")).drop("cut"), "cut")
        light = large.where("light")
        found = components(light, "x", "y").withColumn("component", F.concat(F.lit(f"L{k}|"), "component"))
        ends = light.select(F.col("x").alias("node"), F.col("nx").alias("n")).unionByName(light.select(F.col("y").alias("node"), F.col("ny").alias("n"))).distinct()
        held = found.join(ends, "node")
        held = kept(held.join(held.groupBy("component").agg(F.sum("n").alias("held")), "component").select("node", "component", "held"), "held")
        under = light.join(held.select(F.col("node").alias("x"), "component"), "x").withColumn("p", F.col("component"))
        over = large.where("not light")
        for side in ("x", "y"):
            over = over.join(held.withColumnRenamed("node", side), side, "left").withColumn(f"n{side}", F.coalesce("held", f"n{side}")).withColumn(side, F.coalesce("component", side)).drop("component", "held")
        columns = ["g", "size", "p", "x", "y", "nx", "ny", "e"]
        cur = kept(cur.join(big, "p", "left_anti").select(*columns).unionByName(under.select(*columns)).unionByName(over.select(*columns)), "trees")
    raise RuntimeError("trees did not get smaller")


def merged(group: pa.Table) -> pa.Table:
    """What happens to clusters while one tree's vertices are merged.

    Rows by kind: ``to`` (a vertex, or the tree itself as the vertex of another, is first part of that cluster, or of that larger vertex), ``mass`` (points
    that leave a cluster, times their levels), ``end`` (a cluster of n points is born at a level out of its parent ``to``), ``root``.
    """
    e = group.column("e").combine_chunks()
    e = e.chunk(0) if isinstance(e, pa.ChunkedArray) else e
    table = pa.table({"w": e.field("w"), "a": e.field("a"), "b": e.field("b")} | {c: group.column(c) for c in ("x", "y", "nx", "ny")}).sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")])
    g, size, p = (group.column(c)[0].as_py() for c in ("g", "size", "p"))
    up: dict[str, str] = {}
    count: dict[str, int] = {}
    symbol: dict[str, str | None] = {}
    waiting: dict[str, list[str]] = {}
    out: list[tuple] = []
    mass: dict[str, float] = defaultdict(float)
    made = 0

    def root(v: str) -> str:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    for w, x, y, nx, ny in zip(*(table.column(c).to_pylist() for c in ("w", "x", "y", "nx", "ny"))):
        for v, n in ((x, nx), (y, ny)):
            if v not in up:
                up[v], count[v] = v, n
                symbol[v], waiting[v] = (v, []) if n >= size else (None, [v])
        a, b = root(x), root(y)
        lam = level(w)
        if symbol[a] is not None and symbol[b] is not None:
            made += 1
            cluster = f"c:{p}:{made}"
            out += [("end", symbol[v], cluster, count[v], lam) for v in (a, b)]
            mass[cluster] += lam * (count[a] + count[b])
        elif symbol[a] is not None or symbol[b] is not None:
            cluster, small = (symbol[a], b) if symbol[a] is not None else (symbol[b], a)
            mass[cluster] += lam * count[small]
            out += [("to", v, cluster, None, None) for v in waiting[small]]
        elif count[a] + count[b] >= size:
            made += 1
            cluster = f"c:{p}:{made}"
            mass[cluster] += lam * (count[a] + count[b])
            out += [("to", v, cluster, None, None) for v in waiting[a] + waiting[b]]
        else:
            cluster = None
        up[b] = a
        count[a] += count[b]
        symbol[a], waiting[a] = cluster, [] if cluster is not None else waiting[a] + waiting[b]
    for v in [v for v in up if up[v] == v]:
        if p == g:
            out += [("root", symbol[v], None, count[v], None)] if symbol[v] is not None else []
        elif symbol[v] is not None:
            out.append(("to", p, symbol[v], None, None))
        else:
            out += [("to", x, p, None, None) for x in waiting[v]]
    rows = [(g, size, kind, name, to, None, n, birth) for kind, name, to, n, birth in out] + [(g, size, "mass", name, None, m, None, None) for name, m in mass.items()]
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.float64())
    return pa.table({c.split()[0]: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(zip(ROW.split(", "), kinds))})


def choose(group: pa.Table) -> pa.Table:
    """(g, id, chosen) of one graph's clusters: the topmost whose mass isn't less than what is best under it; the root is never chosen."""
    ids, parents, masses = (group.column(c).to_pylist() for c in ("id", "parent", "mass"))
    at = {c: k for k, c in enumerate(ids)}
    up = [at.get(x, -1) if x is not None else -1 for x in parents]
    kids, below, order = np.bincount([u for u in up if u >= 0], minlength=len(ids)), [0.0] * len(ids), []
    todo = [k for k in range(len(ids)) if not kids[k]]
    picked = [False] * len(ids)
    while todo:
        k = todo.pop()
        order.append(k)
        if up[k] < 0:
            continue
        picked[k] = masses[k] >= below[k] - CLOSE * abs(below[k])
        below[up[k]] += max(masses[k], below[k])
        kids[up[k]] -= 1
        if not kids[up[k]]:
            todo.append(up[k])
    chosen: list[int] = [-1] * len(ids)
    for k in reversed(order):
        chosen[k] = chosen[up[k]] if up[k] >= 0 and chosen[up[k]] >= 0 else k if picked[k] else -1
    return pa.table({"g": group.column("g"), "id": group.column("id"), "chosen": pa.array([ids[c] if c >= 0 else None for c in chosen], pa.string())})


def choose_in_rounds(clusters: DataFrame) -> DataFrame:
    """The same for trees of clusters of any size: a round for each step up from the leaves, then pointers down from the roots that double their reach."""
    c = kept(clusters.select("g", "id", "parent", "mass"), "clusters")
    kids = c.where("parent is not null").groupBy("g", F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    left = kept(c.join(kids, ["g", "id"], "left").select("*").withColumn("kids", F.coalesce("kids", F.lit(0))).withColumn("below", F.lit(0.0)), "undecided")
    done = None
    while not left.isEmpty():
        now = kept(left.where("kids = 0").withColumn("picked", F.col("parent").isNotNull() & (F.col("mass") >= F.col("below") - CLOSE * F.abs("below"))), "decided")
        done = now.select("g", "id", "parent", "picked") if done is None else done.unionByName(now.select("g", "id", "parent", "picked"))
        up = now.where("parent is not null").groupBy("g", F.col("parent").alias("id")).agg(F.sum(F.greatest("mass", "below")).alias("more"), F.count("*").alias("fewer"))
        rest = left.where("kids > 0").join(up, ["g", "id"], "left")
        left = kept(rest.select("g", "id", "parent", "mass", (F.col("kids") - F.coalesce("fewer", F.lit(0))).alias("kids"), (F.col("below") + F.coalesce("more", F.lit(0.0))).alias("below")), "undecided")
    if done is None:
        return clusters.select("g", "id", F.col("id").alias("chosen")).limit(0)
    far = kept(done.select("g", "id", F.col("parent").alias("up"), F.when(F.col("picked"), F.col("id")).alias("chosen")), "reach")
    while not far.where("up is not null").isEmpty():
        over = far.select("g", F.col("id").alias("up"), F.col("up").alias("next"), F.col("chosen").alias("higher"))
        far = kept(far.join(over, ["g", "up"], "left").select("g", "id", F.col("next").alias("up"), F.coalesce("higher", "chosen").alias("chosen")), "reach")
    return far.select("g", "id", "chosen")


def clusters_of_trees(tree: DataFrame, points: DataFrame, most: int = MOST) -> DataFrame:
    """(g, k, cluster) of the points that aren't noise; a cluster's name is its smallest point.

    ``tree``: g, size, a, b, w, the spanning tree of each graph and the least size of its clusters; ``points``: g, k.
    """
    done = kept(halved(tree, most).groupBy("p").applyInArrow(merged, ROW), "merges")
    to = kept(done.where("kind = 'to'").select("g", "name", "to"), "names")
    while not to.where("not startswith(to, 'c:')").isEmpty():
        step = to.select("g", F.col("name").alias("to"), F.col("to").alias("next"))
        to = kept(to.join(step, ["g", "to"], "left").select("g", "name", F.coalesce("next", "to").alias("to")), "names")
    real = done.where("kind <> 'to'").join(to.withColumnRenamed("to", "id"), ["g", "name"], "left").withColumn("id", F.coalesce("id", "name"))
    per = real.groupBy("g", "id").agg(F.sum("mass").alias("s"), F.max(F.when(F.col("kind") == "end", F.struct("to", "n", "birth"))).alias("end"))
    clusters = kept(per.select("g", "id", F.col("end.to").alias("parent"), F.coalesce(F.col("s") - F.col("end.birth") * F.col("end.n"), F.lit(0.0)).alias("mass")), "clusters")
    large = clusters.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > most).select("g")
    chosen = clusters.join(large, "g", "left_anti").groupBy("g").applyInArrow(choose, "g string, id string, chosen string")
    if not large.isEmpty():
        chosen = chosen.unionByName(choose_in_rounds(clusters.join(large, "g", "left_semi")))
    named = points.select("g", "k", F.concat("g", F.lit("\u0001"), F.col("k").cast("string")).alias("name"))
    inside = kept(named.join(to.withColumnRenamed("to", "id"), ["g", "name"]).join(chosen.where("chosen is not null"), ["g", "id"]).select("g", "k", "chosen"), "members")
    least = inside.groupBy("g", "chosen").agg(F.min("k").alias("cluster"))
    return inside.join(least, ["g", "chosen"]).select("g", "k", "cluster")
