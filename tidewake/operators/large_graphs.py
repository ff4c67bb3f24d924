"""Measures of groups' graphs that are too large for one task: rounds of joins over stored tables.

Path lengths come from neighbourhood functions: each node holds a sketch (HyperLogLog, ``LG`` = 10: standard error 3.3 %) of the nodes it reaches in k
steps, and a round merges its successors' sketches into it. Centrality is power iteration, groups are Louvain moves by colour classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators.components import components
from tidewake.plans.storage import kept

#: Logarithm of a sketch's registers; rounds of power iteration; colour classes of nodes, of which one moves in a round; rounds at most.
LG, POWER, COLOURS, MOST = 10, 100, 4, 200


def path_lengths(edges: DataFrame, lg: int = LG) -> DataFrame:
    """(g, path_length, diameter): the mean number of steps from a node to those that it reaches, and the greatest.

    ``edges``: g, src, dst. Both are estimates: sums over all nodes average the sketches' errors, so the mean is mostly within a few per cent; the
    diameter is the last round in which a sketch changed, which can be too small but never too large. A node is no part of its own paths.
    """
    e = kept(edges.select("g", "src", "dst").where("src <> dst").distinct(), "steps")
    nodes = e.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()
    reach = kept(nodes.groupBy("g", "node").agg(F.hll_sketch_agg(F.col("node").cast("string"), F.lit(lg)).alias("s")).withColumn("near", F.hll_sketch_estimate("s")).withColumn("live", F.lit(True)), "reach")
    history = reach.groupBy("g").agg(F.sum("near").alias("near")).withColumn("k", F.lit(0))
    for k in range(1, MOST):
        step = e.join(reach.select("g", F.col("node").alias("dst"), "s"), ["g", "dst"]).select("g", F.col("src").alias("node"), "s").unionByName(reach.select("g", "node", "s"))
        merged = step.groupBy("g", "node").agg(F.hll_union_agg("s").alias("s"), F.count("*").alias("m"))
        was = reach.select("g", "node", F.col("near").alias("before"))
        new = kept(merged.withColumn("near", F.hll_sketch_estimate("s")).join(was, ["g", "node"]).withColumn("live", F.col("near") > F.col("before")).select("g", "node", "s", "near", "live"), "reach")
        if new.where("live").isEmpty():
            break
        reach = new
        history = history.unionByName(reach.groupBy("g").agg(F.sum("near").alias("near")).withColumn("k", F.lit(k)))
    steps = kept(history, "neighbourhoods")
    by = Window.partitionBy("g").orderBy("k")
    grown = steps.withColumn("more", F.col("near") - F.lag("near").over(by))
    return grown.groupBy("g").agg(F.coalesce(F.try_divide(F.sum(F.col("k") * F.col("more")), F.sum("more")), F.max(F.when(F.col("k") == 0, F.col("near")))).alias("path_length"), F.max(F.when(F.col("more") > 0, F.col("k")).otherwise(0)).cast("double").alias("diameter"))


def links(edges: DataFrame) -> DataFrame:
    """(g, u, v), both ways, of the undirected graph without loops."""
    e = edges.select("g", F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v")
    return e.unionByName(e.select("g", F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def centrality(both: DataFrame, rounds: int = POWER) -> DataFrame:
    """(g, eigen_max, eigen_std, assortativity) of ``links``: power iteration in rounds that are stored, ended once no component moves by 1e-7."""
    both = kept(both, "links")
    degree = kept(both.groupBy("g", "u").agg(F.count("*").cast("double").alias("d")), "degrees")
    sizes = degree.groupBy("g").agg(F.count("*").alias("n"))
    v = kept(degree.join(sizes, "g").select("g", "u", (1 / F.sqrt("n")).alias("x")), "vector")
    for _ in range(rounds):
        summed = both.join(v.select("g", F.col("u").alias("v"), "x"), ["g", "v"]).select("g", "u", "x").unionByName(v).groupBy("g", "u").agg(F.sum("x").alias("x"))
        summed = kept(summed, "vector")
        length = summed.groupBy("g").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
        new = kept(summed.join(length, "g").select("g", "u", (F.col("x") / F.greatest("l", F.lit(1e-12))).alias("x")), "vector")
        moved = new.join(v.withColumnRenamed("x", "was"), ["g", "u"]).agg(F.max(F.abs(F.col("x") - F.col("was"))).alias("m")).first().m
        v = new
        if moved is None or moved < 1e-7:
            break
    ends = both.join(degree, ["g", "u"]).join(degree.select("g", F.col("u").alias("v"), F.col("d").alias("e")), ["g", "v"])
    assort = ends.groupBy("g").agg(F.coalesce(F.try_divide(F.covar_pop("d", "e"), F.var_pop("d")), F.lit(0.0)).alias("assortativity"))
    return v.groupBy("g").agg(F.max("x").alias("eigen_max"), F.stddev_pop("x").alias("eigen_std")).join(assort, "g")


def _modularity(w: DataFrame, at: DataFrame) -> DataFrame:
    """(g, q) of weights (g, u, v, w; both ways) under groups (g, u, c)."""
    total = w.groupBy("g").agg(F.sum("w").alias("m2"))
    far = at.select("g", F.col("u").alias("v"), F.col("c").alias("d"))
    inside = w.join(at, ["g", "u"]).join(far, ["g", "v"]).groupBy("g").agg(F.sum(F.when(F.col("c") == F.col("d"), F.col("w")).otherwise(0.0)).alias("inside"))
    degree = w.groupBy("g", "u").agg(F.sum("w").alias("k")).join(at, ["g", "u"]).groupBy("g", "c").agg(F.sum("k").alias("k"))
    squares = degree.join(total, "g").groupBy("g").agg(F.sum((F.col("k") / F.col("m2")) ** 2).alias("s"))
    return inside.join(total, "g").join(squares, "g").select("g", (F.col("inside") / F.col("m2") - F.col("s")).alias("q"))


def louvain(both: DataFrame, colours: int = COLOURS) -> DataFrame:
    """(g, node, group): groups of high modularity of ``links``.

    In a round the nodes of one colour class (by hash) go to the neighbouring group that gains most, ties to the smaller; a class that lowers the
    modularity (neighbours that moved at once) is undone. When no class moves, groups become nodes, until nothing is joined.
    """
    w = kept(both.select("g", "u", "v", F.lit(1.0).alias("w")), "weights")
    name = kept(w.select("g", "u").distinct().withColumn("c", F.col("u")), "groups")  # node to its vertex of the present level
    for level in range(MOST):
        at = kept(w.select("g", "u").distinct().withColumn("c", F.col("u")), "groups")
        q = kept(_modularity(w, at), "modularity")
        total = w.groupBy("g").agg(F.sum("w").alias("m2"))
        degree = kept(w.groupBy("g", "u").agg(F.sum("w").alias("k")).join(total, "g"), "degrees")
        idle, joined = 0, False
        for k in range(MOST):
            far = at.select("g", F.col("u").alias("v"), F.col("c").alias("to"))
            toward = w.where("u <> v").join(far, ["g", "v"]).groupBy("g", "u", "to").agg(F.sum("w").alias("w"))
            held = degree.join(at, ["g", "u"]).groupBy("g", F.col("c").alias("to")).agg(F.sum("k").alias("held"))
            mine = degree.join(at, ["g", "u"])
            stay = mine.select("g", "u", F.col("c").alias("to"), F.lit(0.0).alias("w"))
            options = toward.unionByName(stay).groupBy("g", "u", "to").agg(F.sum("w").alias("w")).join(mine, ["g", "u"]).join(held, ["g", "to"])
            own = F.col("to") == F.col("c")
            gain = F.round(F.col("w") - F.col("k") * (F.col("held") - F.when(own, F.col("k")).otherwise(0.0)) / F.col("m2"), 9)
            turn = F.pmod(F.xxhash64("u", F.lit(level)), F.lit(colours)) == k % colours
            best = options.groupBy("g", "u", "c").agg(F.min(F.struct((-gain).alias("loss"), (~own).alias("moves"), F.col("to"))).alias("b"))
            new = kept(best.select("g", "u", F.when(turn, F.col("b.to")).otherwise(F.col("c")).alias("c")), "groups")
            gained = kept(_modularity(w, new), "modularity")
            better = gained.join(q.withColumnRenamed("q", "was"), "g").where("q > was + 1e-12").select("g")
            new = kept(new.join(better, "g", "left_semi").unionByName(at.join(better, "g", "left_anti")), "groups")
            if better.isEmpty():
                idle += 1
                if idle == colours:
                    break
                continue
            idle, joined, at, q = 0, True, new, kept(_modularity(w, new), "modularity")
        if not joined:
            return name.select("g", F.col("u").alias("node"), F.col("c").alias("group"))
        step = at.select("g", F.col("u").alias("c"), F.col("c").alias("next"))
        name = kept(name.join(step, ["g", "c"]).select("g", "u", F.col("next").alias("c")), "groups")
        far = at.select("g", F.col("u").alias("v"), F.col("c").alias("y"))
        w = kept(w.join(at.withColumnRenamed("c", "x"), ["g", "u"]).join(far, ["g", "v"]).groupBy("g", F.col("x").alias("u"), F.col("y").alias("v")).agg(F.sum("w").alias("w")), "weights")
    raise RuntimeError("groups did not settle")


def random_edges(sizes: DataFrame, seed: int = 42) -> DataFrame:
    """(g, src, dst): a random graph of each group's numbers of nodes ``n`` and edges ``m``, by hashes of the edge's number; both ways."""
    edge = sizes.select("g", "n", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("i"))
    end = lambda k: F.pmod(F.xxhash64("g", "i", F.lit(seed + k)), F.col("n"))
    one = edge.select("g", end(0).alias("src"), end(1).alias("dst"))
    return one.unionByName(one.select("g", F.col("dst").alias("src"), F.col("src").alias("dst")))


def mean_coefficient(edges: DataFrame) -> DataFrame:
    """(g, coefficient): the mean of nodes' clustering coefficients, nodes with one neighbour included."""
    from tidewake.operators.graph import clustering

    node = lambda c: F.struct(F.col("g"), F.col(c).cast("string").alias("n"))
    named = edges.select(F.to_json(node("src")).alias("src"), F.to_json(node("dst")).alias("dst"), "g")
    per = clustering(named.select("src", "dst"))
    groups = named.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return groups.join(per, "node").groupBy("g").agg(F.avg("coefficient").alias("coefficient"))


def measures(edges: DataFrame, seed: int = 42) -> DataFrame:
    """The columns of ``graph.group_graphs`` for groups of any size. ``edges``: g, src, dst, weight."""
    e = kept(edges.select("g", "src", "dst", "weight"), "edges")
    sizes = kept(e.where("src <> dst").groupBy("g").agg(F.count_distinct("src", "dst").alias("m")).join(e.select("g", F.explode(F.array("src", "dst")).alias("x")).distinct().groupBy("g").agg(F.count("*").alias("n")), "g"), "sizes")
    random = kept(random_edges(sizes, seed), "random")
    paths = path_lengths(e)
    random_paths = path_lengths(random).select("g", F.col("path_length").alias("random_length"))
    own, theirs = mean_coefficient(e.select("g", "src", "dst")), mean_coefficient(random).withColumnRenamed("coefficient", "random_coefficient")
    node = lambda c: F.struct(F.col("g"), F.col(c).cast("string").alias("n"))
    parts = components(e.select(node("src").alias("a"), node("dst").alias("b")), "a", "b").groupBy(F.col("node.g").alias("g")).agg(F.count_distinct("component").cast("double").alias("components"))
    weighty = kept(links(e.where("weight <> 0")), "links")
    groups = louvain(weighty).groupBy("g").agg(F.count_distinct("group").cast("double").alias("groups"))
    all_ = sizes.select("g")
    for part in (paths, parts, own, theirs, random_paths, centrality(weighty), groups):
        all_ = all_.join(part, "g", "left")
    ratio: Column = F.try_divide(F.try_divide(F.col("coefficient"), F.col("random_coefficient")), F.try_divide(F.col("path_length"), F.col("random_length")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return all_.select("g", "path_length", "diameter", zero("components"), F.coalesce(ratio, F.lit(0.0)).alias("small_world"), zero("eigen_max"), zero("eigen_std"), zero("assortativity"), zero("groups"))
