"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

1. Each document's set of five-word shingles is hashed; documents with the same set are one class, represented by its least id.
2. Independent trees branch the representatives recursively: a document goes down a tree by the tree's minwise tokens, two a step. A node
   of one document ends there; a small one is compared at once; a larger one branches on, to ``DEPTH`` tokens at most. Two sets of
   similarity J stay together at least with probability J^4 in each tree. Nineteen trees miss a pair of similarity 0.85 with a
   probability of 1e-6 (``recall``).
3. Nodes are compared exhaustively on sketches of 76 minwise hashes: small nodes as pairs, larger ones by vectorised tasks. Pairs that
   agree on over 65 % of the sketch (a true link misses this with about 1e-6) join candidate families.
4. Families are compared on their full sets; links are those whose full sets pass the threshold exactly, so sketches decide only what
   is looked at. Links give components.

Components are wanted, not all links, so large nodes and families (``_spanning``) are compared block by block first, then a few members
of each block's components with each other. What is still apart after that, and only that, is compared pair by pair with all the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm._shared import offsets, ragged, stored, text_slices
from tidewake.llm.components import components

SHINGLE = 5
DEPTH = 4
#: Tokens that a path has where nodes are looked at: above the last step they may end early.
STEPS = (2, DEPTH)
#: The probability that the trees, and again that the sketches, miss a pair at the threshold.
MISS = 1e-6
MOST_HASHES = 4096
#: Nodes up to this size become pairs, above the last level and at it; larger ones branch on, and at the last level go to block tasks.
EARLY_NODE, SMALL_NODE = 4, 24
#: Members of each component of a block that are compared with those of the others.
PIVOTS = 4
#: Members of a block: of sketches, of full sets.
BLOCK, FAMILY_BLOCK = 1024, 256
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, MOST_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, MOST_HASHES, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C55)
_MOST_WORDS = 400_000


def recall(similarity: float, trees: int, depth: int = DEPTH) -> float:
    """The probability that two sets of this similarity share a node in one tree at least."""
    return 1 - (1 - similarity**depth) ** trees


def trees_for(similarity: float, miss: float = MISS, depth: int = DEPTH) -> int:
    """Trees that miss a pair of this similarity with at most this probability. Refused where that takes over ``MOST_HASHES`` hashes."""
    if similarity >= 1:
        return 1
    trees = max(1, ceil(log(miss) / log(1 - similarity**depth))) if similarity > 0 else MOST_HASHES
    if trees * depth > MOST_HASHES:
        raise ValueError(f"a similarity of {similarity} needs {trees} trees of {depth} levels: over {MOST_HASHES} hashes for each document")
    return trees


def least_alike(similarity: float, hashes: int, miss: float = MISS) -> int:
    """Hashes of a sketch that a pair of this similarity shares at least, but for a probability of ``miss``."""
    below = 0.0
    for k in range(hashes + 1):
        below += comb(hashes, k) * similarity**k * (1 - similarity) ** (hashes - k)
        if below > miss:
            return k
    return hashes


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sorted distinct shingle hashes of texts. Words are hashed once each, in a memory of bounded size."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.words = size, {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        words: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                found = text.encode().lower().split()  # of bytes: A-Z only, ASCII white space
                counts[k] = len(found)
                words += found
        if len(self.words) > _MOST_WORDS:
            self.words = {}
        known = self.words
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        out, at = [], offsets(counts)
        with np.errstate(over="ignore"):
            n = max(0, len(h) - self.size + 1)
            run = np.zeros(n, np.uint64)
            for k in range(self.size):
                run = run * _P + h[k : n + k]
            run = _mix(run)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a >= self.size:
                    out.append(np.unique(run[a : b - self.size + 1]))
                elif b > a:
                    few = np.uint64(b - a)
                    for x in h[a:b]:
                        few = few * _P + x
                    out.append(_mix(np.array([few], np.uint64) + np.uint64(0x5851F42D4C957F2D)))
                else:
                    out.append(run[:0])
        return out


def sketches(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """The upper halves of each non-empty set's minwise hashes; zeros for an empty one."""
    lengths = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), hashes), np.uint32)
    full = lengths > 0
    if full.any():
        flat = np.concatenate([s for s in sets if len(s)])
        starts = np.cumsum(lengths[full]) - lengths[full]
        with np.errstate(over="ignore"):
            for k in range(hashes):
                out[full, k] = np.minimum.reduceat(flat * _A[k] + _B[k], starts) >> np.uint64(32)
    return out


def _rows(batches: Iterator[pa.RecordBatch], group: int, most_rows: int = 1 << 14) -> Iterator[pa.Table]:
    """Runs of whole groups from rows that are sorted by their first ``group`` columns; each run ends where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(group)]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        last = [b.column(i)[b.num_rows - 1].as_py() for b in held[-1:] for i in range(group)]
        new[0] = bool(held) and last != [k[0] for k in keys]
        cuts = np.flatnonzero(new)
        if sum(b.num_rows for b in held) + batch.num_rows >= most_rows and len(cuts):
            held.append(batch.slice(0, cuts[-1]))
            yield pa.Table.from_batches(held)
            held = [batch.slice(cuts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _runs(table: pa.Table, group: int) -> Iterator[tuple[int, int]]:
    keys = [table.column(i).to_numpy() for i in range(group)]
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    cuts = [*np.flatnonzero(new).tolist(), table.num_rows]
    return zip(cuts, cuts[1:])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def shingle_table(df: DataFrame, key: str, text: str, hashes: int) -> DataFrame:
    """key, n (set size), c1 and c2 (a 128-bit digest of the set), sketch (four bytes a hash, null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                sets = shingler.sets(part.column("text").to_pylist())
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                c = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
                found = sketches(sets, hashes)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array([x.tobytes() if len(s) else None for x, s in zip(found, sets)], pa.binary())], ["key", "n", "c1", "c2", "sketch"])

    return df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "key long, n long, c1 long, c2 long, sketch binary")


def _branches(rows: DataFrame, hashes: int, level: int) -> DataFrame:
    """(node, tree, rep): where representatives (rep, sketch, trees: those that they still go down) stand at a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1 << 13) for b in batches for k in range(0, b.num_rows, 1 << 13)):
            sk = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, hashes // DEPTH, DEPTH)
            trees = batch.column("trees")
            row, tree = np.repeat(np.arange(batch.num_rows), np.asarray(trees.value_lengths())), np.asarray(trees.flatten()).astype(np.int64)
            token = sk[row, tree].astype(np.uint64)
            with np.errstate(over="ignore"):
                node = tree.astype(np.uint64) + np.uint64(1)
                for k in range(level):
                    node = _mix(node * _P + token[:, k])
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(tree.astype(np.int32)), batch.column("rep").take(pa.array(row))], ["node", "tree", "rep"])

    return rows.select("rep", "sketch", "trees").mapInArrow(run, "node long, tree int, rep long")


def _blocks(df: DataFrame, size: Column, block: int, member: str) -> DataFrame:
    """Deal each group's rows into pairs of blocks (x <= y): columns x, y and ``side`` (0: of block x, 1: of block y only)."""
    count = F.ceil(size / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), count).cast("int")
    cells = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.least(i, own).alias("x"), F.greatest(i, own).alias("y")))
    return df.withColumn("own", own).withColumn("cell", F.explode(cells)).select("*", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), (F.col("own") != F.col("cell.x")).cast("int").alias("side")).drop("cell", "own")


def _spanning(members: DataFrame, data: DataFrame, make: Callable[[], Find], block: int, most_rows: int) -> DataFrame:
    """(a, b): edges that join, within each group, all members that chains of links join. Never a link that ``Find`` doesn't see.

    ``members``: family, rep, size (of its family). ``data``: rep, data. Each member's data go to one task with their block of the family
    at first. For families of several blocks up to ``PIVOTS`` members of each component of a block follow, to all blocks of such
    members. Components that are still apart then are compared in full: a small one meets every other block, two blocks of one
    component don't meet. So a family of many near copies costs its size, and only one that falls into many parts costs its square.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for table in _rows(batches, 3, most_rows):
            found: list[np.ndarray] = []
            for lo, hi in _runs(table, 3):
                part = table.slice(lo, hi - lo)
                apart = part.column("x")[0].as_py() != part.column("y")[0].as_py()
                edges = find(part.column("data").to_pylist(), part.column("side").to_numpy() if apart else None, part.column("comp").to_numpy())
                reps, family = part.column("rep").to_numpy(), part.column("family")[0].as_py()
                forest, known = _Forest(hi - lo), {}
                for i, c in enumerate(part.column("comp").to_pylist()):  # what is known to hang together
                    forest.join(known.setdefault(c, i), i)
                for i, j in edges.tolist():
                    forest.join(i, j)
                # all but roots have an edge; where more is to come, a root is its own
                rows = [(family, reps[i], reps[r]) for i in range(hi - lo) if (r := forest.root(i)) != i or part.column("more")[i].as_py()]
                found.append(np.array(rows, np.int64).reshape(-1, 3))
            out = np.concatenate(found)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, k]) for k in range(3)], ["family", "rep", "root"])

    def dealt(rows: DataFrame) -> DataFrame:
        # stored, so that the size of what is looked for is known when the join with the data is planned
        rows = stored(rows, "cells").join(data, "rep").select("family", "x", "y", "rep", "side", "comp", "more", "data")
        return rows.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y").mapInArrow(compare, "family long, rep long, root long")

    def edges(found: DataFrame) -> DataFrame:
        return found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))

    own = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / block)).cast("int")
    first = members.select("family", "rep", own.alias("x"), own.alias("y"), F.lit(0).alias("side"), F.col("rep").alias("comp"), (F.col("size") > block).alias("more"))
    found = stored(dealt(first), "spanning")
    large = members.where(F.col("size") > block)
    if not large.limit(1).count():
        return edges(found)
    of_large = found.join(large.select("family").distinct(), "family", "left_semi")
    one = Window.partitionBy("family", "root")  # within a block
    ranked = of_large.withColumn("n", F.count("*").over(one)).withColumn("r", F.row_number().over(one.orderBy(F.col("rep") != F.col("root"), F.xxhash64("rep"))))
    pivots = ranked.where((F.col("n") > 1) & (F.col("r") <= PIVOTS)).select("family", "rep", F.col("root").alias("comp"))
    pivots = pivots.join(pivots.groupBy("family").agg(F.count("*").alias("size")), "family").withColumn("more", F.lit(True))
    met = stored(dealt(_blocks(pivots, F.col("size"), block, "rep")), "spanning")
    joined = edges(found).unionByName(edges(met))
    # names of what is known to hang together: where pivots fill several blocks it may have several names, which only costs comparisons
    label = met.groupBy("family", F.col("rep").alias("root")).agg(F.min("root").alias("label"))
    named = of_large.join(label, ["family", "root"], "left").select("family", "rep", F.coalesce("label", "root").alias("comp"))
    named = stored(named, "named")
    sizes = stored(named.groupBy("family", "comp").agg(F.count("*").alias("n")), "parts")
    split = sizes.groupBy("family").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("n") <= block / 2, F.col("n")).otherwise(0)).alias("few")).where("parts > 1")
    # blocks of a family: those of each large component, and shared ones of the small components
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1)).alias("k")
    whole = sizes.where(F.col("n") > block / 2).join(split.select("family"), "family", "left_semi").select("family", F.lit(False).alias("s"), F.col("comp").alias("c"), spread(F.col("n")))
    shared = split.where("few > 0").select("family", F.lit(True).alias("s"), F.lit(0).cast("long").alias("c"), spread(F.col("few")))
    blocks = whole.unionByName(shared).groupBy("family").agg(F.sort_array(F.collect_list(F.struct("s", "c", "k"))).alias("blocks"))
    rest = named.join(sizes, ["family", "comp"]).join(split.select("family", "few"), "family").join(blocks, "family")
    rest = rest.withColumn("s", F.col("n") <= block / 2).withColumn("c", F.when(F.col("s"), 0).otherwise(F.col("comp")).cast("long"))
    at = F.pmod(F.xxhash64(F.when(F.col("s"), F.col("comp")).otherwise(F.col("rep"))), F.ceil(F.when(F.col("s"), F.col("few")).otherwise(F.col("n")) / block)).cast("int")
    rest = rest.withColumn("own", F.array_position("blocks", F.struct("s", "c", at.alias("k"))).cast("int"))
    others = F.filter(F.sequence(F.lit(1), F.size("blocks")), lambda i: F.col("s") | F.element_at("blocks", i)["s"] | (F.element_at("blocks", i)["c"] != F.col("c")))
    cells = rest.select("family", "rep", "comp", "own", F.explode(others).alias("i"))
    last = cells.select("family", "rep", F.least("own", "i").alias("x"), F.greatest("own", "i").alias("y"), (F.col("own") > F.col("i")).cast("int").alias("side"), "comp", F.lit(False).alias("more"))
    return joined.unionByName(edges(dealt(last)))


#: A spanning forest of what is linked, as pairs of places: of data, sides (None: all pairs; else only across) and components (only across).
Find = Callable[[list, np.ndarray | None, np.ndarray], np.ndarray]


def alike(hashes: int, least: int) -> Find:
    """Sketches that share ``least`` hashes."""

    def find(data: list, side: np.ndarray | None, comp: np.ndarray) -> np.ndarray:
        sk, forest, out = np.frombuffer(b"".join(data), np.uint32).reshape(-1, hashes), _Forest(len(data)), []
        for i in range(len(data) - 1):
            near = (sk[i + 1 :] == sk[i]).sum(1) >= least
            near &= comp[i + 1 :] != comp[i]
            if side is not None:
                near &= side[i + 1 :] != side[i]
            out += [(i, j) for j in (np.flatnonzero(near) + i + 1).tolist() if forest.join(i, j)]
        return np.array(out, np.int64).reshape(-1, 2)

    return find


def linked(percent: int) -> Find:
    """Texts whose full sets pass the threshold."""
    shingler = Shingler()
    return lambda data, side, comp: link_sets(shingler.sets(data), percent, side, comp)


def _candidates(reps: DataFrame, trees: int, alike_least: int) -> DataFrame:
    """(a, b): edges between representatives whose sketches are alike; a spanning forest of each node's."""
    hashes = trees * DEPTH
    going = reps.select("rep", "sketch", F.sequence(F.lit(0), F.lit(trees - 1)).alias("trees"))
    two, few = [], []
    for tokens in STEPS:
        last = tokens == DEPTH
        most = SMALL_NODE if last else EARLY_NODE
        member = stored(_branches(going, hashes, tokens), "branches")
        nodes = stored(member.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("a"), F.max("rep").alias("b")).where("size > 1"), "nodes")
        two.append(nodes.where("size = 2 and a < b").select("a", "b"))
        some, large = (stored(nodes.where(c).select("node", "size"), "nodes") for c in ((F.col("size") > 2) & (F.col("size") <= most), F.col("size") > most))
        rows = member.join(large, "node", "left_anti").join(some.select("node"), "node")  # no large node is a key of the second join
        few.append(rows.groupBy("node").agg(F.sort_array(F.collect_set("rep")).alias("m")).select("m"))
        large = member.join(large, "node")
        if not last:
            going = stored(large.groupBy("rep").agg(F.collect_list("tree").alias("trees")), "going").join(reps, "rep").select("rep", "sketch", "trees")
    sets = reduce(DataFrame.unionByName, few).distinct()
    of_sets = sets.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    pairs = reduce(DataFrame.unionByName, [*two, of_sets]).distinct()
    a, b = (reps.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, hashes) for c in ("sa", "sb"))
            keep = pa.array((x == y).sum(1) >= alike_least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    of_small = pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long")
    of_large = _spanning(large.select(F.col("node").alias("family"), "rep", "size"), reps.select("rep", F.col("sketch").alias("data")), lambda: alike(hashes, alike_least), BLOCK, 1 << 14)
    return of_small.unionByName(of_large)


def _links(df: DataFrame, families: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """(a, b): edges that join what links by full sets within families."""
    members = families.join(families.groupBy("family").agg(F.count("*").alias("size")), "family")
    texts = df.select(F.col(f"`{key}`").cast("long").alias("rep"), F.col(f"`{text}`").alias("data"))
    # the texts that are looked at, once: all passes read these only
    texts = stored(texts.join(families.select("rep").distinct(), "rep", "left_semi"), "texts")
    return _spanning(members, texts, lambda: linked(percent), FAMILY_BLOCK, 64)


def link_sets(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, comp: np.ndarray | None = None) -> np.ndarray:
    """A spanning forest of the links 100 * |intersection| >= percent * |union|, as rows of places; only across sides and components if given."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    forest, out = _Forest(n), []
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting, starts = owner[order], offsets(np.bincount(code)) if len(code) else np.zeros(1, np.int64)
    ends_of = offsets(sizes)
    for i in range(n - 1):
        mine = code[ends_of[i] : ends_of[i + 1]]
        shared = np.bincount(ragged(posting, starts[mine], starts[mine + 1] - starts[mine]), minlength=n)
        linked = 100 * shared >= percent * (sizes + sizes[i] - shared)
        linked[: i + 1] = False
        for of in (side, comp):
            if of is not None:
                linked &= of != of[i]
        out += [(i, j) for j in np.flatnonzero(linked & (sizes > 0)).tolist() if forest.join(i, j)]
    return np.array(out, np.int64).reshape(-1, 2)


def near_duplicates(df: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, component_id (least id reachable over links), kept (id equal to it) of each row.

    Two documents link when 100 * |intersection| >= ``percent`` * |union| of their sets of five-word shingles (A-Z lower-cased; a text with
    one to four words is one shingle). Texts without words, null ones too, have an empty set and link with nothing. A null id
    takes no part: its component is null, and it is kept. Rows that repeat an id each give a row, with the links of its own text; where
    several of an id's texts are the first of their kind, the id stands for all of them. Extra columns are left out. Long texts are cut into shingles whole; texts are compared in
    blocks of rows, so a task's memory grows with the longest of them. An empty table gives an empty one. Copies are never expanded into pairs: classes of equal sets have one
    representative each.
    """
    trees = trees_for(percent / 100)
    base = stored(shingle_table(df, key, text, trees * DEPTH), "shingles")
    full = base.where("n > 0 and key is not null")
    reps = stored(full.groupBy("c1", "c2").agg(F.min("key").alias("rep"), F.min("sketch").alias("sketch")), "classes")
    candidates = stored(_candidates(reps, trees, least_alike(percent / 100, trees * DEPTH)), "candidates")
    found = components(candidates)
    families = found.select(F.col("node").alias("rep"), F.col("component").alias("family")).unionByName(found.select(F.col("component").alias("rep"), F.col("component").alias("family")).distinct())
    links = components(stored(_links(df, stored(families, "families"), key, text, percent), "links"))
    of_class = reps.join(links, reps.rep == links.node, "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    done = base.join(of_class, ["c1", "c2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return done.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), own).alias("component_id"), F.coalesce(F.col("key") == own, F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.m AS component_id, m.m = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) m USING (doc_id)
"""
