"""Hard negatives by product quantisation: rows of another label that score nearly as high with an anchor as its positives do.

Every vector is cut into subspaces of two dimensions and each part replaced by the nearest of 256 code words; the norm of what is lost is
stored beside the codes. For an anchor a table of its products with all code words gives each row's score by look-ups, wrong by at most the
anchor's norm times the row's residual norm. So a row whose upper bound is under the k-th lower bound can't be among the k best, and one whose
bounds lie outside a window can't be in it; what is left is scored exactly in whole numbers, which completes the window.

Equal vectors of a label are one class with its smallest ids, and equal anchors ask once. Classes are dealt into blocks by hash, and pairs
of a block of rows and a block of anchors are small tasks. Each anchor first goes through one block; the k-th score that it finds there is
a floor in all others. Code words are fitted on a bounded sample (``SAMPLE`` classes); results don't depend on them, only the work does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm._shared import stored
from tidewake.llm.topk_search import _matrix

#: Rows and anchors of a task, anchors that are looked up at once.
ROWS, ANCHORS, AT_ONCE = 8192, 1024, 128
#: Classes that code words are fitted on (of the lowest hashes), words of a subspace, dimensions of a subspace.
SAMPLE, WORDS, PART = 4096, 256, 2
NOTHING = -(2**63)


def fit_words(x: np.ndarray, rounds: int = 10) -> np.ndarray:
    """(subspaces, ``WORDS``, ``PART``) code words of a sample, by k-means from evenly spread rows."""
    n, width = x.shape
    parts = -(-max(1, width) // PART)
    filled = np.zeros((n, parts * PART))
    filled[:, :width] = x
    out = np.zeros((parts, WORDS, PART))
    for m in range(parts if n else 0):
        rows = filled[:, m * PART : (m + 1) * PART]
        order = np.lexsort(rows.T)
        words = rows[order[np.linspace(0, n - 1, WORDS).astype(int)]]
        for _ in range(rounds):
            near = _nearest(rows, words)
            counts = np.bincount(near, minlength=WORDS)
            means = np.stack([np.bincount(near, rows[:, j], WORDS) for j in range(PART)], 1) / np.maximum(1, counts)[:, None]
            words = np.where(counts[:, None] > 0, means, words)
        out[m] = words
    return out


def _nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * rows @ words.T).argmin(1)


def quantise(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual norms); norms are rounded up."""
    parts = len(words)
    filled = np.zeros((len(x), parts * PART))
    filled[:, : x.shape[1]] = x
    codes, lost = np.zeros((len(x), parts), np.uint8), np.zeros(len(x))
    for m in range(parts):
        rows = filled[:, m * PART : (m + 1) * PART]
        codes[:, m] = _nearest(rows, words[m])
        lost += ((rows - words[m][codes[:, m]]) ** 2).sum(1)
    return codes, np.sqrt(lost) * (1 + 1e-9)


def look_up(anchors: np.ndarray, codes: np.ndarray, lost: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of every anchor's score with every row."""
    parts = len(words)
    filled = np.zeros((len(anchors), parts * PART))
    filled[:, : anchors.shape[1]] = anchors
    score, sizes = np.zeros((len(anchors), len(codes))), np.zeros(len(anchors))
    for m in range(parts):
        table = filled[:, m * PART : (m + 1) * PART] @ words[m].T
        score += table[:, codes[:, m]]
        sizes += np.abs(table).max(1, initial=0)
    wrong = np.linalg.norm(filled, axis=1)[:, None] * lost + 1e-12 * sizes[:, None] + 1e-6  # what doubles round away as well
    return score - wrong, score + wrong


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


class _Block:
    """A block of rows and one of anchors: codes and tables, exact scores where they are asked for."""

    def __init__(self, left: pa.Table, right: pa.Table, words: np.ndarray, scale: float):
        width = words.shape[0] * PART
        self.x, self.q = _matrix(left.column("v"), scale, width), _matrix(right.column("w"), scale, width)
        joined = b"".join(left.column("codes").to_pylist())
        self.codes = np.frombuffer(joined, np.uint8).reshape(len(self.x), -1)
        self.lost, self.first = np.asarray(left.column("lost")), np.asarray(left.column("id")).astype(np.int64)
        self.words, self.whole = words, np.abs(self.x).max(initial=0) * np.abs(self.q).max(initial=0) * width < 2**53

    def bounds(self):
        for at in range(0, len(self.q), AT_ONCE):
            lower, upper = look_up(self.q[at : at + AT_ONCE], self.codes, self.lost, self.words)
            yield from zip(range(at, len(self.q)), lower, upper)

    def exact(self, a: int, rows: np.ndarray) -> np.ndarray:
        if self.whole:
            return (self.x[rows] @ self.q[a]).astype(np.int64)
        whole = np.frompyfunc(int, 1, 1)
        return np.clip(whole(self.x[rows]) @ whole(self.q[a]), -(2**63), 2**63 - 1).astype(np.int64)

    def best(self, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best, ties to the smaller id."""
        if len(score) > k:
            some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        else:
            some = np.arange(len(score))
        return some[np.lexsort((self.first[rows[some]], -score[some]))][:k]


def anchors_best(block: _Block, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's place, row's place, score) of each anchor's k best rows at its floor or over it."""
    out = [(np.zeros(0, np.int64),) * 3]
    for a, lower, upper in block.bounds():
        rows = np.flatnonzero(upper >= max(_kth(lower, k), float(floors[a])))
        score = block.exact(a, rows)
        rows, score = rows[score >= floors[a]], score[score >= floors[a]]
        pick = block.best(rows, score, k)
        out.append((np.full(len(pick), a), rows[pick], score[pick]))
    return tuple(np.concatenate(x) for x in zip(*out))


def windows_best(block: _Block, k: int, other: np.ndarray, tops: list[list[int]], floors: list[list[int | None]]) -> tuple[np.ndarray, ...]:
    """(anchor's place, window's top, row's place, score) of the k best rows in each of an anchor's windows: 4/5 of ``top`` to ``top``.

    ``other`` says which rows have another label than each anchor. All windows of an anchor share one exact scoring.
    """
    out = [(np.zeros(0, np.int64),) * 4]
    for a, lower, upper in block.bounds():
        mine = np.flatnonzero(other[a])
        low, high = lower[mine], upper[mine]
        wanted, plans = np.zeros(len(mine), bool), []
        for top, floor in zip(tops[a], floors[a]):
            least = -(-4 * top // 5) if floor is None else max(-(-4 * top // 5), floor)
            if top < 0 or least > top:
                continue
            sure = (low >= least) & (high <= top)
            some = (high >= max(least, _kth(low[sure], k))) & (low <= top)
            wanted |= some
            plans.append((top, least, some))
        at = np.flatnonzero(wanted)
        score = np.zeros(len(mine), np.int64)
        score[at] = block.exact(a, mine[at])
        for top, least, some in plans:
            rows = np.flatnonzero(some & (score >= least) & (score <= top))
            pick = rows[block.best(mine[rows], score[rows], k)]
            out.append((np.full(len(pick), a), np.full(len(pick), top), mine[pick], score[pick]))
    return tuple(np.concatenate(x) for x in zip(*out))


def usable(df: DataFrame, label: Column, key: str, vector: str) -> DataFrame:
    """(id, label, v, h) of the rows that take part; h is the vector's hash."""
    column = F.col(f"`{vector}`")
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(column.isNotNull() & F.col(f"`{key}`").isNotNull() & fine)
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), label.alias("label"), column.alias("v"), F.xxhash64(column).alias("h")).where("label is not null")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(id, label, v, ids): equal vectors of a label with their ``k`` smallest ids, the first of which is ``id``."""
    same = Window.partitionBy("label", "h", "v").orderBy("id")
    few = rows.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k)
    return few.groupBy("label", "h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "label", "v", "ids")


def mine(df: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of floor(scale * x); higher first, ties to the smaller id. An anchor's positives are its first ``positives``
    other rows of its label; for each, its first ``negatives`` rows of other labels that score at most the positive's score and at least four
    fifths of it (so none where that is negative). Fewer where there are no more; a positive without any gives no row.

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. A shorter vector counts as filled with zeros,
    an empty one scores 0. Rows that repeat an id are candidates each (those equal in label and vector once), but one anchor: that of the least label
    and vector; no row of an anchor's id is its positive. Other columns are left out, whatever their names. An empty table gives
    no rows. Scores beyond 64 bits are given as the nearest long.
    """
    k = max(positives + 1, negatives)
    kept = stored(classes(usable(df, label, key, vector), k), "classes")
    kind = kept.schema["label"].dataType.simpleString()
    counts = kept.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    sample = kept.orderBy(F.xxhash64("id", "label"), "id", "label").limit(SAMPLE).select("v").toArrow()
    words = fit_words(_matrix(sample.column("v"), scale, max(1, counts.width or 1)))

    def encode(batches):
        for batch in batches:
            codes, lost = quantise(_matrix(pa.chunked_array([batch.column("v")]), scale, words.shape[0] * PART), words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(bytes, codes), pa.binary()), pa.array(lost)], [*batch.schema.names, "codes", "lost"])

    parts = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    coded = stored(kept.mapInArrow(encode, f"{parts}, codes binary, lost double"), "codes")

    # anchors: one of each id; those of a class ask once, under the least of their ids
    one = usable(df.where(is_anchor), label, key, vector).groupBy(F.col("id").alias("anchor_id")).agg(F.min(F.struct("label", "v", "h")).alias("s")).select("anchor_id", "s.*")
    one = stored(one, "anchors")
    least = one.groupBy("label", "h", "v").agg(F.min("anchor_id").alias("q"))
    anchors = stored(one.join(least, ["label", "h", "v"]), "anchors")
    asked = stored(anchors.where("anchor_id = q").select("q", "label", F.col("v").alias("w")), "asked")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size).cast("int"))
    block = lambda n, *c: F.pmod(F.xxhash64(*c), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    # positives: rows and anchors of one label
    sizes = coded.groupBy("label").agg(blocks(F.count("*"), ROWS).alias("rbs")).join(asked.groupBy("label").agg(blocks(F.count("*"), ANCHORS).alias("qbs")), "label")
    rows, asks = coded.join(sizes, "label").withColumn("rb", block(F.col("rbs"), "id")), asked.join(sizes, "label").withColumn("qb", block(F.col("qbs"), "q"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.int64())})
        floors = np.array([NOTHING if f is None else f for f in right.column("floor").to_pylist()])
        a, r, score = anchors_best(_Block(left, right, words, scale), positives + 1, floors)
        return pa.table({"q": right.column("q").take(pa.array(a)), "ids": left.column("ids").take(pa.array(r)), "score": pa.array(score)})

    by = ["label", "rb", "qb"]
    ROW, ASK = ["id", "v", "ids", "codes", "lost"], ["q", "w"]
    run = lambda left, right: left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, "q long, ids array<long>, score long")
    home = asks.withColumn("rb", block(F.col("rbs"), "q")).withColumn("floor", F.lit(None).cast("long"))
    first = run(rows.select("label", "rb", each(F.col("qbs")).alias("qb"), *ROW), home.select(*by, *ASK, "floor"))
    first = stored(first, "first")
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    floors = first.groupBy("q").agg(F.when(F.count("*") > positives, F.min("score")).alias("floor"))
    others = asks.withColumn("home", block(F.col("rbs"), "q")).join(floors, "q", "left").withColumn("rb", each(F.col("rbs"))).where("rb <> home")
    rest = run(rows.where("rbs > 1").select("label", "rb", each(F.col("qbs")).alias("qb"), *ROW), others.select(*by, *ASK, "floor"))
    found = first.unionByName(rest).select("q", "score", F.explode("ids").alias("id")).withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k)
    mates = anchors.select("anchor_id", "q").join(found.select("q", "score", "id", "r"), "q").where("id <> anchor_id")
    order = Window.partitionBy("anchor_id").orderBy("r")
    chosen = mates.withColumn("r", F.row_number().over(order)).where(F.col("r") <= positives)
    chosen = stored(chosen.select("anchor_id", "q", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # negatives: a window for each different score of a class of anchors; anchors meet every block, whose rows of other labels count
    tops = chosen.where("positive_score >= 0").groupBy("q").agg(F.array_sort(F.collect_set("positive_score")).alias("tops"))
    windows = stored(asked.join(tops, "q"), "windows")
    rbs, qbs = max(1, -(-(counts.n or 0) // ROWS)), max(1, -(-windows.count() // ANCHORS))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "top": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.int64())})
        own, theirs = (t.column("label").combine_chunks() for t in (left, right))
        codes = pa.concat_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (own, theirs)]).dictionary_encode().indices.to_numpy()
        other = codes[len(own) :, None] != codes[None, : len(own)]
        tops_, floors_ = right.column("tops").to_pylist(), right.column("floors").to_pylist()
        a, top, r, score = windows_best(_Block(left, right, words, scale), negatives, other, tops_, [f or [None] * len(t) for f, t in zip(floors_, tops_)])
        return pa.table({"q": right.column("q").take(pa.array(a)), "top": pa.array(top), "ids": left.column("ids").take(pa.array(r)), "score": pa.array(score)})

    pair = lambda left, right: left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(near, "q long, top long, ids array<long>, score long")
    all_rows = coded.select("label", *ROW, block(F.lit(rbs), "id", "label").alias("rb"), each(F.lit(qbs)).alias("qb"))
    asks = windows.select("q", "label", "w", "tops", block(F.lit(qbs), "q").alias("qb"), block(F.lit(rbs), "q", "label").alias("home"))
    few = lambda df: df.select("q", "top", "score", F.explode("ids").alias("id")).withColumn("rank", F.row_number().over(Window.partitionBy("q", "top").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= negatives)
    first = stored(pair(all_rows, asks.withColumnRenamed("home", "rb").withColumn("floors", F.lit(None).cast("array<long>"))), "first")
    if rbs > 1:
        floors = few(first).groupBy("q", "top").agg(F.when(F.count("*") >= negatives, F.min("score")).alias("floor")).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("top", "floor"))).alias("m"))
        told = asks.join(floors, "q", "left").withColumn("floors", F.transform("tops", lambda t: F.try_element_at("m", t))).drop("m")
        first = first.unionByName(pair(all_rows, told.withColumn("rb", each(F.lit(rbs))).where("rb <> home").drop("home")))
    done = stored(few(first), "negatives")
    joined = chosen.join(done.withColumnRenamed("top", "positive_score"), ["q", "positive_score"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.id AS a, c.id AS c, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.id <> c.id WHERE a.id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, c) AS r FROM s WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.a AS anchor_id, p.c AS positive_id, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS rank, s.c AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score) WHERE rank <= 5
"""
