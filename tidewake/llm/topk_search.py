"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks by a hash of id and vector, and queries into blocks of their own; each pair of blocks is one small task. A task
sorts its block once along every dimension. Sorted access goes down all lists together (from the top for a positive query component,
from the bottom for a negative one), in steps that double; rows met for the first time are scored for all queries that are still
open. A query closes when its k-th score is above the threshold, the score that a vector made of the values at the current depth
would have: no row that it hasn't met can beat or tie the k-th. A first pass takes each query through one block; the k-th score that
it finds there is a floor that the query carries into all other blocks, which close it as soon as their threshold falls under the
floor and hand back only rows that reach it. Blocks' lists are merged by a ranked window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm._shared import stored

#: Rows and queries of a task.
ROWS, QUERIES = 8192, 2048
FIRST_STEP = 32


def _matrix(vectors: pa.ChunkedArray, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of each component in double precision; shorter vectors are filled with zeros."""
    vectors = vectors.combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = np.floor(np.asarray(vectors.flatten(), np.float64) * scale)
    lengths = np.asarray(vectors.value_lengths()).astype(np.int64)
    out = np.zeros((len(lengths), width))
    if len(flat):
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _width(*sides: pa.ChunkedArray) -> int:
    return max([1, *(int(x) for s in sides if len(s) and (x := pc.max(pc.list_value_length(s)).as_py()))])


def block_topk(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row's place, score) of each query's k best rows, ties to the smaller id; a query's own id is left out.

    ``floor`` holds a score for each query under which nothing is wanted. Products that doubles can't hold exactly are Python's integers.
    """
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    n, width = rows.shape
    most = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * width
    whole = (lambda x: x.astype(np.int64)) if most * n < 2**52 else lambda x: x
    nothing = np.iinfo(np.int64).min
    if most * n >= 2**52:
        rows, queries = (np.frompyfunc(int, 1, 1)(x) for x in (rows, queries))
        nothing = -(1 << 5000)
    kind = rows.dtype if rows.dtype == object else np.int64
    lists = np.argsort(rows, axis=0, kind="stable")  # ascending along each dimension
    ranked = np.take_along_axis(rows, lists, 0)
    high, low = np.maximum(queries, 0), np.minimum(queries, 0)
    open_, seen = np.arange(len(queries)), np.zeros(n, bool)
    best = np.full((len(queries), k), nothing, kind)
    least = np.full(len(queries), nothing, kind) if floor is None else np.array([nothing if f is None else f for f in floor], kind)
    depth = 0
    while depth < n and len(open_):
        upto = min(n, max(FIRST_STEP, 2 * depth))
        met = np.zeros(n, bool)
        met[lists[depth:upto].ravel()] = True
        met[lists[n - upto : n - depth].ravel()] = True
        new = np.flatnonzero(met & ~seen)
        seen |= met
        depth = upto
        if len(new):
            score = whole(queries[open_] @ rows[new].T)
            rank = score * n + (n - 1 - new)  # a tie goes to the smaller id, which comes first
            rank[(query_ids[open_, None] == ids[None, new]) | (score < least[open_, None])] = nothing
            both = np.concatenate([best[open_], rank], 1)
            best[open_] = np.partition(both, both.shape[1] - k, 1)[:, both.shape[1] - k :] if both.shape[1] > k else both
        if seen.all():
            break
        bound = whole(high[open_] @ ranked[n - depth] + low[open_] @ ranked[depth - 1])
        kth = best[open_].min(1)
        open_ = open_[((kth == nothing) | (kth // n <= bound)) & (bound >= least[open_])]
    q, slot = np.nonzero(best > nothing)
    rank = best[q, slot]
    return q, order[(n - 1 - rank % n).astype(np.int64)], np.clip(rank // n, -(2**63), 2**63 - 1).astype(np.int64)


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), ``key``, score: each query's k highest inner products of floor(scale * x) over all other rows.

    Vectors that are null, or hold null or non-finite components, and rows with a null id take no part; an empty vector scores 0, a
    shorter one counts as filled with zeros. Ties go to the smaller id. Rows that repeat an id are candidates each, but one query (that with
    the least vector). Other columns are left out. An empty table gives no rows. Scores beyond 64 bits are given as the nearest long.
    """
    column = F.col(f"`{vector}`")
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(column.isNotNull() & F.col(f"`{key}`").isNotNull() & fine).select(F.col(f"`{key}`").cast("long").alias("id"), column.alias("v"), is_query.alias("asks"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    row_blocks, query_blocks = max(1, -(-counts.n // ROWS)), max(1, -(-counts.q // QUERIES))
    block = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("w")).select(F.col("id").alias("query_id"), "w")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # a side without rows has no columns either
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "id", "score")})
        width = _width(left.column("v"), right.column("w"))
        ids, query_ids = (np.asarray(c).astype(np.int64) for c in (left.column("id"), right.column("query_id")))
        floor = right.column("floor").to_pylist() if "floor" in right.column_names else None
        q, r, score = block_topk(ids, _matrix(left.column("v"), scale, width), query_ids, _matrix(right.column("w"), scale, width), k, floor)
        return pa.table({"query_id": query_ids[q], "id": ids[r], "score": score})

    def pairs(data: DataFrame, queries: DataFrame) -> DataFrame:
        return data.groupBy("rb", "qb").cogroup(queries.groupBy("rb", "qb")).applyInArrow(run, "query_id long, id long, score long")

    in_blocks = rows.select("id", "v", block(row_blocks, "id", "v").alias("rb"))
    if row_blocks > 1:  # each query through one block: any k rows' least score is a floor
        one = asked.select("query_id", "w", block(row_blocks, "query_id", "w").alias("rb"), F.lit(0).alias("qb"))
        first = pairs(in_blocks.withColumn("qb", F.lit(0)), one).groupBy("query_id")
        floors = stored(first.agg(F.when((F.count("*") >= k) & (F.min("score") > -(2**63)), F.min("score")).alias("floor")), "floors")
        asked = asked.join(floors, "query_id", "left")
    else:
        asked = asked.withColumn("floor", F.lit(None).cast("long"))
    found = pairs(in_blocks.withColumn("qb", each(query_blocks)), asked.select("query_id", "w", "floor", each(row_blocks).alias("rb"), block(query_blocks, "query_id").alias("qb")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
