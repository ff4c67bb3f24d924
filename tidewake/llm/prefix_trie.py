"""Prefix tries of conversations: which beginnings conversations share, and how many words a cache of them saves.

Each turn becomes a SHA-256 of role and text and a count of words, so no text is shuffled. A conversation's turns, in order, are chained:
the digest of its first d turns is the SHA-256 of the digest of its first d - 1 and the d-th turn's. Every prefix is a row; rows of the same
(depth, digest) are a node. Sums over a node's subtree come from nodes that are exploded to all their ancestors. So that a conversation of
very many turns doesn't make rows by the square of its length, that is done in segments of ``SEGMENT`` levels: a node goes to its
ancestors in its segment, the tops of segments do the same among themselves (in segments of tops, and so on), and what lies under a
top goes once to the nodes of the segment above it.

Turns are chained by a task that streams over sorted rows, and lists of members are hashed in runs of ids, so nothing holds a whole
conversation or a whole node's members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm._shared import stored

#: Levels of the trie whose nodes meet each other's ancestors directly.
SEGMENT = 16
#: Conversation ids that one row of a member list spans.
RUN_BITS = 8
ROOT = hashlib.sha256(b"").digest()
WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, i, t, w): each conversation's turns from 1, with the digest of role and text and the text's words.

    Turns go by ``turn``, null first; those that tie by role, then by digest. A null role or text is empty; rows with a null id are left
    out; repeated rows are turns each. Other columns, whatever their names, are left out.
    """
    said, words = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    rows = df.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"), said.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(said).cast("string"), F.lit(":"), said, words), 256)).alias("t"), F.regexp_count(words, F.lit(WORD)).cast("long").alias("w"),
    )
    return rows.select("c", F.row_number().over(Window.partitionBy("c").orderBy(F.asc_nulls_first("turn"), "role", "t")).alias("i"), "t", "w")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(c, part, i, t, w): each conversation with its first h turns taken from the conversation c - c % ``every`` (h: crc32 of c's digits modulo ``most``).

    ``turns`` come from ``numbered_turns``; a row of part -1 stands for each conversation, whether or not it has turns left. Where the lender has
    fewer turns, all are taken, where it is absent none; the borrower's own first h turns go in any case. A lender's rows meet at most
    ``every`` borrowers.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    own = turns.where(F.col("i") > h).select("c", F.lit(1).alias("part"), "i", "t", "w")
    each = turns.where("i = 1")
    lent = turns.where(F.col("i") < most).where(F.col("c") % every == 0).select(F.col("c").alias("lender"), "i", "t", "w")
    taken = each.select("c", (F.col("c") - F.col("c") % every).alias("lender"), h.alias("h")).where("h > 0").join(lent, "lender").where("i <= h")
    return own.unionByName(taken.select("c", F.lit(0).alias("part"), "i", "t", "w")).unionByName(each.select("c", F.lit(-1).alias("part"), F.lit(0).alias("i"), F.lit(None).cast("binary").alias("t"), F.lit(0).cast("long").alias("w")))


PREFIX = "c long, depth long, parent binary, node binary, w long, ends boolean, ups array<array<binary>>"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of conversations whose rows come in order; ``ups`` has, for each level of segments that the node belongs to, its ancestors of that
    level back to the top of the last segment."""
    schema = pa.schema([("c", pa.int64()), ("depth", pa.int64()), ("parent", pa.binary()), ("node", pa.binary()), ("w", pa.int64()), ("ends", pa.bool_()), ("ups", pa.list_(pa.list_(pa.binary())))])
    last: list | None = None
    paths: list[list[bytes]] = []
    out: list[list] = []

    def flush() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return done

    for batch in batches:
        for c, part, t, w in zip(*(batch.column(x).to_pylist() for x in ("c", "part", "t", "w"))):
            if part < 0:
                if last is not None:
                    out.append(last)
                last, paths = [c, 0, None, ROOT, 0, True, []], [[ROOT]]
            else:
                last[5] = False
                out.append(last)
                depth, parent = last[1] + 1, last[3]
                node, ups, unit = hashlib.sha256(parent + t).digest(), [], depth
                for level in range(64):
                    if level == len(paths):  # the root is the first top of every level
                        paths.append([ROOT])
                    ups.append(list(paths[level]))
                    if unit % SEGMENT:
                        paths[level].append(node)
                        break
                    paths[level], unit = [node], unit // SEGMENT
                last = [c, depth, parent, node, w, True, ups]
            if len(out) >= 4096:
                yield flush()
    if last is not None:
        out.append(last)
    if out:
        yield flush()


def _ups(level: int) -> tuple:
    """(depth, node) of a node's ancestors of a level, to be exploded."""
    unit = SEGMENT**level
    first = F.floor((F.col("depth") / unit - 1) / SEGMENT).cast("long") * SEGMENT
    return F.transform(F.col("ups")[level], lambda x, p: F.struct(((first + p) * unit).alias("depth"), x.alias("node")))


def subtree_sums(nodes: DataFrame, values: list[str], deepest: int, level: int = 0) -> DataFrame:
    """(depth, node, ``values``) summed over each node's subtree, itself included; ``nodes`` has depth, node, ups and ``values``."""
    unit, summed = SEGMENT**level, [F.sum(v).alias(v) for v in values]
    inner = nodes.where(F.col("depth") / unit % SEGMENT != 0)
    up = lambda df, ups: df.select(F.explode(ups).alias("up"), *values).select("up.*", *values)
    local = nodes.select("depth", "node", *values).unionByName(up(inner, _ups(level))).groupBy("depth", "node").agg(*summed)
    if deepest < unit * SEGMENT:
        return local
    local = stored(local, f"subtrees-{level}")
    top = F.col("depth") % (unit * SEGMENT) == 0
    tops = nodes.where(top).select("depth", "node", "ups")
    whole = stored(subtree_sums(tops.join(local, ["depth", "node"]), values, deepest, level + 1), f"tops-{level}")
    # what lies under a top goes to the nodes between it and the top above, which has it already
    passed = up(tops.where("depth > 0").join(whole, ["depth", "node"]), F.slice(_ups(level), 2, SEGMENT))
    return whole.unionByName(local.where(~top).unionByName(passed).groupBy("depth", "node").agg(*summed))


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's runs of ids, which come in order."""
    at, state = None, None
    for batch in batches:
        done = []
        for depth, node, run in zip(*(batch.column(x).to_pylist() for x in ("depth", "node", "run"))):
            if (depth, node) != at:
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (depth, node), hashlib.sha256(run.encode())
            else:
                state.update(b"," + run.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.string()))], ["depth", "node", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.binary()), pa.array([state.hexdigest()])], ["depth", "node", "ends_sha256"])


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of ``conversations`` (rows as of ``rebuilt``): node (digest), depth, conv_id (smallest member), parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation without turns is a member of the root alone and ends there; no conversations give no rows, not even a root. Equal
    conversations share all nodes. Texts of any length are 32 bytes here. A turn with an empty text is a turn of 0 words.
    """
    chained = conversations.repartition("c").sortWithinPartitions("c", "part", "i").select("c", "part", "t", "w").mapInArrow(_chain, PREFIX)
    prefixes = stored(chained, "prefixes")
    per = prefixes.groupBy("depth", "node").agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.count_if("ends").alias("n_ends"), F.max("parent").alias("parent"), F.max("w").alias("w"), F.any_value("ups").alias("ups"))
    nodes = stored(per.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("w")).withColumn("n_leaves", (F.col("n_convs") == F.col("n_ends")).cast("long")), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(nodes, ["saved_tokens", "n_leaves"], deepest)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    runs = prefixes.where("ends").groupBy("depth", "node", F.shiftright("c", RUN_BITS).alias("k")).agg(F.array_join(F.sort_array(F.collect_list("c")), ",").alias("run"))
    ends = runs.repartition("depth", "node").sortWithinPartitions("depth", "node", "k").select("depth", "node", "run").mapInArrow(_hash_runs, "depth long, node binary, ends_sha256 string")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.select("depth", "node", "parent", "conv_id", "n_convs").join(above, ["depth", "parent"], "left")
    joined = named.join(sums, ["depth", "node"]).join(children, ["depth", "node"], "left").join(ends, ["depth", "node"], "left")
    return joined.select(
        "node", "depth", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
    )


ORACLE = """
WITH RECURSIVE turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
digits AS (SELECT DISTINCT c, c::VARCHAR AS s FROM turns),
crc AS (SELECT c, s, 0 AS k, 4294967295::BIGINT AS x FROM digits UNION ALL
  SELECT c, s, k + 1, list_reduce(list_concat([xor(x, ascii(s[k + 1])::BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) FROM crc WHERE k < length(s)),
heads AS (SELECT c, xor(x, 4294967295) % 4 AS h FROM crc WHERE k = length(s)),
parts AS (SELECT c, 1 AS part, i, t FROM turns JOIN heads USING (c) WHERE i > h
  UNION ALL SELECT heads.c, 0, i, t FROM heads JOIN turns ON turns.c = heads.c - heads.c % 20 AND i <= h),
whole AS (SELECT heads.c, coalesce(l, []) AS l FROM heads LEFT JOIN (SELECT c, list(t ORDER BY part, i) AS l FROM parts GROUP BY c) p ON p.c = heads.c),
prefixes AS (SELECT c, len(l) AS n, unnest(range(0, len(l) + 1)) AS depth, l FROM whole),
nodes AS (SELECT depth, l[1:depth] AS node, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN n = depth THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM prefixes GROUP BY 1, 2),
told AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[depth].t, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM nodes),
children AS (SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_ AS (SELECT told.*, coalesce(n_children, 0) AS n_children FROM told LEFT JOIN children USING (depth, node)),
ups AS (SELECT unnest(range(0, depth + 1)) AS d, node, saved, n_children FROM full_),
sums AS (SELECT d AS depth, node[1:d] AS node, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves FROM ups GROUP BY 1, 2)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sums USING (depth, node) LEFT JOIN nodes p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.node = f.node[1:f.depth - 1]
"""
