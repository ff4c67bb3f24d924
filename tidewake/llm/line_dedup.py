"""Line deduplication by pairwise alignment: documents that share rare lines or runs of lines are aligned, common blocks go from the later document.

1. Each document becomes a list of line hashes and word counts (lines without a word are left out).
2. A shared line is an anchor if it is rare: in at most ``RARE`` documents, or so long (``LONG`` words) that sharing it can't be chance.
   A shared run of lines is one in any number of documents: from each line on, and up to each line, the shortest run of ``LEAST_BLOCK``
   words. Each line of a common block of that many words is in such a run within the block, so no block is without an anchor, however
   short and frequent its lines are. An anchor's owner is the earliest document (least id) that holds it.
3. Each document is aligned with the owners of its anchors, so candidate pairs grow with lines, not with the square of a line's
   documents; a line's earliest holder never loses it, so every deleted line stays somewhere. Nothing is lost by leaving the other
   pairs out: a common block of any two documents is covered by shortest runs, each of these stands in its owner, which is no later
   than the earlier of the two, and so goes from the later one. What is aligned are sections of ``SECTION`` lines, which overlap by
   a run's length: an anchor joins the two sections that it starts in, so a document of many lines with many owners isn't repeated
   whole for each of them, and a pair's work is bounded.
4. Patience diff: lines that are unique in both documents, the longest increasing run of their places, each extended to equal
   neighbours on both sides; the ranges between are aligned in the same way. Blocks of at least ``LEAST_BLOCK`` words are deleted from
   the later document. What is left may hold moved blocks and blocks without a unique line: its longest common runs of that many words
   go too.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm._shared import list_array, stored, text_slices

RARE = 20
LONG = 20
LEAST_BLOCK = 20
#: Lines that start in a section; it also holds the ``LEAST_BLOCK`` lines behind them, as far as any run can reach.
SECTION = 256
_SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """(place among the ``\\n``-split lines, hash, words) of each line that holds a word; ends are stripped of ASCII white space."""
    places, hashes, words = [], [], []
    for i, line in enumerate((text or "").split("\n")):
        body = line.strip(_SPACE).encode()
        if body:
            places.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(body) - (1 << 63))
            words.append(len(body.split()))
    return places, hashes, words


def runs_of(hashes: list[int], words: list[int], least: int = LEAST_BLOCK) -> list[tuple[int, int]]:
    """(start, hash) of the shortest runs of at least ``least`` words from each line on and up to each line; runs of one line are left out."""
    ends = [0, *accumulate(words)]
    spans, n = set(), len(words)
    stop = 0
    for start in range(n):
        while stop < n and ends[stop] - ends[start] < least:
            stop += 1
        if ends[stop] - ends[start] < least:
            break
        spans.add((start, stop))
    start = 0
    for stop in range(1, n + 1):
        while ends[stop] - ends[start + 1] >= least:
            start += 1
        if ends[stop] - ends[start] >= least:
            spans.add((start, stop))
    flat = np.array(hashes, np.int64).tobytes()
    return [(a, xxhash.xxh3_64_intdigest(flat[8 * a : 8 * b], seed=1) - (1 << 63)) for a, b in sorted(spans) if b - a > 1]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first number, whose second numbers increase."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        t = bisect_left(tails, j)
        before[k] = at[t - 1] if t else -1
        if t == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[t], at[t] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _longest_ends(earlier: list[int], later: list[int]) -> list[int]:
    """For each place of ``later``, the length of the longest run of lines that ends there and stands in ``earlier`` (suffix automaton)."""
    step: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for x in earlier:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(step[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, at, n = [], 0, 0
    for x in later:
        while at and x not in step[at]:
            at = link[at]
            n = size[at]
        if x in step[at]:
            at, n = step[at][x], n + 1
        out.append(n)
    return out


def _free(to: list[int], k: int) -> int:
    while to[k] != k:
        to[k] = k = to[to[k]]
    return k


def common_blocks(earlier: list[int], later: list[int], words: list[int], least: int = LEAST_BLOCK) -> list[int]:
    """Places of ``later``'s lines (of ``words`` words each) in blocks of at least ``least`` words that stand in ``earlier``.

    No run of that many words that stays stands in ``earlier``; lines of two blocks that overlap count for one of them.
    """
    ends = [0, *accumulate(words)]
    gone = bytearray(len(later))
    ranges = [(0, len(earlier), 0, len(later))]
    while ranges:
        a, b, c, d = ranges.pop()
        if a >= b or ends[d] - ends[c] < least:
            continue
        times, of_later = Counter(earlier[a:b]), Counter(later[c:d])
        once = {h: i for i, h in enumerate(earlier[a:b], a) if times[h] == 1}
        anchors = _increasing([(j, once[h]) for j, h in enumerate(later[c:d], c) if of_later[h] == 1 and h in once])
        i, j = a, c
        for at, of in anchors:
            if at < j:  # in the block before
                continue
            s, t, e = at, of, len(later)
            while s > 0 and t > 0 and later[s - 1] == earlier[t - 1]:
                s, t = s - 1, t - 1
            ranges.append((i, max(t, i), j, max(s, j)))
            i, j = of + 1, at + 1
            while j < e and i < len(earlier) and later[j] == earlier[i]:
                i, j = i + 1, j + 1
            if ends[j] - ends[s] >= least:
                gone[s:j] = b"\1" * (j - s)
        if anchors and i < b and j < d:
            ranges.append((i, b, j, d))
    # what is left: moved blocks, and blocks without a line of their own; the longest first
    known, found = set(earlier), []
    left = [not g and h in known for g, h in zip(gone, later)]
    start = 0
    for stop in range(len(later) + 1):
        if stop < len(later) and left[stop]:
            continue
        if ends[stop] - ends[start] >= least:
            found.append((start, stop))
        start = stop + 1
    if found:
        runs = _longest_ends(earlier, [later[k] if left[k] else None for k in range(len(later))])
        heap = [(ends[k + 1 - runs[k]] - ends[k + 1], k + 1 - runs[k], k + 1) for s, t in found for k in range(s, t) if ends[k + 1] - ends[k + 1 - runs[k]] >= least]
        heapify(heap)
        # ends of what has gone since, from its starts and back
        after, before = list(range(len(later) + 1)), list(range(len(later) + 1))
        while heap:
            size, s, t = heappop(heap)
            s, t = _free(after, s), _free(before, t)
            if s >= t or ends[t] - ends[s] < least:
                continue
            if ends[s] - ends[t] > size:  # a block before has taken a part: wait for longer ones
                heappush(heap, (ends[s] - ends[t], s, t))
            else:
                gone[s:t] = b"\1" * (t - s)
                after[s:t] = [t] * (t - s)
                before[s + 1 : t + 1] = [s] * (t - s)
    return [k for k, g in enumerate(gone) if g]


def sections_of(hashes: list[int], words: list[int], section: int = SECTION) -> Iterator[tuple[int, int, list[int], list[int], list[int]]]:
    """(start, lines that start in it, their and the following lines' hashes and words, hashes of the runs that start in it)."""
    n, runs, at = len(hashes), runs_of(hashes, words), 0
    count = max(1, -(-(n - LEAST_BLOCK) // section))
    for k in range(count):
        start, stop = k * section, n if k == count - 1 else (k + 1) * section
        first = at
        while at < len(runs) and runs[at][0] < stop:
            at += 1
        end = min(n, stop + LEAST_BLOCK)
        yield start, stop - start, hashes[start:end], words[start:end], list({h for _, h in runs[first:at]})


def deletions(df: DataFrame, key: str = "doc_id", text: str = "text", section: int = SECTION) -> DataFrame:
    """(``key``, lines): the places, among lines with a word, that each document loses; only documents that lose some."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, found = [], []
                for d, t in zip(part.column("d").to_pylist(), part.column("text").to_pylist()):
                    for piece in sections_of(*lines_of(t)[1:], section):
                        ids.append(d)
                        found.append(piece)
                lists = [list_array(np.array([x for f in found for x in f[k]], kind), np.array([len(f[k]) for f in found], np.int64)) for k, kind in ((2, np.int64), (3, np.int32), (4, np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)), *lists], ["d", "s", "own", "h", "w", "r"])

    rows = df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("d"), F.col(f"`{text}`").alias("text"))
    whole = stored(rows.mapInArrow(split, "d long, s int, own int, h array<long>, w array<int>, r array<long>"), "lines")
    lines = whole.select("d", "s", "h", "w")
    runs = F.transform("r", lambda r: F.struct(r.alias("h"), F.lit(LONG).alias("w")))
    own = F.slice(F.arrays_zip("h", "w"), F.lit(1), F.col("own"))
    each = whole.select("d", "s", F.explode(F.concat(F.array_distinct(own), runs)).alias("l")).select("d", "s", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    shared = each.groupBy("h").agg(F.min(F.struct("d", "s")).alias("p"), F.count("*").alias("n"), F.max("w").alias("most"))
    # stored, so that the join below has a shuffle of its own on both sides and a hot line can be split
    anchors = stored(shared.where((F.col("n") > 1) & ((F.col("n") <= RARE) | (F.col("most") >= LONG))).select("h", F.col("p.d").alias("p"), F.col("p.s").alias("ps")), "anchors")
    pairs = stored(each.select("d", "s", "h").join(anchors, "h").where("d <> p").select("d", "s", "p", "ps").distinct(), "line-pairs")
    owners = pairs.select("p", "ps").distinct()
    earlier = lines.select(F.col("d").alias("p"), F.col("s").alias("ps"), "h").join(owners, ["p", "ps"], "left_semi")
    earlier = stored(earlier.groupBy("p", "ps").agg(F.min("h").alias("hp")), "owners")  # rows that repeat an id: one of them
    wanted = pairs.join(lines, ["d", "s"]).join(earlier, ["p", "ps"]).select("d", "s", "h", "w", "hp")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            d, out = [], []
            for key_, start, h, w, hp in zip(*(batch.column(c).to_pylist() for c in ("d", "s", "h", "w", "hp"))):
                if gone := common_blocks(hp, h, w):
                    d.append(key_)
                    out.append([start + k for k in gone])
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(out, pa.list_(pa.int32()))], ["d", "gone"])

    found = wanted.mapInArrow(align, "d long, gone array<int>").select("d", F.explode("gone").alias("i")).distinct()
    return found.groupBy("d").agg(F.sort_array(F.collect_list("i")).alias("lines")).withColumnRenamed("d", key)


ADDED = ("n_lines_", "deleted_lines_", "deleted_words_")


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", section: int = SECTION) -> DataFrame:
    """All columns of ``df``, its text without the deleted lines, and n_lines_, deleted_lines_ and deleted_words_ (of lines with a word).

    Null texts and texts without words lose nothing and stay as they are. A null id takes no part. Rows that repeat an id aren't compared
    with each other; an id's deletions hold for rows whose number of lines allows them. Line breaks between the lines that stay are
    kept. Columns of any name pass through; only those named as the three that are added give way to them. An empty table gives an
    empty one. Long texts are split whole and aligned section by section; one line of any length is one line.
    """
    names = [c for c in df.columns if c not in ADDED]
    plain = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    at, key_at = names.index(text), names.index(key)
    gone = deletions(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text, section).select(F.col(f"`{key}`").alias("gone_key"), F.col("lines").alias("gone"))
    joined = plain.join(gone, plain[f"c{key_at}"] == gone.gone_key, "left").drop("gone_key")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, f"c{at}"):
                new, n, deleted, words_gone = [], [], [], []
                for t, lost in zip(part.column(at).to_pylist(), part.column("gone").to_pylist()):
                    places, _, words = lines_of(t)
                    lost = [i for i in lost or () if i < len(places)]
                    n.append(len(places))
                    deleted.append(len(lost))
                    words_gone.append(sum(words[i] for i in lost))
                    if lost:
                        drop = {places[i] for i in lost}
                        t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop)
                    new.append(t)
                columns = [pa.array(new, pa.string()) if i == at else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (n, deleted, words_gone))], [*(f"c{i}" for i in range(len(names))), *ADDED])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    done = joined.mapInArrow(apply, f"{fields}, {', '.join(f'{c} long' for c in ADDED)}")
    return done.toDF(*names, *ADDED)
