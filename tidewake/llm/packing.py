"""Packing token streams into fixed windows at target token proportions, by deficit round-robin over source queues.

Each source is a queue of tokens with a weight. With every place of a window each queue's deficit counter grows by its share of the
weights; the queue whose counter, less half a token, is largest for its weight is served and pays one token. Counters are carried over
windows and partitions: what a queue was short of in one window it gets in the next. After m places a queue that has sent s tokens
has the deficit m w / W - s, so the one served is always the one with the least (2 s + 1) / w: token ``t`` of a queue is due at
``(2 t + 1) / w``, and counters need not be kept. Served in that order, the tokens that each queue has sent before window ``k`` have a
closed form (``Schedule.sent``): tasks fill their own windows without seeing each other's. Within a window a queue's tokens lie
together. Only the last window is not full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm._shared import offsets, stored, text_slices
from tidewake.llm.word_bpe import binary_array, encoder

WINDOW = 4096
#: With more sources than this, those without a target share so many queues by hash: a schedule's cost and size stay bounded.
MOST_QUEUES = 4096
#: Words whose ids a worker remembers during a task, and between tasks, when other stages run in it.
WORDS, WORDS_BETWEEN = 600_000, 400_000
#: Bytes of windows' states that a worker remembers.
REMEMBERED = 8 << 20
_FRACTION = 80


class Schedule:
    """How many tokens each queue has sent before each window. Exact integers; the same wherever it is computed."""

    def __init__(self, sizes: list[int], weights: list[int] | None = None, window: int = WINDOW):
        self.sizes, self.window, self.total = [int(n) for n in sizes], window, int(sum(sizes))
        self.weights = [int(w) for w in weights or sizes]
        self.natural = weights is None
        self.windows = -(-self.total // window)
        self._size, self._weight = np.array(self.sizes, np.int64), np.array(self.weights, object)
        self.sent = lru_cache(maxsize=max(16, REMEMBERED // (16 * len(self.sizes) + 500)))(self._sent)

    def _due(self, q: int, t: int) -> int:
        return ((2 * t + 1) << _FRACTION) // self.weights[q]

    def _count(self, x: int) -> np.ndarray:
        """Tokens of each queue that are due at ``x`` or before. In Python's integers: products have over 64 bits."""
        due = ((self._weight * (x + 1) - 1 >> _FRACTION) + 1) >> 1
        return np.where(self._weight > 0, np.minimum(self._size, due), 0).astype(np.int64)

    def _time(self, want: int) -> int:
        """About when ``want`` tokens are due; ``_settle`` makes up for what doubles can't tell."""
        if self.natural:
            return (want << (_FRACTION + 1)) // self.total
        weight, size = self._weight.astype(float), self._size.astype(float)
        low, high = 0.0, float(np.max(np.divide(size, weight, out=np.zeros(len(size)), where=weight > 0)))
        for _ in range(64):
            mid = (low + high) / 2
            low, high = (low, mid) if np.minimum(size, weight * mid).sum() >= want else (mid, high)
        return int(high * 2.0 ** (_FRACTION + 1))

    def _sent(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens sent before window ``k``, their running sum over queues)."""
        want = min(k * self.window, self.total)
        if want == 0 or want == self.total:
            out = self._size * (want > 0)
        else:
            out = self._settle(self._count(self._time(want)), want)
        return out, np.cumsum(out) - out

    def _settle(self, sent: np.ndarray, want: int) -> np.ndarray:
        """Serve the most overdue tokens, or take back the least overdue ones, until ``want`` are sent."""
        sent = sent.tolist()
        more = want - sum(sent)
        if more > 0:
            heap = [(self._due(q, t), q) for q, (t, n) in enumerate(zip(sent, self.sizes)) if t < n]
            heapify(heap)
            for _ in range(more):
                q = heap[0][1]
                sent[q] += 1
                heapreplace(heap, (self._due(q, sent[q]) if sent[q] < self.sizes[q] else 1 << 400, q))
        elif more < 0:
            heap = [(-self._due(q, t - 1), -q) for q, t in enumerate(sent) if t]
            heapify(heap)
            for _ in range(-more):
                q = -heap[0][1]
                sent[q] -= 1
                heapreplace(heap, (-self._due(q, sent[q] - 1) if sent[q] else 1 << 400, -q))
        return np.array(sent, np.int64)

    def pieces(self, q: int, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, window, place in it) of each piece of a run of queue ``q``."""
        at, end = start, start + length
        k = min(self.windows - 1, at * self.total // (self.sizes[q] * self.window)) if self.natural else self._search(q, at)
        while self.sent(k)[0][q] > at:
            k -= 1
        while at < end:
            after, sums_after = self.sent(k + 1)
            upto = int(after[q])
            if upto > at:
                before, sums = self.sent(k)
                n = min(end, upto) - at
                yield at, n, k, int(sums_after[q] - sums[q]) + at - int(before[q])
                at += n
            k += 1

    def _search(self, q: int, at: int) -> int:
        low, high = 0, self.windows - 1
        while low < high:
            mid = (low + high + 1) // 2
            if self.sent(mid)[0][q] <= at:
                low = mid
            else:
                high = mid - 1
        return low


def pack(df: DataFrame, model_path: str, end_id: int, source: str = "source", key: str = "doc_id", text: str = "text", targets: dict[str, float] | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of every document: ``key``, start, length, doc_tokens, sequence_id, offset and ``ids`` (little-endian uint32 bytes).

    ``targets`` gives sources' token proportions; without it they are the corpus's own, so all queues end together. A source that
    ``targets`` leaves out gets its own share; one with a target of zero or less is refused, and so are over ``MOST_QUEUES`` targets. A
    source with a target has a queue of its own however many sources there are; of more than ``MOST_QUEUES`` sources the others share
    queues. Queues run in the order of partitions and rows.
    No text is shuffled: a first pass encodes and stores ids with each document's place in its partition's queues; the queues'
    bases over partitions are prefix sums over a small table (partitions x queues); a second pass cuts. Null texts are empty (the end
    id alone), long ones are encoded whole and cut freely, null keys are packed like others, an empty table gives no pieces, null sources share a queue with the empty source, equal rows are packed each, extra columns are left out, whatever their names.
    """
    spark = df.sparkSession
    if targets and min(targets.values()) <= 0:
        raise ValueError("targets must be above zero")
    if targets and len(targets) > MOST_QUEUES:
        raise ValueError(f"at most {MOST_QUEUES} targets")
    many = df.select(source).distinct().limit(MOST_QUEUES + 1).count() > MOST_QUEUES
    name = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    queue = F.concat(F.lit("="), name)
    if many:
        shared = F.concat(F.lit("#"), F.pmod(F.xxhash64(name), F.lit(MOST_QUEUES)).cast("string"))
        queue = F.when(name.isin(*targets), queue).otherwise(shared) if targets else shared
    key_type = df.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, sent = encoder(model_path, WORDS), TaskContext.get().partitionId(), {}
        kind = np.dtype("<u2" if max(words.vocabulary, end_id + 1) <= 1 << 16 else "<u4")
        for batch in batches:
            for rows in text_slices(batch, "text"):
                flat, lengths = words.encode(rows.column("text"), end_id)
                starts = []
                for q, n in zip(rows.column("queue").to_pylist(), lengths.tolist()):
                    starts.append(sent.get(q, 0))
                    sent[q] = starts[-1] + n
                yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("queue"), pa.array(np.full(len(starts), part, np.int64)), pa.array(starts, pa.int64()), pa.array(lengths), pa.array(np.full(len(starts), kind.itemsize, np.int32)), binary_array(flat.astype(kind), lengths)], ["key", "queue", "part", "local", "n", "width", "ids"])
        words.memory.trim(WORDS_BETWEEN)

    encoded = stored(df.select(F.col(f"`{key}`").alias("key"), queue.alias("queue"), F.col(f"`{text}`").alias("text")).mapInArrow(encode, f"key {key_type}, queue string, part long, local long, n long, width int, ids binary"), "packing", "snappy")
    shares = encoded.groupBy("queue", "part").agg(F.sum("n").alias("sum_n"))
    sizes = {r.queue: r.sum_n for r in shares.groupBy("queue").agg(F.sum("sum_n").alias("sum_n")).collect()}  # twice MOST_QUEUES rows at most
    names = sorted(sizes)
    total = sum(sizes.values())
    weights = None
    if targets:
        weights = [max(1, round((q[0] == "=" and targets.get(q[1:]) or sizes[q] / total) * (1 << 48))) for q in names]
    numbers = spark.createDataFrame([(q, i) for i, q in enumerate(names)], "queue string, q int")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # stored, so that its size is known when the join with the ids is planned: broadcast if small, else by its keys
    bases = stored(shares.withColumn("base", F.coalesce(F.sum("sum_n").over(before), F.lit(0))).join(numbers, "queue").select("queue", "part", "q", "base"), "bases")
    counts = [sizes[q] for q in names]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(counts, weights, window)
        for rows in (rows for batch in batches for rows in text_slices(batch, "ids", 1 << 20)):
            q, start, n = (rows.column(c).to_pylist() for c in ("q", "start", "n"))
            which, out = [], []
            for i in range(len(q)):
                for piece in schedule.pieces(q[i], start[i], n[i]):
                    which.append(i)
                    out.append(piece)
            which, out = np.array(which), np.array(out, np.int64).reshape(-1, 4)
            width = rows.column("width")[0].as_py()
            ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), f"<u{width}").astype("<u4")  # pieces lie in the ids' order
            first = offsets(np.array(n, np.int64))
            assert len(ids) == first[-1] == out[:, 1].sum()
            yield pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(which)), pa.array(out[:, 0] - np.array(start)[which]), pa.array(out[:, 1]), pa.array(np.array(n, np.int64)[which]), pa.array(out[:, 2]), pa.array(out[:, 3]), binary_array(ids, out[:, 1])], [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        schedule.sent.cache_clear()  # it refers to itself: without this its states would wait for the collector

    placed = encoded.join(bases, ["queue", "part"]).select("key", "q", (F.col("base") + F.col("local")).alias("start"), "n", "width", "ids")
    return placed.mapInArrow(cut, f"`{key}` {key_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
