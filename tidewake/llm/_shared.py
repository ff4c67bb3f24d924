"""Places and small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # not glibc
    _libc = None

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``; a temporary one only where that is unset and one machine does all."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="tidewake-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes (one row at least)."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64) + 64
    part = (np.cumsum(sizes) - sizes) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)
        give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker's peak is then that of one slice, not of all that its allocators have kept."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[s : s + n]`` for each start and length, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def list_array(flat: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets(lengths).astype(np.int32)), pa.array(flat))


class WordMemory:
    """Ids of words already seen by this worker, so that a word that comes often is encoded once.

    ``encode(words)`` gives (flat ids, lengths) of distinct words. Bounded: once ``most`` words are held, the half that was used more
    stays. Words of over ``longest`` characters are encoded anew each time.
    """

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int = 500_000, longest: int = 64):
        self.encode, self.most, self.longest = encode, most, longest
        self.index: dict = {}
        self._hold(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _hold(self, flat: np.ndarray, lengths: np.ndarray, uses: np.ndarray) -> None:
        self.flat, self.lengths, self.uses = flat, lengths, uses
        self.starts = np.cumsum(lengths) - lengths

    def trim(self, most: int) -> None:
        """Keep at most the ``most`` words that were used more, and hand the rest back: for the end of a task."""
        if len(self.index) > most:
            self._forget(most)
        give_back()

    def _forget(self, most: int) -> None:
        words = list(self.index)
        at = np.fromiter(self.index.values(), np.int64, len(words))
        uses = self.uses[at]
        keep = np.sort(np.argsort(-uses, kind="stable")[:most])
        at = at[keep]
        self.index = dict(zip(map(words.__getitem__, keep.tolist()), range(len(keep))))
        self._hold(ragged(self.flat, self.starts[at], self.lengths[at]), self.lengths[at], uses[keep] // 2)

    def _codes(self, words: list) -> np.ndarray:
        """The place of each word's ids; new words are encoded."""
        if len(self.index) > self.most or len(self.flat) > 16 * self.most:
            self._forget(self.most // 2)
        codes = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new = list(dict.fromkeys(map(words.__getitem__, missing.tolist())))
            flat, lengths = self.encode(new)
            base = len(self.starts)
            self.index.update(zip(new, range(base, base + len(new))))
            self._hold(np.concatenate([self.flat, flat.astype(np.int32)]), np.concatenate([self.lengths, lengths]), np.concatenate([self.uses, np.zeros(len(new), np.int64)]))
            codes[missing] = np.fromiter(map(self.index.__getitem__, map(words.__getitem__, missing.tolist())), np.int64, len(missing))
            for w in new:  # of long words the ids stay until the next clearing, the texts don't
                if len(w) > self.longest:
                    del self.index[w]
        return codes

    def _out(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.uses += np.bincount(codes, minlength=len(self.uses))
        lengths = self.lengths[codes]
        out, at = np.empty(int(lengths.sum()), np.int32), 0
        for k in range(0, len(codes), 1 << 16):  # in runs: the places to read are eight bytes an id
            n = lengths[k : k + (1 << 16)]
            size = int(n.sum())
            out[at : at + size] = ragged(self.flat, self.starts[codes[k : k + (1 << 16)]], n)
            at += size
        return out, lengths

    def ids(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word) of the words in order."""
        return self._out(self._codes(words))

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for an Arrow array of words: only distinct ones become Python objects."""
        coded = words.dictionary_encode()
        return self._out(self._codes(coded.dictionary.to_pylist())[np.asarray(coded.indices)])
