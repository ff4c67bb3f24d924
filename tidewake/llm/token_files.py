"""Token files: flat unsigned integers with 64-bit document offsets, written by tasks and memory-mapped by readers.

A folder holds, for each partition ``p`` in key order, ``tokens-p.bin`` (little-endian uint16 or uint32, by the size of the
vocabulary), ``offsets-p.bin`` (uint64, one more than documents, from 0 within the file), ``keys-p.arrow`` (the documents' keys)
and a ``manifest`` table with each partition's base: the tokens of all partitions before it, a prefix sum over their totals.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tidewake.llm._shared import text_slices
from tidewake.llm.word_bpe import binary_array, encoder

#: Tokens that a reader hands over at once.
READ_TOKENS = 1 << 20
_MANIFEST = "part long, width int, documents long, tokens long, first_document long, first_token long"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Numbers:
    """Runs of a file's numbers: mapped into memory where the folder is a mounted one, else read range by range."""

    def __init__(self, fs: pafs.FileSystem, path: str, kind: np.dtype):
        self.kind = kind
        if isinstance(fs, pafs.LocalFileSystem):
            self.file, self.map = None, np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        else:
            self.file, self.map = fs.open_input_file(path), None

    def run(self, start: int, stop: int) -> np.ndarray:
        if self.map is not None:
            return np.asarray(self.map[start:stop])
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * size, start * size), self.kind)

    def all(self) -> np.ndarray:
        return self.run(0, len(self.map) if self.map is not None else self.file.size() // self.kind.itemsize)


def write(df: DataFrame, path: str, model_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, put ``end_id`` behind it, and write the ids to files under ``path`` in ascending order of ``key``.

    Returns the manifest (part, name, documents, tokens, first_document, first_token), which is also written to ``path``/manifest.
    One shuffle, by ranges of the key. Each task streams into files of its own attempt and renames them at the end, so a task that
    runs again leaves one whole set. Null texts are empty (the end id alone); long texts are encoded whole, a text being the least slice; null keys come first; equal keys are ordered by text;
    an empty table gives an empty manifest. Other columns are left out.
    """
    spark = df.sparkSession
    fs, root = _fs(path)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, fs, part = encoder(model_path), _fs(path)[0], TaskContext.get().partitionId()
        kind = np.dtype("<u2" if max(words.vocabulary, end_id + 1) <= 1 << 16 else "<u4")
        fs.create_dir(root, recursive=True)
        temp = f"{root}/.{part}-{uuid.uuid4().hex}"
        names = {x: f"{temp}-{x}" for x in ("tokens", "offsets", "keys")}
        total = documents = 0
        keys = None
        with fs.open_output_stream(names["tokens"]) as tokens, fs.open_output_stream(names["offsets"]) as offs, fs.open_output_stream(names["keys"]) as key_file:
            offs.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                for piece in text_slices(batch, text, 8 << 20):
                    flat, lengths = words.encode(piece.column(text), end_id)
                    tokens.write(flat.astype(kind).tobytes())
                    offs.write((total + np.cumsum(lengths)).astype("<u8").tobytes())
                    only = pa.RecordBatch.from_arrays([piece.column(key)], ["key"])
                    keys = keys or pa.ipc.new_file(key_file, only.schema)
                    keys.write_batch(only)
                    total, documents = total + len(flat), documents + len(lengths)
            if keys:
                keys.close()
        if not documents:
            for f in names.values():
                fs.delete_file(f)
            return
        for x, suffix in (("tokens", "bin"), ("offsets", "bin"), ("keys", "arrow")):
            fs.move(names[x], f"{root}/{x}-{part:06d}.{suffix}")
        yield pa.RecordBatch.from_pydict({"part": [part], "width": [kind.itemsize], "documents": [documents], "tokens": [total]}, pa.schema([("part", pa.int64()), ("width", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    ordered = df.select(key, text).repartitionByRange(key).sortWithinPartitions(key, text)
    sizes = ordered.mapInArrow(run, "part long, width int, documents long, tokens long").collect()  # a row for each partition
    rows, first_document, first_token = [], 0, 0
    for r in sorted(sizes, key=lambda r: r.part):
        rows.append((r.part, r.width, r.documents, r.tokens, first_document, first_token))
        first_document, first_token = first_document + r.documents, first_token + r.tokens
    manifest = spark.createDataFrame(rows, _MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return manifest


def read(spark: SparkSession, path: str, key_type: str = "bigint", key: str = "doc_id") -> DataFrame:
    """``key``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (little-endian uint32 bytes) from the files.

    One task maps one partition's files; documents are handed over in runs of about a million tokens, a longer one alone. Null keys and equal ones come as
    they were written; an empty manifest gives no rows.
    """
    root = urlparse(path).path if path.startswith("file:") else _fs(path)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = _fs(path)[0]
        for batch in batches:
            for r in batch.to_pylist():
                tokens = _Numbers(fs, f"{root}/tokens-{r['part']:06d}.bin", np.dtype(f"<u{r['width']}"))
                offs = _Numbers(fs, f"{root}/offsets-{r['part']:06d}.bin", np.dtype("<u8")).all().astype(np.int64)
                with pa.memory_map(f"{root}/keys-{r['part']:06d}.arrow") if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(f"{root}/keys-{r['part']:06d}.arrow") as f:
                    keys = pa.ipc.open_file(f).read_all().column("key").combine_chunks()
                    group = offs[:-1] // READ_TOKENS
                    cuts = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(keys)]
                    for a, b in zip(cuts, cuts[1:]):
                        lengths = np.diff(offs[a : b + 1])
                        ids = tokens.run(int(offs[a]), int(offs[b])).astype("<u4")
                        yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(offs[a:b] + r["first_token"]), pa.array(lengths), binary_array(ids, lengths)], [key, "start", "n_tokens", "ids"])

    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    parts = manifest.count()
    return manifest.select("part", "width", "first_token").repartition(max(1, parts)).mapInArrow(run, f"`{key}` {key_type}, start bigint, n_tokens bigint, ids binary")


def round_trip(df: DataFrame, path: str, model_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write, then read back."""
    write(df, path, model_path, end_id, key, text)
    return read(df.sparkSession, path, df.schema[key].dataType.simpleString(), key)
