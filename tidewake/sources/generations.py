"""Tables that change as a whole: generations of files, a manifest that names the live one, commit, abort and clean-up.

A write goes to a folder of its own. It becomes the table when the manifest, one small file, is replaced by a rename; until then, and if it
fails, readers see the old generation. The data source ``generations`` follows the manifest by the table's path, so readers need no new path after
a rebuild. What no manifest names is dead: it is deleted by ``sweep`` once it is old enough that nobody reads it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_live.json"


def _store(table: str) -> tuple[fs.FileSystem, str]:
    if "://" not in table and not table.startswith("file:"):
        return fs.LocalFileSystem(), table.rstrip("/")
    store, path = fs.FileSystem.from_uri(table)
    return store, path.rstrip("/")


def manifest(table: str) -> dict | None:
    """generation, files, schema and time of the live generation; None where there is none."""
    store, path = _store(table)
    if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


def publish(table: str, generation: str, files: list[str], schema: StructType, over: str | None) -> None:
    """Make ``generation`` the live one if that is still ``over``: a writer that another has overtaken fails."""
    store, path = _store(table)
    now = manifest(table)
    if (now or {}).get("generation") != over:
        raise RuntimeError(f"another write of {table} came first")
    new = f"{path}/{MANIFEST}.{generation}"
    with store.open_output_stream(new) as f:
        f.write(json.dumps({"generation": generation, "files": sorted(files), "schema": json.loads(schema.json()), "time": time.time()}).encode())
    store.move(new, f"{path}/{MANIFEST}")


class _Part(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


class GenerationWriter(DataSourceArrowWriter):
    """Each task writes one file; the driver commits all of them at once, or deletes them."""

    def __init__(self, table: str, schema: StructType, overwrite: bool):
        self.table, self.schema, self.overwrite = table, schema, overwrite
        self.generation = uuid.uuid4().hex
        live = manifest(table)
        self.over = live["generation"] if live else None
        self.before = [] if overwrite or not live else live["files"]
        if self.before and StructType.fromJson(live["schema"]).simpleString() != schema.simpleString():
            raise ValueError(f"{table} has other columns")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        store, path = _store(self.table)
        file, out = f"generation={self.generation}/{uuid.uuid4().hex}.parquet", None
        try:
            for batch in batches:
                if out is None:
                    store.create_dir(f"{path}/generation={self.generation}", recursive=True)
                    out = pq.ParquetWriter(f"{path}/{file}", batch.schema, filesystem=store, compression="zstd")
                out.write_batch(batch)
        finally:
            if out is not None:
                out.close()
        return _Part(file if out is not None else None)

    def commit(self, messages: list[_Part | None]) -> None:
        publish(self.table, self.generation, [*self.before, *(m.file for m in messages if m and m.file)], self.schema, self.over)

    def abort(self, messages: list[_Part | None]) -> None:
        store, path = _store(self.table)
        folder = f"{path}/generation={self.generation}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class _File(InputPartition):
    def __init__(self, file: str):
        self.file = file


class GenerationReader(DataSourceReader):
    """A partition for each file that the manifest names when the read is planned."""

    def __init__(self, table: str, schema: StructType):
        self.table, self.schema = table, schema
        self.files = (manifest(table) or {"files": []})["files"]

    def partitions(self) -> list[_File]:
        return [_File(f) for f in self.files] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.file:
            store, path = _store(self.table)
            with store.open_input_file(f"{path}/{partition.file}") as f:
                yield from pq.ParquetFile(f).iter_batches()


class Generations(DataSource):
    """``spark.read.format("generations").load(table)``; ``df.write.format("generations").mode("overwrite" or "append").save(table)``."""

    @classmethod
    def name(cls) -> str:
        return "generations"

    def schema(self) -> StructType:
        live = manifest(self.options["path"])
        if live is None:
            raise ValueError(f"no table at {self.options['path']}")
        return StructType.fromJson(live["schema"])

    def reader(self, schema: StructType) -> GenerationReader:
        return GenerationReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> GenerationWriter:
        return GenerationWriter(self.options["path"], schema, overwrite)


def write(df: DataFrame, table: str, mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(Generations)
    df.write.format("generations").mode(mode).save(table)


def read(spark: SparkSession, table: str) -> DataFrame:
    spark.dataSource.register(Generations)
    return spark.read.format("generations").load(table)


def sweep(table: str, older_than: float = 86_400.0) -> list[str]:
    """Delete files that the manifest doesn't name and that were last written over ``older_than`` seconds ago; their names.

    Readers that planned before a write keep their files for that long, and so do writes that haven't committed yet.
    """
    store, path = _store(table)
    live = {f"{path}/{f}" for f in (manifest(table) or {"files": []})["files"]}
    gone = []
    for info in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
        if info.type == fs.FileType.File and info.base_name != MANIFEST and info.path not in live and (info.mtime is None or info.mtime.timestamp() <= time.time() - older_than):
            store.delete_file(info.path)
            gone.append(info.path[len(path) + 1 :])
    for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(info.path)) and (info.mtime is None or info.mtime.timestamp() <= time.time() - older_than):
            store.delete_dir(info.path)
    return sorted(gone)
