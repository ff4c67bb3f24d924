"""A content-addressed WARC archive: each payload once, under its verified SHA-256; exact record headers in a table beside it.

``write`` gives every row a WARC/1.1 record. Of rows whose payloads are equal and have at least ``least`` bytes, the one with the
smallest key is a ``response`` that holds the payload; the others are ``revisit`` records that name it. Archives are gzip members, one
for each record. The ``headers`` table keeps each record's exact header block and its digest; ``reconstruct`` joins headers with
payloads on the digest to give the original records back.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm._shared import stored, text_slices

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LEAST = 100
#: An archive is closed when it holds so many bytes.
ARCHIVE_BYTES = 1 << 30
_BATCH = 4 << 20
_HEADERS = "key long, digest string, record_type string, refers_to long, header binary, archive string"
_PARSED = [("key", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("header", pa.binary()), ("payload", pa.binary())]


def header(key: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, length: int) -> bytes:
    """The header block of a record, its closing empty line included. Control characters of a URL are percent-encoded."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return "\r\n".join([*lines, "", ""]).encode()


def parse(record: bytes) -> dict:
    """Key, type, refers_to, digest, header block and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    kind = fields["WARC-Type"]
    return {"key": number("WARC-Record-ID"), "record_type": kind, "refers_to": number("WARC-Refers-To") if kind == "revisit" else None, "digest": fields["WARC-Payload-Digest"][7:], "header": head + b"\r\n\r\n", "payload": block[len(HTTP) :] if kind == "response" else None}


def _members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The members of a gzip stream, one after the other."""
    data = b""
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            data = data or stream.read(size)
            if not data:
                if parts or inflate.unconsumed_tail:
                    raise EOFError("the archive ends within a record")
                return
            parts.append(inflate.decompress(data))
            data = inflate.unused_data
        yield b"".join(parts)


def write(df: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST) -> None:
    """Archives and the ``headers`` table under ``path``.

    Roles come from one small aggregation (digest, least key) that is joined back on the digest. Its side is hashed within each
    partition, which spares sorting payloads: a partition of it has some hundred bytes for each distinct digest beside the payloads
    of those digests themselves, so it is bounded by its share of the other side; a digest with very many rows is split by the
    join's skew handling. Each task attempt writes files of its own name;
    those that no committed header names are removed at the end. A null body is an empty payload, a null URL leaves its field out, a
    null key never is the smallest; a long payload is written in slices, but one record is held whole by the task that reads it; rows equal in key and payload are all responses; extra columns are left out; an empty table gives
    an empty archive.
    """
    spark = df.sparkSession
    payload = F.encode(F.coalesce(F.col(f"`{body}`"), F.lit("")), "UTF-8")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    roles = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("key").alias("first"))
    first = F.col("first")
    is_response = first.isNull() | F.col("key").eqNullSafe(first)
    records = rows.join(roles.hint("shuffle_hash"), "digest", "left").select("key", "url", "digest", F.when(is_response, "response").otherwise("revisit").alias("record_type"), F.when(~is_response, first).alias("refers_to"), F.when(is_response, F.col("payload")).alias("payload"))
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(f"{root}/archives", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(path)[0]
        fs.create_dir(f"{root}/archives", recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in (part for whole in batches for part in text_slices(whole, "payload")):
                found = []
                for r in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/archives/{name}", compression=None)
                    body = r["payload"]
                    if body is not None and hashlib.sha256(body).hexdigest() != r["digest"]:
                        raise ValueError(f"the payload of {r['key']} differs from its digest")
                    block = HTTP + (body or b"")
                    head = header(r["key"], r["url"], r["record_type"], r["refers_to"], r["digest"], len(block))
                    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
                    member = deflate.compress(head + block + b"\r\n\r\n") + deflate.flush()
                    out.write(member)
                    at += len(member)
                    found.append({"key": r["key"], "digest": r["digest"], "record_type": r["record_type"], "refers_to": r["refers_to"], "header": head, "archive": name})
                yield pa.RecordBatch.from_pylist(found, pa.schema([("key", pa.int64()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("header", pa.binary()), ("archive", pa.string())]))
        finally:
            if out is not None:
                out.close()

    records.mapInArrow(run, _HEADERS).write.parquet(f"{path}/headers")
    named = {r.archive for r in spark.read.schema(_HEADERS).parquet(f"{path}/headers").select("archive").distinct().collect()}  # a name for each writing task
    for f in fs.get_file_info(pafs.FileSelector(f"{root}/archives")):
        if f.base_name not in named:
            fs.delete_file(f.path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record as parsed from the archives: key, record_type, refers_to, digest, header, payload (null for revisits)."""
    root = pafs.FileSystem.from_uri(path)[1]
    names = spark.read.schema(_HEADERS).parquet(f"{path}/headers").select("archive").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(path)[0]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/archives/{name}", compression=None) as f:
                    for member in _members(f):
                        rows.append(parse(member))
                        held += len(member)
                        if held >= _BATCH:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(_PARSED))
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, pa.schema(_PARSED))

    return names.repartition(max(1, names.count())).mapInArrow(run, "key long, record_type string, refers_to long, digest string, header binary, payload binary")


def payload_facts(spark: SparkSession, path: str) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to of each record, counted and hashed anew from the stored payloads."""
    records = read(spark, path).select("key", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    records = stored(records, "warc-facts")
    held = records.where("record_type = 'response'")
    wrong = F.raise_error(F.concat(F.lit("a payload differs from the digest of record "), F.col("key").cast("string")))
    checked = lambda c: F.when(F.col("digest") == F.col("payload_digest"), F.col(c)).otherwise(wrong)
    payloads = held.where(F.col("key").isNotNull()).select(F.col("key").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to", "payload_digest"]).withColumn("digest", F.col("payload_digest"))
    again = records.where("record_type = 'revisit'").select("key", "record_type", "refers_to", "digest").join(payloads, ["refers_to", "digest"], "left")
    columns = [F.col("key"), checked("payload_bytes").alias("payload_bytes"), checked("payload_digest").alias("payload_digest"), F.col("record_type"), F.col("refers_to")]
    return held.select(columns).unionByName(again.select(columns))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """key and ``record``: the original record of each row, its header block from the table, its payload by a join on the digest."""
    payloads = read(spark, path).where("record_type = 'response'").select("digest", "payload").dropDuplicates(["digest"])
    headers = spark.read.schema(_HEADERS).parquet(f"{path}/headers")
    return headers.join(payloads, "digest", "left").select("key", F.concat("header", F.lit(HTTP), F.coalesce("payload", F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record"))


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS s FROM p),
f AS (SELECT *, CASE WHEN n >= {LEAST} THEN min(page_id) OVER (PARTITION BY s) ELSE page_id END AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, s AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
