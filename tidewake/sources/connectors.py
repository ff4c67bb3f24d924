"""Data sources that fetch: article searches over HTTP and post events over a websocket, each as raw JSON in a column ``value``.

``register(spark)`` names them ``article_search`` and ``post_stream``. What they give goes to ``landing.articles`` and ``landing.post_events``; fetching
runs in tasks, a partition for each language or span of time.
"""

from __future__ import annotations

import base64
import json
import os
import socket
import ssl
import struct
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: What is asked for where an option isn't given.
QUERY = 'disinformation OR propaganda OR "influence operation" OR "information warfare" OR manipulation'
SEARCH = {"mode": "ArtList", "format": "json", "timespan": "15min", "maxrecords": "250", "sort": "DateDesc"}
COLLECTION = "app.bsky.feed.post"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArticleSearch)
    spark.dataSource.register(PostStream)


class Part(InputPartition):
    def __init__(self, **what):
        super().__init__(what)


class ArticleSearch(DataSource):
    """One row for each answer. Options: url, query, mode, timespan, maxrecords, languages (comma-separated: a partition each), timeout, tries."""

    @classmethod
    def name(cls) -> str:
        return "article_search"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(dict(self.options))


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [Part(language=x.strip()) for x in self.options.get("languages", "").split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """An answer other than 200 gives no row; a connection that fails is tried again, then the task fails."""
        from tidewake.plans.health import with_retry

        o = self.options
        asked = {"query": o.get("query", QUERY), **{k: o.get(k, v) for k, v in SEARCH.items()}}
        if partition.value["language"]:
            asked["sourcelang"] = partition.value["language"]

        def get() -> str | None:
            try:
                with urllib.request.urlopen(f"{o['url']}?{urllib.parse.urlencode(asked)}", timeout=float(o.get("timeout", "30"))) as answer:
                    return answer.read().decode("utf-8", "replace") if answer.status == 200 else None
            except urllib.error.HTTPError:
                return None

        text = with_retry(get, retries=int(o.get("tries", "3")) - 1)
        if text is not None:
            yield (text,)


def messages(url: str, timeout: float) -> Iterator[str | None]:
    """Text messages of a websocket until the server ends it; None whenever ``timeout`` seconds pass without one."""
    at = urllib.parse.urlsplit(url)
    secure = at.scheme == "wss"
    link = socket.create_connection((at.hostname, at.port or (443 if secure else 80)), timeout)
    try:
        if secure:
            link = ssl.create_default_context().wrap_socket(link, server_hostname=at.hostname)
        key = base64.b64encode(os.urandom(16)).decode()
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        link.sendall(f"GET {path} HTTP/1.1\r\nHost: {at.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        held = b""

        def take(n: int) -> bytes:
            nonlocal held
            while len(held) < n:
                if not (more := link.recv(1 << 16)):
                    raise EOFError
                held += more
            out, held = held[:n], held[n:]
            return out

        while b"\r\n\r\n" not in held:
            if not (more := link.recv(1 << 16)):
                raise ConnectionError("the server closed during the handshake")
            held += more
        head, held = held.split(b"\r\n\r\n", 1)
        if b" 101" not in head.split(b"\r\n")[0]:
            raise ConnectionError(head.split(b"\r\n")[0].decode("latin-1"))
        parts: list[bytes] = []
        while True:
            try:
                while len(held) < 2:  # a pause is one between messages
                    if not (more := link.recv(1 << 16)):
                        return
                    held += more
            except TimeoutError:
                yield None
                continue
            try:
                first, size = take(2)
                if size & 127 > 125:
                    size = struct.unpack(*((">H", take(2)) if size & 127 == 126 else (">Q", take(8))))[0]
                body, kind = take(size), first & 15
            except EOFError:
                return
            if kind == 8:
                return
            if kind == 9:  # a ping: its body goes back, masked by zeros
                link.sendall(bytes([0x8A, 0x80 | len(body)]) + bytes(4) + body)
            elif kind in (0, 1):
                parts.append(body)
                if first & 128:
                    yield b"".join(parts).decode("utf-8", "replace")
                    parts = []
    finally:
        link.close()


class PostStream(DataSource):
    """One row for each event. Options: url, collection, timeout; in batches posts and seconds (read until either is reached); in streams start
    (microseconds), span (seconds that a micro-batch covers at most: its back-pressure).

    A stream's offsets are the events' own clock (``time_us``): a micro-batch asks the server for its span again when it runs again.
    """

    @classmethod
    def name(cls) -> str:
        return "post_stream"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _PostReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PostStreamReader(dict(self.options))


def _asked(o: dict, **more) -> str:
    return f"{o['url']}?{urllib.parse.urlencode({'wantedCollections': o.get('collection', COLLECTION), **more})}"


class _PostReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        most, until, n = int(o.get("posts", "500")), time.monotonic() + float(o.get("seconds", "300")), 0
        for text in messages(_asked(o), min(float(o.get("timeout", "60")), float(o.get("seconds", "300")))):
            if text is not None:
                n += 1
                yield (text,)
            if n >= most or time.monotonic() >= until:
                return


class _PostStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.at = options, None

    def initialOffset(self) -> dict:
        return {"time_us": int(self.options.get("start", "0"))}

    def latestOffset(self) -> dict:
        """Now, but no more than a span after what was handed out last."""
        now = int(self.options.get("now", time.time() * 1e6))
        self.at = min(now, (self.at if self.at is not None else self.initialOffset()["time_us"]) + int(float(self.options.get("span", "300")) * 1e6))
        return {"time_us": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at or 0, end["time_us"])
        return [Part(start=start["time_us"], end=end["time_us"])] if end["time_us"] > start["time_us"] else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        start, end = partition.value["start"], partition.value["end"]
        for text in messages(_asked(self.options, cursor=start), float(self.options.get("timeout", "60"))):
            if text is None:
                if time.time() * 1e6 >= end:
                    return  # nothing came after the span
                continue
            try:
                at = int(json.loads(text)["time_us"])
            except (ValueError, KeyError, TypeError):
                continue
            if at >= end:
                return
            if at >= start:
                yield (text,)
