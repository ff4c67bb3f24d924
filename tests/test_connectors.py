"""The fetching sources against local servers."""

import base64
import hashlib
import json
import socket
import struct
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidewake.sources import connectors, landing


@pytest.fixture(scope="module")
def search():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            seen.append(asked)
            lang = asked.get("sourcelang", "")
            body = b"broken {" if lang == "broken" else json.dumps({"articles": [{"title": f"T {lang}", "url": f"https://x.org/{lang}", "language": "French", "seendate": "20240506T070809Z"}]}).encode()
            self.send_response(503 if lang == "down" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}/doc", seen
    server.shutdown()


@pytest.fixture(scope="module")
def events():
    """A websocket server: 40 events a second apart, some in pieces, a ping and garbage between them; it starts at the cursor."""
    listener = socket.create_server(("127.0.0.1", 0))
    pongs = []

    def frame(kind, body, fin=True):
        n = len(body)
        size = bytes([n]) if n < 126 else b"\x7e" + struct.pack(">H", n) if n < 1 << 16 else b"\x7f" + struct.pack(">Q", n)
        return bytes([(128 if fin else 0) | kind]) + size + body

    def serve(link):
        head = b""
        while b"\r\n\r\n" not in head:
            head += link.recv(4096)
        lines = head.decode().split("\r\n")
        asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(lines[0].split()[1]).query))
        key = next(x.split(": ")[1] for x in lines if x.startswith("Sec-WebSocket-Key"))
        accept = base64.b64encode(hashlib.sha1((key + "258EAFA5-E914-47DA-95CA-C5AB0DC85B11").encode()).digest()).decode()
        out = f"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: {accept}\r\n\r\n".encode()
        for k in range(40):
            at = 1_000_000 * k
            if at < int(asked.get("cursor", "0")):
                continue
            record = {"text": f"a post of enough letters {k} " + "x" * (200 if k == 5 else 70_000 if k == 6 else 0), "createdAt": "2024-01-02T03:04:05Z"}
            body = json.dumps({"time_us": at, "kind": "commit", "did": "d", "commit": {"operation": "create", "collection": asked["wantedCollections"], "rkey": str(k), "record": record}}).encode()
            out += frame(9, b"hi") + frame(1, b"no json") if k == 3 else b""
            out += frame(1, body[:20], False) + frame(0, body[20:]) if k % 4 == 0 else frame(1, body)
        link.sendall(out)
        link.settimeout(0.5)
        try:
            pongs.append(link.recv(100))
        except OSError:
            pass
        link.sendall(frame(8, b""))
        link.close()

    def accept():
        while True:
            try:
                link, _ = listener.accept()
            except OSError:
                return
            threading.Thread(target=serve, args=(link,), daemon=True).start()

    threading.Thread(target=accept, daemon=True).start()
    yield f"ws://127.0.0.1:{listener.getsockname()[1]}/subscribe", pongs
    listener.close()


def test_article_search(spark, search):
    url, seen = search
    connectors.register(spark)
    got = landing.articles(spark.read.format("article_search").options(url=url, languages="fra, down,broken", maxrecords="7").load()).collect()
    assert [(r.title, r.language, str(r.published_at)) for r in got] == [("T fra", "fr", "2024-05-06 07:08:09")]
    assert {x["sourcelang"] for x in seen} == {"fra", "down", "broken"} and all(x["query"] == connectors.QUERY and x["maxrecords"] == "7" and x["sort"] == "DateDesc" for x in seen)
    assert landing.articles(spark.read.format("article_search").options(url=url).load()).count() == 1


def test_posts_in_a_batch(spark, events):
    url, pongs = events
    connectors.register(spark)
    got = landing.post_events(spark.read.format("post_stream").options(url=url, posts="500", seconds="20").load()).collect()
    assert [r.url.rpartition("/")[2] for r in got] == [str(k) for k in range(40)] and len(got[6].content) > 70_000
    assert pongs[0] == bytes([0x8A, 0x82]) + bytes(4) + b"hi"
    assert spark.read.format("post_stream").options(url=url, posts="10").load().count() == 10


def test_posts_as_a_stream(spark, events, tmp_path):
    """Spans of 15 seconds: each event once, over a restart too."""
    url, _ = events
    connectors.register(spark)

    def run(now):
        stream = spark.readStream.format("post_stream").options(url=url, span="15", now=str(now), timeout="2").load()
        q = landing.post_events(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        n = len([p for p in q.recentProgress if p.numInputRows])
        q.stop()
        return n

    assert run(22_000_000) == 2
    assert sorted(int(r.url.rpartition("/")[2]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(22))
    run(60_000_000)
    assert sorted(int(r.url.rpartition("/")[2]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(40))
