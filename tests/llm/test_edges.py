"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: defined results from every operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewake.llm import html_extract, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sentencepiece_bpe, token_files, topk_search, warc_store
from tidewake.llm._shared import scratch
from tidewake.llm.queries import PIECE_MODEL, WORD_MODEL

LONG = "The old harbour town slept under a thin cover of fog. " * 20_000
PARA = " ".join(f"word{i} of the first long passage" for i in range(12)) + "."
EXTRA = ["key", "n", "c1", "part", "queue", "d", "h", "w", "ids", "kept", "gone", "gone_key", "score_", "rep", "node", "x", "y", "k", "id", "v", "digest", "payload", "q", "start"]
ROWS = [
    (None, "text without an id here", "en", None, None),
    (1, None, "en", "a", 0),
    (2, "", None, "a", 0),
    (3, " \n\t ", "en", "b", 4),
    (4, PARA + "\nA tail of four words.", "en", "b", 9),
    (4, PARA + "\nA tail of four words.", "en", "b", 9),
    (5, PARA, "fr", "c", 9),
    (6, LONG, "en", "c", 9),
    (7, "one", "en", "", 3),
    (8, "x" * 50_000, "en", "a", 50_000),
    (9, "日本語の文 🙂 \x00 end", "ja", "a", 12),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_encode_decode(odd, none):
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rows = sentencepiece_bpe.encode_decode(odd, PIECE_MODEL).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in rows) == sorted((str(i), ref.encode(t or ""), ref.decode(ref.encode(t or ""))) for i, t, *_ in ROWS)
    assert sentencepiece_bpe.encode_decode(none, PIECE_MODEL).count() == 0


def test_classifier(spark, odd, none):
    labels = spark.createDataFrame([(i, (i or 0) % 2, 0) for i in (3, 4, 5, 6, 7, None)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(odd, labels)
    rows = quality_classifier.classify(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert quality_classifier.train(odd, labels.limit(0)) is None
    assert {r.score for r in quality_classifier.classify(odd, None).collect()} == {0.5}
    assert quality_classifier.classify(none, model).count() == 0
    kept = quality_classifier.classify(odd.withColumn("score", F.lit("clash")).withColumn("c0", F.lit("clash")), model, keep=("score", "text", "c0", "score_", "doc_id"))
    assert kept.columns == ["doc_id", "text", "c0", "score_", *quality_classifier.ADDED] and {r.score_ for r in kept.select("score_", "score").collect()} == {"clash"}


def test_classifier_of_repeated_ids(spark):
    """More rows than the bound: those of the lowest id hashes stay, long texts as well as short ones."""
    texts = [" ".join(["good words run on"] * (5 if k < 8 else 400)) + "." if k % 2 else "BUY!! | NOW!! | " * (5 if k < 8 else 400) for k in range(16)]
    docs = spark.createDataFrame([(i % 4 + 100, texts[i]) for i in range(16)], "doc_id long, text string")
    labels = spark.createDataFrame([(i + 100, i % 2) for i in range(4)], "doc_id long, quality int")
    seen = []
    real = quality_classifier.fit
    try:
        quality_classifier.fit = lambda x, y: seen.append(x) or real(x, y)
        quality_classifier.train(docs, labels, most=8)
    finally:
        quality_classifier.fit = real
    assert len(seen[0]) <= 8 and seen[0][:, 0].max() > 7 > seen[0][:, 0].min()


def test_rules(odd, none):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.apply_rules(odd).collect()}
    assert rows[1, 0].base_failed and not rows[1, 0].kept and rows[2, 0].cleaned == ""
    assert rows[6, 220_000].base_failed and rows[6, 220_000].n_repeat_words == 220_000
    assert rows[8, 1].word_chars == 50_000
    assert quality_rules.apply_rules(none).count() == 0
    kept = quality_rules.apply_rules(odd.withColumn("c0", F.lit("clash")), keep=("kept", "n_words", "c0", "text"))
    assert kept.columns[:3] == ["doc_id", "c0", "text"] and len(set(kept.columns)) == len(kept.columns) and kept.where("kept").count() <= len(ROWS)


def test_warc(spark, none):
    body = "<html>" + "b" * 200
    pages = spark.createDataFrame([(5, "u5", body), (3, "u\n3 é", body), (None, None, body), (4, None, "x"), (6, "u", "x"), (7, "u", None), (8, "u", ""), (3, "u3", body)], "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("key", F.lit("clash"))
    path = scratch(spark, "warc")
    warc_store.write(pages, path)
    got = sorted((str(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_store.payload_facts(spark, path).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [("3", 206, sha(body), "response", None)] * 2 + [("5", 206, sha(body), "revisit", 3), ("None", 206, sha(body), "revisit", 3)]
    want += [("4", 1, sha("x"), "response", None), ("6", 1, sha("x"), "response", None), ("7", 0, sha(""), "response", None), ("8", 0, sha(""), "response", None)]
    assert got == sorted(want)
    again = {r.key: bytes(r.record) for r in warc_store.reconstruct(spark, path).collect()}
    assert again[5].endswith(warc_store.HTTP + body.encode() + b"\r\n\r\n") and b"WARC-Refers-To: <urn:page:3>" in again[5]
    assert b"WARC-Target-URI: u%0A3%20" in b"".join(again.values()) + b"".join(bytes(r.header) for r in warc_store.read(spark, path).collect())
    empty = scratch(spark, "warc")
    warc_store.write(none.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html")), empty)
    assert warc_store.payload_facts(spark, empty).count() == 0


def test_token_files(spark, odd, none):
    ref = Tokenizer.from_file(WORD_MODEL)
    rows = token_files.round_trip(odd, scratch(spark, "tokens"), WORD_MODEL, 1).withColumn("crc", F.crc32("ids")).orderBy("start").collect()
    ids = {(i, t): ref.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in ROWS}
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (i, t, *_) in zip(rows, order):
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids[i, t])) and np.frombuffer(r.ids, "<u4").tolist() == ids[i, t]
        assert r.crc == zlib.crc32(np.array(ids[i, t], "<u4").tobytes())
        at += r.n_tokens
    assert len(rows) == len(ROWS)
    assert token_files.round_trip(none, scratch(spark, "tokens"), WORD_MODEL, 1).count() == 0


@pytest.mark.parametrize("targets", [None, {"a": 0.7, "b": 0.2}])
def test_packing(odd, none, targets):
    ref = Tokenizer.from_file(WORD_MODEL)
    rows = packing.pack(odd, WORD_MODEL, 2, targets=targets, window=64).collect()
    total = sum(len(ref.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS)
    assert sum(r.length for r in rows) == total
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for k, parts in windows.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or k == max(windows)
    assert sorted(windows) == list(range(-(-total // 64)))
    assert packing.pack(none, WORD_MODEL, 2).count() == 0


def test_html(spark, none):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>" + "Plain words run on here. " * 20), (4, "u", "<div>" * 3000 + "<p>" + "Deep words run on here, too. " * 30)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[1] == got[2] == "" and got[None].startswith("Plain words run on here.")
    assert html_extract.extract(none.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"))).count() == 0


def test_near_duplicates(odd, none):
    rows = near_dedup.near_duplicates(odd, percent=85).collect()
    by = {(r.doc_id, r.n_shingles): r for r in rows}
    assert len(rows) == len(ROWS) and by[1, 0].component_id == 1 and by[2, 0].kept
    null = next(r for r in rows if r.doc_id is None)
    assert null.component_id is None and null.kept
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_repeated_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, "y " + b)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert len(got) == 5 and {r.component_id for r in got} == {1}


def test_line_dedup(odd, none):
    rows = line_dedup.dedup_lines(odd)
    assert rows.columns == [*odd.columns, *line_dedup.ADDED]
    by = {(str(r.doc_id)): r for r in rows.collect()}
    assert by["5"].text == "" and by["5"].deleted_lines_ == 1 and by["4"].deleted_lines_ == 0
    assert by["1"].text is None and by["None"].deleted_lines_ == 0 and by["8"].text == "x" * 50_000
    assert line_dedup.dedup_lines(none).count() == 0


def test_topk(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [-2.0]), (None, [1.0, 1.0]), (20, [3.0, -1.0]), (2, [0.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.search(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 18432), (0, 2, 20, 10240), (0, 3, 1, 5120), (20, 1, 0, 10240), (20, 2, 1, 10240), (20, 3, 2, 10240)]
    assert topk_search.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk_search.search(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]
