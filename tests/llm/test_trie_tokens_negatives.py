"""Operators 11 to 13 against the tokenizers library and brute force, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewake.llm import byte_bpe, hard_negatives, prefix_trie
from tidewake.llm.queries import BYTE_MODEL

# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_MODEL)


def same_as_library(library, texts):
    bpe = byte_bpe.encoder(BYTE_MODEL)
    flat, lengths = bpe.encode(texts)
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    assert bpe.decode(flat, lengths).to_pylist() == library.decode_batch(want, skip_special_tokens=False) == [t or "" for t in texts]


def test_bytes_random_texts(library):
    rng = random.Random(5)
    marks = ["a", "b", "th", "ing", " ", "  ", "\n", "\t", "12", "!", "é", "ß", "日", "🙂", "\x00", "\x1c", " ", "<|endoftext|>", "<|endof", "'s", "'LL", "՘", "\U0001f9ff", "Ā"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(rng.choice("etaoinshrdluXY") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("aA-=_ \n") for _ in range(rng.randint(1, 300))) for _ in range(500)]
    same_as_library(library, texts)


def test_bytes_runs_and_tokens_in_a_row(library):
    """Pieces that force the encoder back: runs of one letter, and tokens put side by side."""
    rng = random.Random(6)
    tokens = sorted(byte_bpe.encoder(BYTE_MODEL).tokens)
    texts = [c * n for c, n in product("aA= -\n", range(1, 90))]
    texts += ["".join(rng.choice(tokens) for _ in range(5)).encode("latin-1").decode("utf-8", "ignore") for _ in range(5000)]
    same_as_library(library, [*texts, None, "", "<|endoftext|>"])


def test_bytes_decode_of_any_ids(library):
    rng = random.Random(7)
    ids = [[rng.randrange(50257) for _ in range(12)] for _ in range(500)]
    got = byte_bpe.encoder(BYTE_MODEL).decode(np.array(ids).ravel(), np.full(len(ids), 12)).to_pylist()
    assert got == library.decode_batch(ids, skip_special_tokens=False)


def test_bytes_long_piece_is_linear():
    import time

    bpe = byte_bpe.Encoder(BYTE_MODEL)
    spent = []
    for n in (100_000, 400_000):
        t = time.perf_counter()
        bpe.encode(["ab" * n])
        spent.append(time.perf_counter() - t)
    assert spent[1] < 12 * spent[0] + 1


def test_bytes_refuses_other_models(tmp_path):
    import json

    spec = json.load(open(BYTE_MODEL, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        byte_bpe.Encoder(str(tmp_path / "t.json"))


def test_bytes_odd_table(spark, library, monkeypatch):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "twice <|endoftext|> here"), (3, "twice <|endoftext|> here"), (4, "long text, " * 30_000), (5, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit("clash"))
    got = byte_bpe.encode_decode(df, BYTE_MODEL).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got) == sorted((str(i), ids, t) for i, ids, t in want)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got) and byte_bpe.encode_decode(df.limit(0), BYTE_MODEL).count() == 0
    monkeypatch.setattr(byte_bpe, "PIECES", 50)  # a text in many runs
    texts = [t for _, t in rows[:6]] + ["a b <|endoftext|> c " * 200]
    flat, lengths = byte_bpe.Encoder(BYTE_MODEL).encode(texts)
    assert flat.tolist() == [i for t in texts for i in library.encode(t or "", add_special_tokens=False).ids]


# ---------------------------------------------------------------- prefix trie


def brute_trie(rows, every=20, most=4):
    original = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            original[c].append(((turn is not None, turn or 0, r, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()), (r, t)))
    original = {c: [x for _, x in sorted(v)] for c, v in original.items()}
    built = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % most
        base = int(c - np.fmod(c, every))
        built[c] = tuple(original.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        here = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += here
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def spark_trie(spark, rows, **extra):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for c in ("c", "i", "t", "w", "part", "depth", "node"):
        df = df.withColumn(c, F.lit("clash"))
    nodes = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.numbered_turns(df)))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in nodes.select(*cols).collect()), key=repr)


def test_trie_random(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(0, 60), 400, 401, 419, -1, -21, -40]:
        for turn in range(rng.randint(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn else "user", " ".join(rng.choice(["a", "b"]) for _ in range(rng.randint(0, 3)))))
    assert spark_trie(spark, rows) == brute_trie(rows)


def test_trie_odd(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, None, "", ""), (2, 1, "user", "a b"), (2, 1, "user", "a b"), (2, 1, "user", "z"), (2, None, "user", "first"), (20, 0, "user", "long " * 50_000), (21, 0, "", "user"), (22, 0, "user", ""), (7, 0, "u", " one　word\x0btwo")]
    assert spark_trie(spark, rows) == brute_trie(rows)
    assert spark_trie(spark, [(8, 3, "u", "only turn")]) == brute_trie([(8, 3, "u", "only turn")])
    assert spark_trie(spark, []) == []


def test_trie_deep(spark):
    """Conversations of hundreds of turns: three levels of segments; rows grow with turns, not with their square."""
    rows = [(c, t, "u", f"w{t}" + (f" x{c}" if t >= at else "")) for c, n, at in ((40, 700, 1000), (41, 690, 300), (42, 300, 256), (43, 257, 16), (60, 16, 99), (80, 1, 1)) for t in range(n)]
    assert spark_trie(spark, rows) == brute_trie(rows)


def test_trie_many_ends(spark):
    """A node at which many conversations end: their ids are hashed in runs."""
    rows = [(c, 0, "u", "hello") for c in range(-300, 1500, 1)]
    assert spark_trie(spark, rows) == brute_trie(rows)


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=5):
    pool = sorted({(i, lab, tuple(v)) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v)})
    width = max([1, *(len(v) for *_, v in pool)])
    score = lambda a, b: sum(int(np.floor(256 * np.float64(np.float32(x)))) * int(np.floor(256 * np.float64(np.float32(y)))) for x, y in zip([*a, *[0] * width], [*b, *[0] * width]))
    out, seen = [], set()
    for i, lab, v in pool:
        if not is_anchor(i) or i in seen:
            continue
        seen.add(i)
        ranked = sorted((-score(v, w), j, m) for j, m, w in pool)
        for s, j, _ in [x for x in ranked if x[2] == lab and x[1] != i][:positives]:
            near = [x for x in ranked if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(near)]
    return sorted(out)


def spark_negatives(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").repartition(3)
    for c in ("id", "q", "h", "score", "codes", "lost"):
        df = df.withColumn(c, F.lit("clash"))
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label"))
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def vectors(n, dim, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    return [(i, int(rng.integers(0, 3)), (centres[rng.integers(0, 4)] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows_, anchors_", [(8192, 1024), (40, 4)])
def test_negatives_against_brute_force(spark, monkeypatch, rows_, anchors_):
    monkeypatch.setattr(hard_negatives, "ROWS", rows_)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors_)
    rows = vectors(300, 9, 3)
    got = spark_negatives(spark, rows)
    assert got and got == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_copies_and_ties(spark, monkeypatch):
    """A third of all rows hold one vector; scores tie in whole classes."""
    monkeypatch.setattr(hard_negatives, "ROWS", 50)
    rows = [(i, lab, [1.0, 0.5] if i % 3 == 0 else v[:2]) for i, lab, v in vectors(240, 2, 4)]
    rows += [(1000 + k, k % 2, [0.5, 0.5]) for k in range(40)] + rows[:20]
    assert spark_negatives(spark, rows) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [1.0, 0.25]), (3, None, [1.0, 0.5]), (4, 2, None), (5, 2, [None, 1.0]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]), (8, 2, []), (9, 2, [0.9]), (None, 2, [1.0, 0.25]), (10, 2, [-1.0, 0.0]), (11, 2, [1.0, 0.0]), (2, 2, [0.9, 0.5]), (0, 2, [0.8, 0.5])]
    got = spark_negatives(spark, rows)
    assert got and got == brute_negatives(rows, lambda i: i % 10 == 0)
    assert spark_negatives(spark, rows[3:4]) == spark_negatives(spark, []) == []


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    x, q = np.floor(256 * rng.normal(size=(500, 7))), np.floor(256 * rng.normal(size=(20, 7)))
    words = hard_negatives.fit_words(x[:300])
    codes, lost = hard_negatives.quantise(x, words)
    lower, upper = hard_negatives.look_up(q, codes, lost, words)
    assert ((lower <= q @ x.T) & (q @ x.T <= upper)).all() and (upper - lower).mean() < 0.6 * np.abs(q @ x.T).mean()


def test_trimmed_memory_encodes_the_same():
    from tidewake.llm.queries import WORD_MODEL
    from tidewake.llm.word_bpe import Encoder

    words = Encoder(WORD_MODEL, 50)
    import pyarrow as pa

    texts = pa.array([" ".join(f"word{k % n}" for k in range(n)) for n in (5, 40, 90, 200)])
    whole = Encoder(WORD_MODEL).encode(texts)
    for keep in (10, 0, 1000):
        got = words.encode(texts)
        assert all((a == b).all() for a, b in zip(got, whole))
        words.memory.trim(keep)
        assert len(words.memory.index) <= max(keep, 200) and (keep or len(words.memory.flat) == 0)


def test_packing_keeps_its_words_between_tasks():
    """op7: 300,000 words of a task needn't be encoded again by the next."""
    from tidewake.llm import packing
    from tidewake.llm._shared import WordMemory

    encoded = []
    memory = WordMemory(lambda words: (encoded.extend(words), (np.arange(len(words)), np.ones(len(words), np.int64)))[1], packing.WORDS)
    words = [str(k) for k in range(300_000)]
    memory.ids(words)
    memory.trim(packing.WORDS_BETWEEN)
    memory.ids(words)
    assert len(encoded) == 300_000
