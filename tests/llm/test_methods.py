"""Operators against libraries, brute force, exact round trips and held-out accuracy."""

import random
import time
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import DATA
from tidewake.llm import html_extract, line_dedup, near_dedup, packing, quality_classifier, quality_rules, sentencepiece_bpe, topk_search, word_bpe
from tidewake.llm._shared import WordMemory, offsets
from tidewake.llm.components import components
from tidewake.llm.queries import PIECE_MODEL, WORD_MODEL, queries, table


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abeinst ▁\n\té日0'.,<>|"), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=8))
def test_encoders_equal_their_libraries(texts):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    flat, lengths = sentencepiece_bpe.encoder(PIECE_MODEL).encode(texts)
    at = offsets(lengths)
    decoded = sentencepiece_bpe.encoder(PIECE_MODEL).model.decode_flat(flat, lengths)
    for k, t in enumerate(texts):
        want = pieces.encode(t)
        assert flat[at[k] : at[k + 1]].tolist() == want and decoded[k] == pieces.decode(want)
    words = Tokenizer.from_file(WORD_MODEL)
    flat, lengths = word_bpe.encoder(WORD_MODEL).encode(pa.array(texts, pa.string()))
    at = offsets(lengths)
    for k, t in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == words.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=30))
def test_decoding_any_ids(ids):
    import sentencepiece

    model = sentencepiece_bpe.piece_model(PIECE_MODEL)
    assert model.decode_flat(np.array(ids), np.array([len(ids)])) == [sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL).decode(ids)]


def test_long_runs_go_through_the_queue():
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rng = random.Random(3)
    texts = [" " * 9000, "".join(rng.choice("aeinst") for _ in range(9000)), "ab" * 5000, "\n" * 50 + " " * 1500 + "x"]
    flat, lengths = sentencepiece_bpe.encoder(PIECE_MODEL).encode(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] == [ref.encode(t) for t in texts]


def test_word_memory_forgets_and_stays_right():
    memory = WordMemory(lambda ws: (np.array([ord(c) for w in ws for c in w], np.int32), np.array([len(w) for w in ws], np.int64)), most=5, longest=3)
    rng = random.Random(1)
    for _ in range(50):
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(9)]
        flat, lengths = memory.ids(words)
        assert "".join(map(chr, flat)) == "".join(words) and lengths.tolist() == list(map(len, words))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 700), min_size=1, max_size=6).filter(any), st.booleans())
def test_schedule_fills_every_window(sizes, own):
    weights = [k * 7 % 5 + 1 for k in range(len(sizes))] if own else None
    s = packing.Schedule(sizes, weights, window=32)
    before = [0] * len(sizes)
    for k in range(s.windows + 1):
        sent, _ = s.sent(k)
        assert sum(sent) == min(32 * k, s.total) and all(a >= b for a, b in zip(sent, before)) and all(a <= n for a, n in zip(sent, sizes))
        if not own:  # a queue is never far from its share
            assert all(abs(a - n * sum(sent) / s.total) <= len(sizes) for a, n in zip(sent, sizes))
        before = sent
    seen = np.zeros(s.windows * 32, int)
    for q, n in enumerate(sizes):
        for _, length, k, place in s.pieces(q, 0, n) if n else ():
            seen[k * 32 + place : k * 32 + place + length] += 1
    assert (seen[: s.total] == 1).all() and not seen[s.total :].any()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 120), min_size=1, max_size=6).filter(any), st.booleans())
def test_schedule_is_deficit_round_robin(sizes, own):
    """One place after the other, with a counter for each queue that is carried from window to window."""
    weights = [k * 7 % 5 + 1 for k in range(len(sizes))] if own else sizes
    s = packing.Schedule(sizes, weights if own else None, window=16)
    deficit, sent, share = [Fraction(0)] * len(sizes), [0] * len(sizes), [Fraction(w, sum(weights)) for w in weights]
    for place in range(sum(sizes)):
        if place % 16 == 0:
            assert s.sent(place // 16)[0].tolist() == sent
        deficit = [d + w for d, w in zip(deficit, share)]
        q = max((q for q in range(len(sizes)) if sent[q] < sizes[q]), key=lambda q: ((deficit[q] - Fraction(1, 2)) / share[q], -q))
        deficit[q], sent[q] = deficit[q] - 1, sent[q] + 1
    assert s.sent(s.windows)[0].tolist() == sent == sizes


def test_a_schedule_of_many_queues_takes_bounded_time_and_memory():
    rng = random.Random(2)
    sizes = [rng.randint(1, 10**9) for _ in range(packing.MOST_QUEUES)]
    for weights in (None, [rng.randint(1, 1 << 48) for _ in sizes]):
        s, began = packing.Schedule(sizes, weights), time.time()
        for k in range(0, s.windows, s.windows // 20):
            assert s.sent(k)[0].sum() == k * packing.WINDOW
        assert time.time() - began < 5 and s.sent.cache_info().maxsize * 16 * len(sizes) <= packing.REMEMBERED


@pytest.mark.parametrize("most", [4096, 3])
def test_packing_at_targets(spark, monkeypatch, most):
    """Windows hold sources at their targets; also where sources outnumber the queues."""
    monkeypatch.setattr(packing, "MOST_QUEUES", most)
    ref = Tokenizer.from_file(WORD_MODEL)
    rng = random.Random(most)
    docs = [(i, " ".join(rng.choice(["harbour", "fog", "slept", "thin", "cover", "1917", "été"]) for _ in range(rng.randint(0, 60))), "abcdefgh"[i % 8]) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    targets = {"a": 0.5, "b": 0.25}
    rows = packing.pack(df, WORD_MODEL, 2, targets=targets, window=64).collect()
    ids = {i: [*ref.encode(t, add_special_tokens=False).ids, 2] for i, t, _ in docs}
    got = defaultdict(list)
    mix = defaultdict(lambda: defaultdict(int))
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got[r.doc_id]) and r.doc_tokens == len(ids[r.doc_id])
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        assert len(r.ids) == 4 * r.length and r.offset + r.length <= 64
        mix[r.sequence_id][docs[r.doc_id][2]] += r.length
    assert dict(got) == ids
    total = {x: sum(len(ids[i]) for i, _, s in docs if s == x) for x in "abcdefgh"}
    share = {x: targets.get(x, total[x] / sum(total.values())) for x in total}
    ends = min(total[x] / share[x] for x in total) * sum(share.values()) / 64  # until the first queue is empty
    sent = defaultdict(int)
    for k in range(int(ends) - 1):
        for x in mix[k]:
            sent[x] += mix[k][x]
        for x in targets:
            assert abs(sent[x] - 64 * (k + 1) * share[x] / sum(share.values())) < 8
    with pytest.raises(ValueError, match="at most"):
        packing.pack(df, WORD_MODEL, 2, targets={str(k): 1.0 for k in range(most + 1)})


def test_classifier_on_held_out_rows(spark):
    docs, labels = table(spark, DATA.replace("0.001", "0.01"), "documents"), table(spark, DATA.replace("0.001", "0.01"), "labels")
    rows = quality_classifier.classify(docs, quality_classifier.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 50 and (rows.predicted == rows.quality).mean() > 0.97
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    assert (good[:, None] > bad).mean() > 0.99
    assert not {"label", "lang", "source", "doc_id"} & set(quality_classifier.NAMES)


def test_repeated_words_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c", b"dd"][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 30))]
        grams = defaultdict(list)
        for i in range(len(words) - 2):
            grams[tuple(words[i : i + 3])].append(i)
        assert quality_rules.repeated_words(words) == len({p for at in grams.values() if len(at) > 1 for i in at for p in range(i, i + 3)})


def test_line_rules():
    bad = {"Home | News | Sport | Mail": "navigation", "a%% b## c$$ d&&": "punctuation", "BUY!! NOW!! Friends.": "punctuation", "next page": "punctuation", "Please ACCEPT COOKIES to go on with this page.": "boilerplate"}
    assert {x: quality_rules.line_verdict(x, False) for x in bad} == bad
    assert quality_rules.line_verdict("A plain sentence, of seven words or so.", False) is None
    clean = "\n".join(" ".join(f"word{i}x{k}" for k in range(12)) + "." for i in range(6))
    assert quality_rules.judge(clean)[6] and quality_rules.judge(clean + "\nHome | News | Sport | Mail")[8] == clean
    assert not quality_rules.judge("\n".join(f"Home{i} | News{i} | Sport{i} | Mail{i}" for i in range(30)))[6]


def _family(rng, words, n, edits):
    base = [rng.choice(words) for _ in range(200)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        yield " ".join(w)


@pytest.mark.parametrize("small", [24, 3])
def test_near_duplicates_by_brute_force(spark, monkeypatch, small):
    """Also with small nodes and blocks, so that block tasks, pivots and families that stay in parts are met."""
    if small < 24:
        monkeypatch.setattr(near_dedup, "EARLY_NODE", 2)
        monkeypatch.setattr(near_dedup, "SMALL_NODE", small)
        monkeypatch.setattr(near_dedup, "BLOCK", 16)
        monkeypatch.setattr(near_dedup, "FAMILY_BLOCK", 8)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts = [t for n, e in ((70, 8), (40, 3), (6, 2), (3, 1), (1, 0)) for t in _family(rng, words, n, e)] + ["one two", "one two", "ONE two", "", "x"] + [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    rng.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (t.lower().split() for t in texts)]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, percent=85).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}


def test_recall_of_trees():
    assert near_dedup.trees_for(0.85) == 19 and near_dedup.trees_for(0.8) == 27 and near_dedup.trees_for(1.0) == 1
    for s in (0.8, 0.85, 0.95):
        n = near_dedup.trees_for(s)
        assert near_dedup.recall(s, n) >= 1 - near_dedup.MISS > near_dedup.recall(s, n - 1) and near_dedup.recall(0.3, n) < 0.25
    with pytest.raises(ValueError, match="trees"):
        near_dedup.trees_for(0.2)
    assert near_dedup.least_alike(0.85, 76) < 0.85 * 76 < near_dedup.least_alike(0.999, 76)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 100 for k in range(101, 140)}, 201: 200, 202: 200}


def runs_of_20_words(lines):
    """By brute force: (start, stop) of runs of 20 words and more that are one line longer than a run of fewer, at either end."""
    words = [len(x.encode().split()) for x in lines]
    out = set()
    for i in range(len(lines)):
        j, n = i, 0
        while j < len(lines) and n < 20:
            n, j = n + words[j], j + 1
        if n >= 20:
            out.add((i, j))
        j, n = i + 1, 0
        while j > 0 and n < 20:
            n, j = n + words[j - 1], j - 1
        if n >= 20:
            out.add((j, i + 1))
    return out


def assert_lines_are_deduplicated(docs, lost):
    """Against all earlier documents, not owners only: of each run of 20 words that one of them has a line goes, and nothing else goes."""
    seen = set()
    for i, t in sorted(docs):
        lines = [x.strip(" \t\x0b\x0c\r") for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        gone, may = set(lost.get(i, ())), set()
        runs = runs_of_20_words(lines)
        for a, b in runs:
            if tuple(lines[a:b]) in seen:
                may |= set(range(a, b))
                assert gone & set(range(a, b)), (i, a, b)
        assert gone <= may, i
        seen |= {tuple(lines[a:b]) for a, b in runs}


def lost_lines(spark, docs, **how):
    return {r.doc_id: r.lines for r in line_dedup.deletions(spark.createDataFrame(docs, "doc_id long, text string"), **how).collect()}


def test_line_dedup_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, DATA.replace("0.001", "0.01"), "documents").select("doc_id", "text").collect()]
    lost = lost_lines(spark, docs)
    assert_lines_are_deduplicated(docs, lost)
    assert sum(map(len, lost.values())) > 100
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        full = [k for k, x in enumerate(t.split("\n")) if x.strip(" \t\x0b\x0c\r")]
        assert got[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in {full[g] for g in lost.get(i, ())})


@pytest.mark.parametrize("section", [24, 256])
def test_line_dedup_in_sections(spark, section):
    """Few kinds of lines, so that blocks overlap, repeat, move and lie over the borders of sections."""
    rng = random.Random(section)
    kinds = [" ".join(f"k{k}w{i}" for i in range(rng.choice([1, 2, 5, 9, 19, 20, 30]))) for k in range(40)]
    passages = [[rng.choice(kinds) for _ in range(rng.randint(2, 60))] for _ in range(6)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 8)):
            x = rng.choice(passages)
            a = rng.randrange(len(x))
            lines += x[a : a + rng.randint(1, 50)] + [f"own {i} {rng.randint(0, 99)}"] * rng.randint(0, 2)
        docs.append((i, "\n".join(lines)))
    assert_lines_are_deduplicated(docs, lost_lines(spark, docs, section=section))


def test_copies_whose_lines_have_other_owners(spark):
    lines = [f"a{k} b{k} c{k} d{k} e{k}" for k in range(5)]
    docs = [*((k + 1, lines[k]) for k in range(5)), (10, "\n".join(lines)), (11, "\n".join(lines))]
    assert lost_lines(spark, docs) == {11: [0, 1, 2, 3, 4]}


def test_a_long_document_in_reverse_order(spark):
    lines = [" ".join(f"x{k}y{i}" for i in range(21)) for k in range(40_000)]
    began = time.time()
    assert lost_lines(spark, [(1, "\n".join(lines)), (2, "\n".join(lines[::-1]))]) == {2: list(range(40_000))}
    assert time.time() - began < 60


def test_frequent_short_lines_are_anchored_by_their_runs(spark):
    """A passage and a document of short lines, and lines in other order, each in more documents than a rare line may be."""
    n = line_dedup.RARE + 10
    passage = [" ".join(f"w{k}x{i}" for i in range(10)) for k in range(6)]
    docs = [(i, "\n".join([f"only {i}", *passage, f"end {i}"])) for i in range(n)]
    docs += [(1000 + i, "\n".join(f"verse {k}" for k in range(30))) for i in range(n)]
    docs += [(2000 + i, "\n".join(f"stock {k}\nown {i} {k}" for k in range(30))) for i in range(n)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i].deleted_lines_ for i in range(n)] == [0] + [6] * (n - 1) and got[1].text == "only 1\nend 1"
    assert [got[1000 + i].deleted_lines_ for i in range(n)] == [0] + [30] * (n - 1)
    assert all(got[2000 + i].deleted_lines_ == 0 for i in range(n))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 25), min_size=1, max_size=30))
def test_runs_cover_every_line_of_a_block(words):
    """Whatever stands around a block, each of its lines is in a run that lies in it."""
    hashes = list(range(len(words)))
    assert bool(line_dedup.runs_of(hashes, words) or max(words) >= 20) == (sum(words) >= 20)
    inside = {h for _, h in line_dedup.runs_of(hashes, words)}
    around = {h for _, h in line_dedup.runs_of([-1, -2, *hashes, -3, -4], [3, 15, *words, 7, 19])}
    assert inside <= around


def test_moved_blocks_are_found():
    assert line_dedup.common_blocks([1, 2, 3, 4, 5, 6], [5, 6, 1, 2, 3, 9], [10] * 6) == [0, 1, 2, 3, 4]
    assert line_dedup.common_blocks([1, 1, 2], [1, 1, 1], [15, 15, 15]) == [0, 1]
    assert line_dedup.common_blocks([1, 2], [3, 1], [10, 10]) == []


def test_extra_copies_of_a_line_do_not_split_a_block():
    """X, Y, Z have 19 words, S 9: a stray S ahead, or repeated in the passage, leaves the block whole."""
    e, q, x, y, z, s = range(6)
    w = {e: 5, q: 5, x: 19, y: 19, z: 19, s: 9}
    blocks = lambda earlier, later: line_dedup.common_blocks(earlier, later, [w[k] for k in later])
    assert blocks([e, x, s, y], [s, x, s, y]) == [1, 2, 3]
    assert blocks([e, x, s, y, s, z], [s, q, x, s, y, s, z]) == [2, 3, 4, 5, 6]
    assert blocks([x, s, x, s], [q, x, s, x, s]) == [1, 2, 3, 4]  # no line is unique


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 8), max_size=25), st.lists(st.integers(1, 12), min_size=9, max_size=9))
def test_no_common_block_stays(earlier, later, of):
    """By brute force: no run of 20 words that stays is in the earlier document, and each line that goes is in such a run."""
    words = [of[k] for k in later]
    inside = {tuple(earlier[i:j]) for i in range(len(earlier)) for j in range(i + 1, len(earlier) + 1)}
    gone = set(line_dedup.common_blocks(earlier, later, words))
    may = set()
    for i in range(len(later)):
        for j in range(i + 1, len(later) + 1):
            if sum(words[i:j]) >= 20 and tuple(later[i:j]) in inside:
                assert gone & set(range(i, j))
                may |= set(range(i, j))
    assert gone <= may


def test_long_documents_of_few_lines_are_aligned_in_time():
    rng = np.random.default_rng(7)
    for kinds in (1, 2, 50):
        a, b = rng.integers(0, kinds, 20_000).tolist(), rng.integers(0, kinds, 20_000).tolist()
        assert len(line_dedup.common_blocks(a, b, [10] * 20_000)) > 19_000 / kinds


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 300), st.integers(1, 6), st.integers(1, 25), st.integers(0, 10**6))
def test_topk_by_brute_force(n, width, k, seed):
    rng = np.random.default_rng(seed)
    ids, rows = rng.permutation(1000)[:n], rng.integers(-5, 6, (n, width)).astype(float)
    query_ids, queries = ids[: max(1, n // 10)], rows[: max(1, n // 10)]
    q, r, s = topk_search.block_topk(ids, rows, query_ids, queries, k)
    got = defaultdict(list)
    for a, b, c in zip(q, r, s):
        got[int(a)].append((-int(c), int(ids[b])))
    for a in range(len(queries)):
        want = sorted((-int(rows[b] @ queries[a]), int(ids[b])) for b in range(n) if ids[b] != query_ids[a])[:k]
        assert sorted(got[a]) == want


def test_topk_over_many_blocks(spark, monkeypatch):
    """Blocks pass each query's floor on; one id has two vectors."""
    monkeypatch.setattr(topk_search, "ROWS", 40)
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-40, 41, 6) / 64]) for i in range(400)] + [(399, [0.5] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk_search.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    want = []
    for q, v in rows[:400:20]:
        best = sorted((-round(sum(64 * a * 64 * b for a, b in zip(v, w))), i) for i, w in rows if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_topk_carries_a_floor():
    """A query with a floor that nothing in the block reaches closes after the first step, and hands back nothing."""
    rows = np.random.default_rng(3).integers(0, 50, (3000, 4)).astype(float)
    q, _, _ = topk_search.block_topk(np.arange(3000), rows, np.array([5000, 5001]), np.ones((2, 4)), 20, [500, None])
    assert q.tolist() == [1] * 20


def test_topk_stops_early():
    """Rows in order of one long dimension: the threshold closes the query after a few steps."""
    rows = np.zeros((4000, 2))
    rows[:, 0] = np.arange(4000)
    seen = []
    real = np.flatnonzero
    try:
        np.flatnonzero = lambda x: seen.append(len(real(x))) or real(x)
        topk_search.block_topk(np.arange(4000), rows, np.array([5000]), np.array([[1.0, 0.0]]), 20)
    finally:
        np.flatnonzero = real
    assert sum(seen) < 500


def test_html_generated_pages_and_a_new_layout():
    trees = html_extract.model()
    exact = 0
    for k in range(60):
        w = html_extract._Writer(5 * 1_000_003 + k)
        page = html_extract.Page(w.page())
        kept = page.keep(trees.score(page.features()))
        exact += [t for _, t in page.pieces if any(x in w.main for x in t.split()[:2])] == [t for n, t in page.pieces if kept[n]]
    assert exact >= 56
    source = """<html><body><div class="top-menu"><a href=a>Home</a> <a href=b>News</a> <a href=c>About us</a></div><div id="cookie-notice"><p>We use cookies to make this site work. By going on you agree to that.</p><button>OK</button></div>
    <div class="wrap"><div class="post-content"><h1>A quiet &amp; long day</h1><p>The first paragraph of the story runs over some   words, and then, at last, it ends.<p>A second one says <em>a little</em> more,<br>as second ones do.
    <div class="ad-box">Buy our shoes today!</div><ul><li>first thing to know about the day</li><li>second thing to know about the day</li></ul></div>
    <div class="sidebar"><h3>Related</h3><ul><li><a href=x>Other story</a></li><li><a href=y>One more story</a></li></ul></div><div id="comments"><h3>Comments</h3><div class="comment"><b>Joe</b><p>I liked the story a lot, thank you for it.</p></div><form><input name=q><button>Send</button></form></div></div>
    <div class="footer">&copy; 2024 Somebody. All rights reserved.</div><script>document.write("<p>no</p>")</script></body></html>"""
    assert html_extract.extract_texts([source], trees) == ["A quiet & long day\n\nThe first paragraph of the story runs over some words, and then, at last, it ends.\n\nA second one says a little more, as second ones do.\n\nfirst thing to know about the day\n\nsecond thing to know about the day"]


@pytest.mark.parametrize(
    "source", ["<object>" * 125_000, "<div>" * 50_000 + "</span>" * 50_000, "<div><b></i>" * 60_000, "<a " * 300_000, '<a ">" ' * 140_000, "<!" * 400_000, "<div>" * 50_000 + "<li></li>" * 50_000, "<td><div>" * 80_000, "<" + "a" * 10**6 + '"'],
    ids=lambda x: x[:12],
)
def test_pages_of_a_megabyte_of_unclosed_or_stray_tags(source):
    began = time.time()
    html_extract.Page(source)
    assert time.time() - began < 15


def test_boxed_and_raw_elements():
    text = lambda source: [t for _, t in html_extract.Page(source).pieces]
    assert text("<p>a<object>x<b>y</object>b<svg/>c<svg>z</svg>d</p>") == ["abcd"]
    assert text("<p>a<object>x") == ["ax"] and text("<p>a<script>x") == ["a"] and text("<p>a<!-- x > y") == ["a"] and text("<p>a<title>x>y") == ["a"]
    assert text("<p>a</p><p>b <x") == ["a", "b <x"]


def test_hierarchy_has_no_kept_node_under_a_dropped_one():
    rng = np.random.default_rng(2)
    page = html_extract.Page("<div>a<div>b<p>c</p></div><div><p>d</p></div></div><div>e</div>")
    for _ in range(50):
        kept = page.keep(rng.normal(size=len(page.tag)))
        assert all(kept[page.parent[k]] for k in range(1, len(kept)) if kept[k])


@pytest.mark.parametrize("n", [3, 150, 150_000])
def test_tags_of_many_attributes_leave_no_text(n):
    page = html_extract.Page("<p>before</p><img " + "".join(f"a{i}='x>y' b=\">\" " for i in range(n)) + "><p>after</p>")
    assert [t for _, t in page.pieces] == ["before", "after"]


@pytest.mark.parametrize("source", ["<a '>' " * 150_000 + ">", '<a "' * 250_000 + ">", "<p a='\" b=\"'" * 90_000 + ">", "<a ' \" >" * 120_000, "<script '" * 100_000 + ">"])
def test_quotes_that_never_close_cost_linear_time(source):
    import time

    began = time.perf_counter()
    html_extract.Page(source)
    assert time.perf_counter() - began < 5


def test_ends_of_tags():
    end = lambda s: html_extract.TagEnds(s).after(2)
    assert end("<a>") == 2 and end("<a b='>'>") == 8 and end("<a b='> c>") == 6 and end("<a \"'\">'>") == 6


def test_pages_of_the_driver(spark):
    import html
    import re

    pages = table(spark, DATA, "pages")
    for r in html_extract.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = table(spark, DATA, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    states = []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        states.append(docs.toPandas())
        docs = spark.createDataFrame(states[-1], docs.schema)
    for s in states[:-1]:
        assert list(s.columns) == list(pipeline.COLUMNS)
    good = {r.doc_id for r in table(spark, DATA, "labels").where("quality = 1").collect()}
    scored, ruled, lined, near, packed = states
    assert len(good - set(scored.doc_id)) <= 0.03 * len(good)
    assert set(ruled.doc_id) == {r.doc_id for r in scored.itertuples() if quality_rules.judge(r.text)[6]}
    assert (lined.n_chars == lined.text.str.len()).all()
    # line dedup: each text is its predecessor's without some lines, and those are what brute force allows and asks for
    full = lambda t: [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
    lost, after = lost_lines(spark, list(zip(ruled.doc_id, ruled.text))), dict(zip(lined.doc_id, lined.text))
    assert_lines_are_deduplicated(list(zip(ruled.doc_id, ruled.text)), lost)
    for r in ruled.itertuples():
        stays = [x for k, x in enumerate(full(r.text)) if k not in set(lost.get(r.doc_id, ()))]
        assert (r.doc_id in after) == (bool(stays) or not full(r.text)) and full(after.get(r.doc_id, "")) == stays
    # near-duplicates: the least document of each component, all pairs compared
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for r in lined.itertuples() for w in [r.text.encode().lower().split()]}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert set(near.doc_id) == {i for i in sets if root(i) == i} <= set(before)
    assert dict(zip(near.doc_id, near.text)) == {i: after[i] for i in near.doc_id}
    # packing: every id of every text in one piece
    ref = Tokenizer.from_file(WORD_MODEL)
    tokens = {r.doc_id: len(ref.encode(r.text, add_special_tokens=False).ids) + 1 for r in near.itertuples()}
    assert packed.groupby("doc_id").length.sum().to_dict() == packed.groupby("doc_id").doc_tokens.first().to_dict() == tokens
    whole = pipeline.run(spark, DATA).toPandas()
    assert set(whole.doc_id) == set(near.doc_id)


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 11))
    assert all(callable(f) for f in queries().values())
