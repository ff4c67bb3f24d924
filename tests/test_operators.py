"""Operators on small literal inputs: edges, properties, numpy checks, streams against batches."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.functions import register
from tidewake.functions import text as tx
from tidewake.operators import campaigns, clustering, components, fingerprint, follows, graph, lifecycle, relational, report, retention, sets, temporal, vectors
from tidewake.plans import storage
from tidewake.sources import landing
from tidewake.streaming import jobs

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_mojibake_and_titles(spark):
    assert one(spark, tx.fix_mojibake(F.col("s")), s="cafÃ© €") == "cafÃ© €"  # beyond Latin-1: left alone
    assert one(spark, tx.fix_mojibake(F.col("s")), s="cafÃ©") == "café"
    assert one(spark, tx.fix_mojibake(F.col("s")), s="cafÃ© â") == "café \ufffd"
    assert one(spark, tx.fix_mojibake(F.col("s")), s="plain é") == "plain é"
    assert one(spark, tx.unescape(F.col("s")), s="a &amp;lt; b &eacute;") == "a &lt; b é"
    assert one(spark, tx.normal_title(F.col("s")), s="A story — Site - x") == "A story"
    assert one(spark, tx.python_title_case(F.col("s")), s="it's o'neill 2nd éa") == "it's o'neill 2nd éa".title()
    assert one(spark, tx.truncated(F.col("s")), s="x" * 81) == "x" * 77 + "…"
    assert one(spark, tx.page_title(F.col("s")), s="<x><page_title>A\nB </PAGE_TITLE>") == "A\nB"
    assert one(spark, tx.is_printable(F.col("s")), s="abc\x01\x02\x03") is False


@pytest.mark.parametrize(
    ("url", "domain"), [("https://www.A-b.org/x?y", "a-b.org"), ("http://user@h.com:80/p", "user@h.com:80"), ("no scheme", ""), ("http:///p", ""), ("ftp://WWW.x.io#f", "x.io"), ("", "")]
)
def test_domains_of_odd_urls(spark, url, domain):
    assert one(spark, tx.domain_at_least(F.col("u"), 0), u=url) == domain


def test_tone(spark):
    assert one(spark, tx.parse_tone(F.col("s")), s="1,2,3,4,5,6,7").activity_density == 5.0
    for bad in ("1,2,3", "1,2,x,4,5,6", ""):
        assert one(spark, tx.parse_tone(F.col("s")), s=bad) is None


def test_landed_sources(spark):
    line = "\t".join(["id1", "20240102030405", "", "src", "https://a.org/b", "", "", "TAX;ELECTION", "", "loc", "", "ann;bob", "", "org", "", "1,2,3,4,5,6", "", "g", "", "img", "<PAGE_TITLE>T</PAGE_TITLE>"])
    lines = spark.createDataFrame([(line,), ("too\tshort",), ("\t" * 19,)], "value string")
    rows = landing.knowledge_rows(lines).collect()
    assert len(rows) == 2 and rows[0].themes == ["TAX", "ELECTION"] and rows[0].page_title == "T" and rows[1].tone is None and rows[1].published_at is None
    assert landing.short_rows(lines).first() == (3, 1)
    bad = spark.createDataFrame([("{not json",), ('{"articles":[{"title":"t","url":"u","language":"","seendate":"20240102T030405Z"}]}',)], "value string")
    got = landing.articles(bad).collect()
    assert [(r.title, r.language, str(r.published_at)) for r in got] == [("t", "en", "2024-01-02 03:04:05")]
    events = spark.createDataFrame([('{"kind":"commit","did":"d","commit":{"operation":"create","collection":"app.bsky.feed.post","rkey":"k","record":{"text":"long enough text","createdAt":"2024-01-02T03:04:05.678Z","langs":["de"]}}}',), ('{"kind":"identity"}',), ("x",)], "value string")
    assert [(r.url, r.language, r.content) for r in landing.post_events(events).collect()] == [("https://bsky.app/profile/d/post/k", "de", "long enough text")]
    stamps = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+00:00",), ("2024-01-02T03:04:05.000Z",), ("20240102T030405Z",), ("bad",)], "s string")
    assert [str(r.t) for r in stamps.select(landing.any_timestamp(F.col("s")).alias("t")).collect()] == ["2024-01-02 03:04:05"] * 4 + ["None"]


def test_embedder():
    v = landing.hashed_vector(["some words here", "", None, "some words here"])
    assert np.allclose(v[0], v[3]) and abs(np.linalg.norm(v[0]) - 1) < 1e-5 and not v[1].any() and not v[2].any()


@quick
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.integers(0, 30_000)), max_size=40))
def test_interval_join_is_the_plain_join(spark, rows):
    df = spark.createDataFrame(rows, "g int, s int, t int").select("g", "s", F.timestamp_seconds("t").alias("ts"))
    want = {}
    for g, s, t in rows:
        for h, r, u in rows:
            if g == h and s != r and 0 < u - t <= 7200:
                want[g, s, r] = want.get((g, s, r), 0) + 1
    assert {(r.g, r.src, r.dst): r.weight for r in follows.interval_join(df, "s", "ts", 7200, ("g",)).collect()} == want


def test_interval_edges(spark):
    df = spark.createDataFrame([("a", 0), ("b", 7200), ("c", 7201)], "s string, t int").select("s", F.timestamp_seconds("t").alias("ts"))
    assert {(r.src, r.dst) for r in follows.interval_join(df, "s", "ts", 7200).collect()} == {("a", "b"), ("b", "c")}


def test_burst_edges(spark):
    rows = [("none", None), ("one", 0), ("short", 0), ("short", 30), ("even", 0), ("even", 900), ("rise", 0), ("rise", 900), ("rise", 901), ("rise", 902)]
    got = {r.k: r.burst for r in temporal.burst(spark.createDataFrame(rows, "k string, t int").select("k", F.timestamp_seconds("t").alias("ts")), "k", "ts").collect()}
    assert got == {"one": 0.0, "short": 0.0, "even": 0.0, "rise": 1.0}


@quick
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("abcd")), min_size=1, max_size=40))
def test_entropy_bounds(spark, rows):
    for r in sets.entropy(spark.createDataFrame(rows, "g int, v string"), "g", "v").collect():
        counts = np.unique([v for g, v in rows if g == r.g], return_counts=True)[1]
        p = counts / counts.sum()
        assert abs(r.h - max(0.0, -(p * np.log2(p)).sum())) < 1e-9 and -1e-12 <= r.h <= np.log2(len(p)) + 1e-9


@quick
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from("abcdef")), min_size=1, max_size=30))
def test_mean_jaccard(spark, rows):
    by = {}
    for m, t in rows:
        by.setdefault(m, set()).add(t)
    s = list(by.values())
    pairs = [len(a & b) / len(a | b) for i, a in enumerate(s) for b in s[:i]]
    got = sets.mean_jaccard(spark.createDataFrame([(0, *r) for r in rows], "g int, m int, t string"), "g", "m", "t").first()
    assert abs(got.jaccard - (np.mean(pairs) if pairs else 0)) < 1e-9


def test_similar_pairs_in_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 8))
    v[3] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "k long, v array<double>")
    n = v / np.maximum(np.linalg.norm(v, axis=1), 1e-10)[:, None]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(float(n[i] @ n[j]), 6) >= 0.4}
    for block in (7, 1000):
        assert {(r.a, r.b) for r in vectors.similar_pairs(df, "k", "v", 0.4, block).collect()} == want


def test_cosine_guards(spark):
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, vectors.cleaned_unit(F.array(F.lit(float("nan")), F.lit(3.0), F.lit(float("inf"))))) == [0.0, 1.0, 0.0]


def test_components_and_campaigns(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 1, 0.9), (7, 8, 0.3), (10, 11, 0.5), (12, 11, 0.6)], "a long, b long, strength double")
    assert {r.node: r.component for r in components.components(edges, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 10: 10, 11: 10, 12: 10}
    groups = spark.createDataFrame([(k, f"L{k}", float(k)) for k in range(13)], "cluster_id long, label string, score double")
    got = {r.campaign: (r.members, r.label) for r in campaigns.campaigns(edges, groups, "cluster_id").collect()}
    assert got == {1: ([1, 2, 3], "L3"), 10: ([10, 11, 12], "L12")}


@pytest.mark.parametrize("edges", [8, 2])
def test_density_clusters_in_blocks_equal_those_of_the_whole(spark, monkeypatch, edges):
    """Several shards and block sizes, equal rows, ties; with few edges a row forests are thinned in rounds."""
    monkeypatch.setattr(clustering, "EDGES", edges)
    rng = np.random.default_rng(3)
    x = {s: np.concatenate([np.round(c + rng.normal(scale=0.2, size=(n, 4)), 1) for c in np.eye(4) * 4]) for s, n in (("a", 30), ("b", 11), ("c", 1))}
    rows = [(f"{s}{k:03d}", s, v.tolist()) for s, m in x.items() for k, v in enumerate(m)]
    df = spark.createDataFrame(rows + [("null", "a", None)], "k string, s string, v array<double>")
    want = {}
    for s, m in x.items():
        u = m / np.linalg.norm(m, axis=1)[:, None]
        for size in (3, 10):
            labels = clustering.density_labels(u, size).tolist()
            want |= {(f"{s}{k:03d}", clustering.RESOLUTIONS[size]): f"{s}/{clustering.RESOLUTIONS[size]}/{s}{labels.index(c):03d}" for k, c in enumerate(labels) if c >= 0}
    assert len(set(want.values())) > 6
    for block in (17, 1000):
        assert {(r.k, r.resolution): r.cluster for r in clustering.density_clusters(df, "k", "v", (3, 10), "s", block).collect()} == want


def test_density_clusters_of_a_shard_of_many_blocks(spark):
    rng = np.random.default_rng(3)
    y = [[*v] for c in np.eye(3) * 4 for v in (c + rng.normal(scale=0.1, size=(700, 3))).tolist()]
    got = clustering.density_clusters(spark.createDataFrame(list(enumerate(y)), "k long, v array<double>"), "k", "v", sizes=(300,), block=500).collect()
    found = {r.k // 700: set() for r in got}
    for r in got:
        found[r.k // 700].add(r.cluster)
    assert len(found) == 3 and all(len(c) == 1 for c in found.values()) and len(set.union(*found.values())) == 3


def test_density_clusters_find_planted_blobs(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(6)[:3] * 4
    x = np.concatenate([c + rng.normal(scale=0.15, size=(30, 6)) for c in centres])
    labels = clustering.density_labels(x / np.linalg.norm(x, axis=1)[:, None], 10)
    truth = np.repeat([0, 1, 2], 30)
    assert len(set(labels) - {-1}) == 3 and (labels >= 0).mean() > 0.8
    assert all(len(set(truth[labels == k])) == 1 for k in set(labels) - {-1})
    assert (clustering.density_labels(x[:5], 10) == -1).all()
    assert clustering.density_clusters(spark.createDataFrame([(i, [1.0]) for i in range(5)], "k long, v array<double>"), "k", "v", (3,)).count() == 0
    assert clustering.density_clusters(spark.createDataFrame([], "k long, v array<double>"), "k", "v").count() == 0


def test_cadence_against_direct_formulas():
    rng = np.random.default_rng(3)
    h = np.zeros(145)
    np.add.at(h, rng.integers(0, 145, 90), 1)
    v = fingerprint.cadence_vector(h, h[:144].reshape(24, 6).sum(1), 900.0, 450.0)
    centred = h - h.mean()
    ac = np.correlate(centred, centred, "full")[len(h) - 1 :]
    ac = ac / ac[0]
    peaks = [(ac[i], i) for i in range(2, len(ac) - 1) if ac[i] > ac[i - 1] and ac[i] > ac[i + 1] and ac[i] > 0.3]
    assert abs(np.linalg.norm(v) - 1) < 1e-9 and (v[8] > 0) == bool(peaks)
    assert not fingerprint.cadence_vector(np.ones(1), np.ones(1), 1, 0).any()


def test_style_against_python(spark):
    import re

    from tidewake.functions import fixed_values as fixed

    texts = ["The dog was seen by the man. It was not asked, and \"no\" was said!", "We have been called; they can't go? Never mind the dog of the town. " * 9]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "too short")], "g int, o int, t string")
    got = {r.g: np.array(r.style) for r in fingerprint.style(df, "g", "t", "o").collect()}
    joined = " ".join(texts)
    words = re.findall(r"\b[a-zA-Z]+\b", joined.lower())
    n = len(words)
    sentences = [s for t in texts for s in re.split(r"[.!?]+", t)]
    lens = [len(s.split()) for s in sentences if s.strip()]
    two = [f"{a}_{b}" for a, b in zip(words, words[1:])]
    want = [words.count(w) / n for w in fixed.FUNCTION_WORDS[:20]] + [np.mean(lens) / 50, np.var(lens) / 500, len(re.findall("[,.:;]", joined)) / len(joined) * 1000 / 50, len(set(words)) / n, 1 - len(set(two)) / len(two)]
    fw = [w for w in words if w in fixed.FUNCTION_WORDS]
    want += [1 - len(fw) / n, len(set(fw)) / 94, np.mean([len(w) for w in words]) / 10, len(re.findall(r"\b[A-Z][a-z]+\b", joined)) / n * 10, 1 / len(sentences), len(re.findall(r"\b(was|were|been|being)\s+\w+ed\b", joined.lower())) / len(sentences), len(re.findall(r"\b(not|no|never|neither|nor)\b", joined.lower())) / n * 100]
    want = np.clip(want, -5, 5)
    assert np.allclose(got[1], want / np.linalg.norm(want), atol=1e-9) and not got[2].any()


def test_graph_metrics():
    src, dst = np.array(["a", "b", "c", "d"]), np.array(["b", "c", "a", "a"])
    p = graph.path_metrics(src, dst)
    assert p["components"] == 1 and p["diameter"] == 3 and abs(p["path_length"] - 15 / 9) < 1e-9
    assert graph.path_metrics(src, dst) == p
    two = graph.centrality(np.array(list("abcxyz")), np.array(list("bcayzx")), np.ones(6))
    assert two["groups"] == 2


def test_lifecycle_phases(spark):
    t = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [("grow", t(1), 30.0), ("grow", t(2), 40.0), ("grow", t(3), 60.0), ("fall", t(1), 60.0), ("fall", t(2), 40.0), ("fall", t(3), 30.0), ("flat", t(1), 60.0), ("flat", t(2), 58.0), ("flat", t(3), 59.0), ("peak", t(1), 30.0), ("peak", t(2), 61.0), ("peak", t(3), 60.0), ("low", t(1), 5.0), ("low", t(2), 6.0), ("single", t(3), 50.0)]
    df = spark.createDataFrame(rows, "k string, at string, v double").withColumn("ts", F.to_timestamp("at")).withColumn("posts", F.lit(40))
    got = {r.k: r.phase for r in lifecycle.phases(df, "k", "ts", "v", F.lit("2024-01-01 14:30:00").cast("timestamp"), "posts").collect()}
    assert got == {"grow": "growth", "fall": "decay", "flat": "saturation", "peak": "peak", "low": "dormant", "single": "growth"}


def test_relational_edges(spark):
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert sorted(map(tuple, relational.upsert(old, new, "k").collect())) == [(1, "o"), (2, "n"), (3, "n")]
    assert sorted(map(tuple, relational.upsert(old, new, "k", "ignore").collect())) == [(1, "o"), (2, "o"), (3, "n")]
    assert relational.latest(old.limit(0), "k", F.col("v")).count() == 0
    posts = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "id int, c string")
    assert sorted(r.id for r in relational.dedup_content(posts, "c", F.col("id")).collect()) == [1, 3]


def test_reports(spark):
    packs = report.evidence_packs(spark.createDataFrame([(1, "a")], "k int, v string"), "k")
    assert report.verified(packs).first().valid and not report.verified(packs.withColumn("pack", F.lit("{}"))).first().valid
    labels = spark.createDataFrame([(1, "The big storm hits coast towns hard"), (2, "the BIG storm hits coast towns hard"), (3, "Storm hits coast towns hard, again today"), (4, "Another thing")], "place int, label string")
    assert report.distinct_labels(labels, "label", "place", 1).first().place == 1
    got = [r.place for r in report.distinct_labels(labels, "label", "place", 5).collect()]
    assert 1 in got and 2 not in got and 4 in got


def test_retention(spark):
    posts = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-10"), (3, None)], "id int, d string").withColumn("ts", F.to_timestamp("d"))
    a = retention.archived(posts, "ts", F.lit("2024-02-15").cast("timestamp"))
    assert {r.id: r.archived for r in a.collect()} == {1: True, 2: False, 3: False}
    assert {r.id for r in retention.prune(posts, a, "id", "id").collect()} == {2, 3}


def test_sql_functions(spark):
    register.register(spark)
    r = spark.sql("SELECT jaccard(array('a','b'), array('b','c')) j, cosine(array(1D,0D), array(1D,1D)) c, domain_of('https://www.X.org/p') d, logistic(0) l, shannon_entropy(array(2L,2L)) h").first()
    assert (round(r.j, 4), round(r.c, 4), r.d, r.l, r.h) == (0.3333, 0.7071, "x.org", 0.5, 1.0)


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"text {i % 7}", f"2024-01-01 {i // 6:02d}:{i % 6 * 10:02d}:00", i % 3) for i in range(100)]
    posts = spark.createDataFrame(rows, "id int, content string, at string, k int").select("id", "content", F.to_timestamp("at").alias("published_at"), "k")
    posts.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(posts.schema).parquet(str(tmp_path / "in"))
    q = jobs.each_batch_once(jobs.deduplicated(stream()), str(tmp_path / "dedup"), str(tmp_path / "c1"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "dedup")).select("content").distinct().count() == 7 == spark.read.parquet(str(tmp_path / "dedup")).count()
    q = jobs.each_batch_once(jobs.window_counts(stream(), "k", width="1 hour"), str(tmp_path / "win"), str(tmp_path / "c2"))
    q.awaitTermination()
    closed = posts.groupBy("k", F.window("published_at", "1 hour").getField("start").alias("start")).agg(F.count("*").alias("cnt"))
    last = posts.agg(F.max("published_at")).first()[0]
    closed = closed.where(F.col("start") + F.expr("INTERVAL 1 HOUR") <= F.lit(last) - F.expr("INTERVAL 2 HOURS"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "win")).select("k", "start", "cnt").collect())) == sorted(map(tuple, closed.select("k", "start", "cnt").collect()))
    q = jobs.each_batch_once(jobs.session_counts(stream(), "k"), str(tmp_path / "ses"), str(tmp_path / "c3"))
    q.awaitTermination()
    assert jobs.relevant(posts).count() == 0


def test_swapped_tables_keep_their_old_generation(spark, tmp_path):
    a = storage.swapped(spark.range(3), str(tmp_path / "t"))
    b = storage.swapped(spark.read.parquet(a).where("id > 0"), str(tmp_path / "t"))
    assert spark.read.parquet(a).count() == 3 and spark.read.parquet(b).count() == 2


def test_batch_artifact_end_to_end(spark):
    """Posts of a feed every 900 seconds are zeroed by the terminal rule; the same posts at odd times, or from elsewhere, aren't."""
    from tidewake.operators import signals

    odd = [0, 900, 1700, 5000, 5100, 9000, 14000, 14100, 20000, 30000, 30500, 47000]
    rows = []
    for c, feed, even in ((1, "gdelt_gkg", True), (2, "gdelt_gkg", False), (3, "blog", True)):
        for k in range(12):
            rows.append((c, 100 * c + k, f"src{k}", feed, f"d{k}.org", f"/path/{c}/{k}", "translated" if c == 2 and k == 0 else "en", f"A long enough headline number {k} about harbours", f"content {c} {k}", 1704067200 + (900 * k if even else odd[k]), [1.0, 0.1 * k], 1.0, 0.5, 40.0 if c == 3 else 1.0, 13.0, 0.1, ["PROTEST"]))
    p = spark.createDataFrame(rows, "cluster_id long, post_id long, source string, feed string, domain string, path string, language string, title string, content string, at long, vector array<double>, polarity double, tone double, ad double, neg double, self double, themes array<string>")
    p = p.withColumn("published_at", F.timestamp_seconds("at")).withColumn("tone_parts", F.struct(F.col("ad").alias("activity_density"), F.col("neg").alias("negative"), F.col("self").alias("self_reference")))
    tokens = p.select("cluster_id", "post_id", F.explode(tx.title_tokens(F.col("title"))).alias("token"))
    got = {r.cluster_id: r for r in signals.score_groups(p, tokens, tokens.withColumnRenamed("token", "entity")).collect()}
    assert got[1].batch_artifact and got[1].rules_fired[0] == "gdelt_batch_artifact" and got[1].score == 0 and got[1].alert_level == "normal" and got[1].suppressed and got[1].coordination == 1.0
    assert not got[2].batch_artifact and got[2].translated and got[2].language_count == 2 and got[2].feed_fraction == 1.0
    assert not got[3].batch_artifact and got[3].coordination > 1.5 and "content_anomaly" in got[3].rules_fired and "content_anomaly" not in got[2].rules_fired
    few = signals.score_groups(p.where("post_id % 100 < 2"), tokens, tokens.withColumnRenamed("token", "entity")).collect()
    assert all(r.insufficient_data and r.score == 0 and r.alert_level == "normal" for r in few)


def test_refreshed_matches(spark):
    from tidewake.operators import rules

    rows = [(1, -1, 12, ["dna_match", "confidence_threshold"]), (2, -1, 5, ["insufficient_evidence"]), (3, 4, 30, []), (4, 0, 8, ["insufficient_evidence", "dna_match"]), (5, 7, 30, ["wire_service", "confidence_threshold"])]
    snaps = spark.createDataFrame(rows, "k int, dna_match_count long, post_count long, rules_fired array<string>")
    live = spark.createDataFrame([(1, 6), (2, 0), (3, 4), (4, 3), (5, -1)], "k int, live long")
    got = {r.k: (r.dna_match_count, r.rules_fired, r.dna_evidence_strong) for r in rules.refreshed_matches(snaps, live, "k").collect()}
    assert got == {1: (6, ["confidence_threshold"], True), 2: (0, ["insufficient_evidence", "dna_match"], False), 3: (4, [], False), 4: (3, ["insufficient_evidence"], False), 5: (-1, ["wire_service", "dna_match", "confidence_threshold"], False)}


def test_zips_and_pointers(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.gkg.csv.zip", "w") as z:
        z.writestr("one.csv", "a\tb\r\nc\u2028d\n".encode() + b"\xff bad\n")
        z.writestr("two.csv", "last line without an end")
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    (tmp_path / "lastupdate.txt").write_text(f"12 ab http://x.org/none.export.zip\n13 cd file://{tmp_path}/a.gkg.csv.zip\n14 ef http://x.org/b.GKG.zip\n")
    names = landing.pointed(spark, f"file://{tmp_path}/lastupdate.txt", "GKG")
    assert names == [f"file://{tmp_path}/a.gkg.csv.zip"] and landing.pointed(spark, f"file://{tmp_path}/lastupdate.txt", "mentions") == []
    assert sorted(r.value for r in landing.read_zips(spark, names, lines=2).collect()) == sorted(["a\tb", "c\u2028d", "\ufffd bad", "last line without an end"])
    assert landing.read_zips(spark, [f"file://{tmp_path}/broken.zip"]).count() == 0 == landing.read_zips(spark, []).count()


def test_rules_as_a_table_function(spark):
    from tidewake.operators import rules

    register.register(spark)
    spark.createDataFrame([(1, 6, False), (2, 40, True), (3, 40, False)], "k int, n long, b boolean").createOrReplaceTempView("groups_of_posts")
    got = spark.sql("SELECT k, collect_list(rule) AS fired FROM (SELECT g.k, t.rule FROM groups_of_posts g, LATERAL rule_trace(post_count => g.n, batch_artifact => g.b, source_diversity => 0.5D, shared_entity_count => 4, confidence => 0.9D, dna_match_count => 3) t WHERE t.fired ORDER BY g.k, t.place) GROUP BY k").collect()
    df = spark.table("groups_of_posts").select("k", F.col("n").alias("post_count"), F.col("b").alias("batch_artifact"), F.lit(0.5).alias("source_diversity"), F.lit(4).alias("shared_entity_count"), F.lit(0.9).alias("confidence"), F.lit(3).alias("dna_match_count"))
    want = {r.k: set(r.rules_fired) for r in rules.apply_rules(df).collect() if r.rules_fired}
    assert {r.k: set(r.fired) for r in got} == want and 2 in want
    assert spark.sql("SELECT * FROM rule_trace()").count() == len(rules.RULES)


def test_scenarios(spark):
    """Each change makes its rule fire, whatever the group is like; what a group fires anyway counts as false positive."""
    from tidewake.plans import scenarios

    quiet = {"post_count": 40, "burst": 3.0, "mutation": 0.2, "coordination": 1.2, "shared_entity_count": 4, "source_diversity": 0.5, "dna_match_count": 3, "unique_domain_count": 9, "ensemble_disagreement": 2.0, "confidence": 0.9, "narrative_coherence": 0.5}
    rows = [(1, *quiet.values()), (2, *(quiet | {"post_count": 5}).values()), (3, *(quiet | {"confidence": None}).values())]
    kinds = {int: "long", float: "double"}
    features = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} {kinds[type(v)]}" for c, v in quiet.items()))
    done = scenarios.evaluate(scenarios.scenario_table(features, "k"), "k")
    results, per_rule = done.collect(), {r.rule: r for r in scenarios.by_rule(done).collect()}
    assert len(results) == 3 * len(scenarios.SCENARIOS) and len(per_rule) == 18 and all(r.passed for r in results)
    assert per_rule["wire_service"].tp == 3 and per_rule["wire_service"].fp == per_rule["wire_service"].fn == 0
    assert per_rule["insufficient_evidence"].fp > 0 and per_rule["confidence_threshold"].fp > 0  # of groups 2 and 3
    wrong = [("quiet", {}, ["wire_service"], None, 100.0)]
    assert not any(r.passed for r in scenarios.evaluate(scenarios.scenario_table(features, "k", wrong), "k").collect())
    text = scenarios.report(results, list(per_rule.values()))
    assert text.startswith("# Scenarios: 30 of 30") and text.count("\n") == 54


@pytest.mark.parametrize("block", [3, 1024])
def test_mean_jaccard_by_blocks(spark, block):
    rng = np.random.default_rng(block)
    own = {(g, m): {f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 6))} for g in ("a", "b", "c") for m in range(14)} | {("one", 0): {"w1"}}
    rows = [(g, m, w) for (g, m), s in own.items() for w in (s or {None})] * 2
    want = {}
    for g in ("a", "b", "c", "one"):
        sets_ = [s for (h, _), s in own.items() if h == g]
        pairs = [len(x & y) / len(x | y) if x | y else 0 for i, x in enumerate(sets_) for y in sets_[:i]]
        want[g] = (len(sets_), np.mean(pairs) if pairs else 0)
    got = {r.g: (r.members, r.jaccard) for r in sets.mean_jaccard(spark.createDataFrame(rows, "g string, m int, w string"), "g", "m", "w", block).collect()}
    assert set(got) == set(want) and all(got[g][0] == want[g][0] and abs(got[g][1] - want[g][1]) < 1e-9 for g in want)


def test_shared_counts_by_bitmaps_and_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    for items, size in ((20, 10), (5000, 4)):
        left, right = ([np.unique(rng.integers(0, items, size)) for _ in range(n)] for n in (40, 70))
        want = [[len(set(x) & set(y)) for y in right] for x in left]
        assert (sets.shared_counts(left, right) == want).all()
        monkeypatch.setattr(sets, "PAIRS", 50)
        assert (sets.shared_counts(left, right) == want).all()
        monkeypatch.undo()


def test_all_pairs_of_groups(spark):
    df = spark.createDataFrame([(k % 25, "x") for k in range(60)] + [(None, "x")], "g int, d string")
    for block in (4, 1024):
        got = [(r.a, r.b) for r in relational.unordered_pairs(df, "g", block).collect()]
        assert sorted(got) == [(a, b) for a in range(25) for b in range(a + 1, 25)]
    assert relational.unordered_pairs(df.limit(0), "g").count() == 0


def test_amplification_chain(spark):
    """Late groups that hold half of an early one's sources and are alike; hot sources; no pair without a common source."""
    rng = np.random.default_rng(8)
    own = {g: {int(x) for x in rng.integers(0, 6, 4)} | {99} for g in range(12)}
    start, mid = rng.integers(0, 10_000, 12), rng.normal(size=(12, 3)) + 0.7
    sources = spark.createDataFrame([(g, s) for g, x in own.items() for s in x] * 2 + [(50, 777)], "g int, s int")
    groups = spark.createDataFrame([(g, int(t)) for g, t in enumerate(start)] + [(50, 9_999)], "g int, t int").select("g", F.timestamp_seconds("t").alias("first_seen"))
    cents = spark.createDataFrame([(g, c.tolist()) for g, c in enumerate(mid)] + [(50, [1.0, 1.0, 1.0])], "g int, centroid array<double>")
    want = {}
    for a in own:
        for b in own:
            ratio, cos = len(own[a] & own[b]) / len(own[a]), mid[a] @ mid[b] / np.linalg.norm(mid[a]) / np.linalg.norm(mid[b])
            if a != b and start[b] - start[a] >= 1800 and ratio >= 0.5 and cos >= 0.5 and 0.5 * (cos + ratio) > 0.4:
                want[a, b] = round(0.5 * (cos + ratio), 4)
    got = {(r.a, r.b): r.strength for r in campaigns.amplification_chain(groups, sources, "g", "s", cents).collect()}
    assert want and set(got) == set(want) and all(abs(got[p] - want[p]) < 2e-4 for p in want)


@pytest.mark.parametrize("spread", [1, 3, 10_000])
def test_hot_keys_are_spread(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 6, 60), rng.integers(0, 9000, 60))]
    df = spark.createDataFrame(rows, "s int, t int").select("s", F.timestamp_seconds("t").alias("ts"))
    want = {}
    for s, t in rows:
        for r, u in rows:
            if s != r and 0 < u - t <= 3000:
                want[s, r] = want.get((s, r), 0) + 1
    assert {(r.src, r.dst): r.weight for r in follows.interval_join(df, "s", "ts", 3000, (), spread).collect()} == want
    items = {m: {int(x) for x in rng.integers(0, 4, 3)} for m in range(12)}
    df = spark.createDataFrame([(0, m, x) for m, s in items.items() for x in s] * 2, "g int, m int, x int")
    got = {(r.a, r.b): (r.shared, r.size_a, r.size_b) for r in sets.pair_overlap(df, "a", "b", ("g",), "x", "m", spread).collect()}
    assert got == {(a, b): (len(items[a] & items[b]), len(items[a]), len(items[b])) for a in items for b in items if a < b and items[a] & items[b]}


def test_aligned_series_in_blocks(spark):
    rng = np.random.default_rng(5)
    v = {f"k{k}": {int(t): float(x) for t, x in zip(rng.integers(0, 20, 12), rng.normal(1000, 3, 12))} for k in range(9)} | {"flat": dict.fromkeys(range(20), 7.0), "lone": {99: 1.0}}
    df = spark.createDataFrame([(k, t, x) for k, s in v.items() for t, x in s.items()] + [("k0", None, 1.0), (None, 3, 1.0)], "k string, t int, v double").withColumn("at", F.timestamp_seconds("t"))
    want = {}
    for a in v:
        for b in v:
            both = sorted(set(v[a]) & set(v[b]))
            if a < b and len(both) >= 3:
                x, y = np.array([v[a][t] for t in both]), np.array([v[b][t] for t in both])
                want[a, b] = (len(both), x.std(), y.std(), np.corrcoef(x, y)[0, 1] if x.std() > 1e-9 and y.std() > 1e-9 else np.nan)
    for block in (2, 1000):
        got = {(r.a, r.b): (r.points, r.sa, r.sb, r.r) for r in temporal.aligned_series(df, "k", "at", "v", 3, block).collect()}
        assert set(got) == set(want) and all(np.allclose(got[p], want[p], atol=1e-6, equal_nan=True) for p in want)


def test_labels_beyond_many_repeats(spark):
    """Thousands of repeats in front: the labels behind them are found."""
    rows = [(i, f"{' ' * (i % 3)}The SAME label of some seven words" if i % 2 else "the same label of some seven words again") for i in range(5000)] + [(5000 + i, f"quite another thing {i}") for i in range(3)]
    df = spark.createDataFrame(rows, "place int, label string")
    for batch in (1, 2, 1000):
        assert [r.place for r in report.distinct_labels(df, "label", "place", 4, batch).collect()] == [0, 5000, 5001, 5002]


def test_labels_chosen_in_rounds(spark):
    """Batches of any size choose what one pass in order chooses; nulls, equal ranks."""
    rng = np.random.default_rng(6)
    words = [f"longish{k}" for k in range(12)]
    rows = [(int(rng.integers(0, 30)), " ".join(rng.choice(words, 7))) for _ in range(80)] + [(None, "short one"), (3, None), (3, "")]
    seen, exact, want = [], set(), []
    for place, label in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        low, own = (label or "").strip().lower(), {w for w in (label or "").lower().split() if len(w) > 3}
        if low in exact:
            continue
        exact.add(low)
        if len(own) > 4:
            if any(len(own & s) / len(own | s) >= 0.65 for s in seen):
                continue
            seen.append(own)
        want.append((place, label))
    df = spark.createDataFrame(rows, "place int, label string")
    for batch, limit in ((3, 25), (1000, 25), (4, 10_000)):
        assert [tuple(r) for r in report.distinct_labels(df, "label", "place", limit, batch).collect()] == want[:limit]


def test_sparse_graph_measures_equal_dense_ones():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(3, 15))
        a, b = rng.integers(0, n, 25), rng.integers(0, n, 25)
        m = np.zeros((n, n))
        m[a, b] = m[b, a] = 1
        np.fill_diagonal(m, 0)
        d = m.sum(0)
        near = graph.neighbours(n, a, b)
        assert [sorted(x) for x in near] == [np.flatnonzero(r).tolist() for r in m]
        assert abs(graph.mean_clustering(near) - np.mean(np.where(d > 1, np.einsum("ij,jk,ki->i", m, m, m) / np.maximum(1, d * (d - 1)), 0))) < 1e-9
        v = np.full(n, n**-0.5)
        for _ in range(100):
            v = m @ v + v
            v /= np.linalg.norm(v)
        assert np.allclose(graph.leading_vector(near), v)
    two = [{1, 2}, {0, 2}, {0, 1}, {4, 5}, {3, 5}, {3, 4}]
    assert graph.modularity_groups(two) == 2 and graph.modularity_groups([set(), set()]) == 2 and graph.modularity_groups([{1, 2, 3}, {0, 2, 3}, {0, 1, 3}, {0, 1, 2}]) == 1


def test_disk_state(spark, tmp_path):
    from tidewake.plans import health

    assert health.should_pause_ingest(spark, f"file://{tmp_path}", 1e9) and not health.should_pause_ingest(spark, f"file://{tmp_path}", 0)


def test_nearest_centroids_in_blocks(spark):
    rng = np.random.default_rng(6)
    v, c = rng.normal(size=(50, 5)), rng.normal(size=(9, 5))
    c[7] = c[2]  # a tie goes to the smaller group
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(99, None)], "k long, v array<float>")
    cents = spark.createDataFrame([(g, x.tolist()) for g, x in enumerate(c)], "g int, centroid array<double>")
    s = v.astype(np.float32).astype(float) @ c.T / (np.linalg.norm(v, axis=1)[:, None] + 1e-8) / (np.linalg.norm(c, axis=1) + 1e-8)
    want = {k: int(np.round(r, 6).argmax()) for k, r in enumerate(s) if np.round(r, 6).max() >= 0.5}
    for block in (4, 1000):
        assert {r.k: r.g for r in vectors.nearest_centroid(df, "k", "v", cents, "g", 0.5, block).collect()} == want
    assert vectors.nearest_centroid(df, "k", "v", cents.limit(0), "g").count() == 0


def test_only_correlated_series_leave_a_task(spark):
    rng = np.random.default_rng(12)
    rows = [(k, f"2024-01-{t + 1:02d}", float(rng.normal() + (k % 3 == 0) * t)) for k in range(40) for t in range(20) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k long, at string, v double").withColumn("at", F.to_timestamp("at"))
    every = {(r.a, r.b): (r.points, r.r) for r in temporal.aligned_series(df, "k", "at", "v").collect()}
    want = {p: x for p, x in every.items() if x[1] > 0.7}
    for block in (7, None):
        got = {(r.a, r.b): (r.points, r.r) for r in temporal.aligned_series(df, "k", "at", "v", block=block, above=0.7).collect()}
        assert 0 < len(want) < len(every) and set(want) <= set(got) and all(x[1] > 0.69 for x in got.values()) and all(abs(got[p][1] - want[p][1]) < 1e-9 for p in want)
