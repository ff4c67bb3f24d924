"""Queries for the rest of the inventory: lookups, variants and read paths that share the operators of the others."""
# ruff: noqa: E501

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import fixed_values as fixed
from tidewake.functions import text as tx
from tidewake.operators import clustering, credibility, fingerprint, lifecycle, relational, report, retention, rules, sets, signals, temporal, vectors
from tidewake.plans import storage
from tidewake.plans.core import _PAIRS, ALIKE, _domains, r4
from tidewake.plans.cycle import run_cycle
from tidewake.plans.registry import query
from tidewake.plans.scoring import _LEVEL, _ends, _scored, as_of
from tidewake.plans.storage import kept
from tidewake.plans.views import clustered, entities, posts, table, title_words, with_parts
from tidewake.sources import generations, landing


@query("SELECT doc_id::VARCHAR AS record_id, source FROM documents")
def a02_zipped_rows(spark: SparkSession, d: str) -> DataFrame:
    """Zipped tab-separated files that a pointer file names."""
    path = f"{storage.shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    f = [F.col("doc_id").cast("string"), F.lit("20240102030405"), F.lit(""), F.col("source"), *[F.lit("")] * 16]
    landing.write_zips(table(spark, d, "documents").select(F.concat_ws("\t", *f).alias("value")), path, "gkg")
    return landing.knowledge_rows(landing.read_zips(spark, landing.pointed(spark, f"{path}/lastupdate.txt", "gkg"))).select("record_id", "source")


@query("SELECT count(*) AS received, count(*) FILTER (WHERE length(text) >= 10) AS texts, count(*) FILTER (WHERE length(text) >= 30 AND (contains(lower(text), 'false flag') OR (contains(lower(text), 'leaked') AND contains(lower(text), 'propaganda')))) AS matched FROM (SELECT CASE WHEN conv_id % 4 = 0 THEN text || ' propaganda leaked' ELSE text END AS text FROM conversations)")
def a09_sample_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.when(F.col("conv_id") % 4 == 0, F.concat("text", F.lit(" propaganda leaked"))).otherwise(F.col("text")).alias("text"))
    return c.agg(F.count("*").alias("received"), F.count_if(F.length("text") >= 10).alias("texts"), F.count_if(tx.relevance(F.col("text"))).alias("matched"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'second' ELSE 'first' END AS v FROM orders")
def a16_table_writers(spark: SparkSession, d: str) -> DataFrame:
    """Append, upsert into a new generation, read it back: the writers of snapshots, links, scores and state."""
    root = f"{storage.shared_dir(spark)}/table-{uuid.uuid4().hex}"
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    old = storage.swapped(k.withColumn("v", F.lit("first")), root)
    new = k.where("k % 2 = 0").withColumn("v", F.lit("second"))
    return spark.read.parquet(storage.swapped(relational.upsert(spark.read.parquet(old), new, "k"), root))


@query(with_parts("SELECT post_id, length(regexp_replace(t, '[\\p{C}\\p{Zl}\\p{Zp}]', '', 'g')) / length(t) > 0.85 AS printable FROM (SELECT post_id, title || CASE WHEN post_id % 3 = 0 THEN repeat(chr(1), 40) ELSE '' END AS t FROM posts) WHERE length(t) > 0", "posts"))
def b14_printable(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d).select("post_id", F.concat("title", F.when(F.col("post_id") % 3 == 0, F.repeat(F.lit("\x01"), 40)).otherwise("")).alias("t")).where(F.length("t") > 0)
    return p.select("post_id", tx.is_printable(F.col("t")).alias("printable"))


@query("SELECT event_id, hour(ts) BETWEEN 1 AND 5 AS off_hour, value * 8 > 35 AND value * 3 > 12 AND value / 40 < 0.3 AS outlier, event_type = 'click' AS manipulation FROM events")
def b21_row_flags(spark: SparkSession, d: str) -> DataFrame:
    themes = F.when(F.col("event_type") == "click", F.array(F.lit("PROPAGANDA"))).otherwise(F.array(F.lit("PROTEST")))
    return table(spark, d, "events").select("event_id", F.hour("ts").between(1, 5).alias("off_hour"), ((F.col("value") * 8 > 35) & (F.col("value") * 3 > 12) & (F.col("value") / 40 < 0.3)).alias("outlier"), F.arrays_overlap(themes, tx.lit_array(fixed.MANIPULATION_THEMES)).alias("manipulation"))


@query(with_parts("SELECT cluster_id, count(*) AS posts, count(published_at) AS stamped, min(published_at) AS first_seen, max(published_at) AS last_updated FROM cl GROUP BY cluster_id", "cl"))
def c01_members(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d).groupBy("cluster_id").agg(F.count("*").alias("posts"), F.count("published_at").alias("stamped"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_updated"))


@query(with_parts("SELECT x.cluster_id AS a, y.cluster_id AS b, count(*) FILTER (WHERE x.domain = y.domain) AS shared FROM (SELECT DISTINCT cluster_id, domain FROM cl) x JOIN (SELECT DISTINCT cluster_id, domain FROM cl) y ON x.cluster_id < y.cluster_id GROUP BY ALL", "cl"))
def c05_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of groups with the domains they share, zero too."""
    p = kept(clustered(spark, d).select("cluster_id", "domain").withColumn("_", F.lit(1)), "domains")
    shared = sets.pair_overlap(p, "a", "b", ("_",), "domain", "cluster_id").select("a", "b", "shared")
    return relational.unordered_pairs(p, "cluster_id").join(shared, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


@query("WITH s AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS at FROM events) SELECT x.user_id AS a, y.user_id AS b, count(*) AS points FROM s x JOIN s y ON x.at = y.at AND x.user_id < y.user_id GROUP BY ALL HAVING count(*) >= 3")
def c13_aligned_series(spark: SparkSession, d: str) -> DataFrame:
    return temporal.aligned_series(table(spark, d, "events").withColumn("at", F.date_trunc("hour", "ts")), "user_id", "at", "value", 3).select("a", "b", "points")


@query(with_parts("SELECT c.page_id, coalesce(s.score, c.score) AS score FROM cred c LEFT JOIN (SELECT 'www.smart.com' AS domain, 0.9 AS score) s USING (domain)", "cred"))
def c17_score_fallback(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("www.smart.com", 0.9)], "domain string, known double")
    s = credibility.scored_domains(spark, _domains(spark, d), "domain").join(known, "domain", "left")
    return s.select("page_id", F.coalesce("known", "score").alias("score"))


@query("SELECT event_type, round(var_pop(value), 4) AS v, round(stddev_pop(value), 4) AS s, round(avg(value), 4) AS m FROM events GROUP BY event_type")
def d07_population_moments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(r4(F.var_pop("value"), "v"), r4(F.stddev_pop("value"), "s"), r4(F.avg("value"), "m"))


@query(with_parts("SELECT cluster_id, round(list_sum(c), 4) AS total, len(c) AS width FROM cen", "cen"))
def d08_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = vectors.centroids(clustered(spark, d), "cluster_id", "vector")
    return c.select("cluster_id", r4(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), "total"), F.size("centroid").cast("long").alias("width"))


@query(with_parts("SELECT cluster_id, round(wire_share, 4) AS wire_share, wire_domains FROM wire", "wire"))
def d14_wire_share(spark: SparkSession, d: str) -> DataFrame:
    return signals.wire_share(clustered(spark, d), "cluster_id", "domain").select("cluster_id", r4("wire_share"), "wire_domains")


@query("SELECT user_id, max(value) AS peak, arg_max(event_id, (value, -event_id)) AS peak_event, min(ts) FILTER (WHERE value >= 0.9 * m) AS first_near_peak FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def e05_peaks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("m", F.max("value").over(Window.partitionBy("user_id")))
    return e.groupBy("user_id").agg(F.max("value").alias("peak"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("peak_event"), F.min(F.when(F.col("value") >= 0.9 * F.col("m"), F.col("ts"))).alias("first_near_peak"))


@query(with_parts("SELECT cluster_id, round(concentration, 4) AS entity_concentration, shared::BIGINT AS shared_entity_count, shared <= 1 AS gated FROM con", "con"))
def i06_entity_concentration(spark: SparkSession, d: str) -> DataFrame:
    p = clustered(spark, d)
    c = sets.concentration(p, entities(p), "cluster_id", "post_id", "entity")
    return c.select("cluster_id", r4("concentration", "entity_concentration"), F.col("shared").cast("long").alias("shared_entity_count"), (F.col("shared") <= 1).alias("gated"))


@query(with_parts(f"SELECT k, coalesce(m.c, f.dna_match_count) AS dna_match_count, coalesce(m.c, f.dna_match_count) >= 5 AS strong, CASE WHEN m.c IS NULL OR m.c = f.dna_match_count THEN list_contains(f.rules_fired, 'dna_match') ELSE (m.c = -1 AND post_count >= 10) OR (m.c = 0 AND post_count < 20) END AS fired FROM fin f LEFT JOIN (SELECT v.vec_id, CASE WHEN v.vec_id % 10 = 9 THEN -1 ELSE count(e.n) END AS c FROM embeddings v LEFT JOIN (SELECT a AS n FROM ({_PAIRS}) UNION ALL SELECT b FROM ({_PAIRS})) e ON e.n = v.vec_id GROUP BY v.vec_id) m ON m.vec_id = f.k", "fin"))
def i18_refreshed_match_rule(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots whose stamped match count differs from the live one get a new decision; the others stay as they are."""
    e = table(spark, d, "embeddings")
    pairs = relational.other_endpoint(vectors.similar_pairs(e, "vec_id", "embedding", ALIKE), "a", "b").groupBy(F.col("node").alias("vec_id")).agg(F.count("*").alias("c"))
    live = e.select("vec_id").join(pairs, "vec_id", "left").select(F.col("vec_id").alias("k"), F.when(F.col("vec_id") % 10 == 9, -1).otherwise(F.coalesce("c", F.lit(0))).alias("live"))
    return rules.refreshed_matches(_scored(spark, d), live, "k").select("k", "dna_match_count", F.col("dna_evidence_strong").alias("strong"), F.array_contains("rules_fired", "dna_match").alias("fired"))


@query(with_parts("SELECT cluster_id, token, count(DISTINCT post_id) AS posts FROM tok GROUP BY ALL", "tok"))
def b11_group_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return title_words(clustered(spark, d)).groupBy("cluster_id", "token").agg(F.count_distinct("post_id").alias("posts"))


@query(with_parts("SELECT vec_id, cluster_id::INT AS cluster_id FROM (SELECT e.vec_id, k.cluster_id, s, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(s, 6) DESC, k.cluster_id) AS r FROM embeddings e JOIN cen k ON true, LATERAL (SELECT list_inner_product(e.embedding::DOUBLE[], k.c) / ((sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) + 1e-8) * (sqrt(list_inner_product(k.c, k.c)) + 1e-8)) AS s)) WHERE r = 1 AND round(s, 6) >= 0.3", "cen"))
def j06_incremental_assign(spark: SparkSession, d: str) -> DataFrame:
    c = vectors.centroids(clustered(spark, d), "cluster_id", "vector")
    return vectors.nearest_centroid(table(spark, d, "embeddings"), "vec_id", "embedding", c, "cluster_id", 0.3).select("vec_id", "cluster_id")


@query("SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score FROM embeddings a JOIN embeddings b ON a.vec_id = 11 AND b.vec_id <> 11 WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2 ORDER BY score DESC, b.vec_id LIMIT 10")
def k08_match_search(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 11").select(F.col("embedding").alias("q"))
    s = e.where("vec_id <> 11").crossJoin(F.broadcast(one)).select("vec_id", r4(vectors.cosine(F.col("q"), F.col("embedding")), "score"))  # one row
    return s.where("score >= 0.2").orderBy(F.desc("score"), "vec_id").limit(10)


@query("SELECT doc_id, 84::BIGINT AS width, round(n_chars / sqrt(32.0 * n_chars * n_chars + 16 * 25), 6) AS style, round(5 / sqrt(32.0 * n_chars * n_chars + 16 * 25), 6) AS cadence, 0.0::DOUBLE AS network FROM documents WHERE n_chars > 0")
def k05_combined_width(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("n_chars > 0").select("doc_id", F.array_repeat(F.col("n_chars").cast("double"), 32).alias("style"), F.array_repeat(F.lit(5.0), 16).alias("cadence"))
    return fingerprint.combined(t).select("doc_id", F.size("fingerprint").cast("long").alias("width"), *(F.round(F.element_at("fingerprint", k), 6).alias(n) for k, n in ((32, "style"), (33, "cadence"), (49, "network"))))


@query("SELECT doc_id, CASE WHEN h < 6 AND n < 15 THEN 'emergence' WHEN n > 30 THEN 'growth' ELSE 'emergence' END AS phase FROM (SELECT doc_id, doc_id % 12 AS h, n_chars % 60 AS n FROM documents)")
def n02_metadata_phase(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", (as_of() - F.make_interval(hours=(F.col("doc_id") % 12).cast("int"))).alias("ts"), (F.col("n_chars") % 60).alias("posts"), F.lit(50.0).alias("score"))
    return lifecycle.phases(t, "doc_id", "ts", "score", as_of(), "posts").select("doc_id", "phase")


@query(with_parts("SELECT domain, any_value(category) AS category, any_value(score) AS score FROM cred GROUP BY domain", "cred"))
def n04_registry_scores(spark: SparkSession, d: str) -> DataFrame:
    return credibility.scored_domains(spark, _domains(spark, d).select("domain").distinct(), "domain").select("domain", "category", "score")


@query(with_parts(f"SELECT k, score_, alert_level, domains, first_seen FROM (SELECT k, round(score, 1) AS score_, {_LEVEL} AS alert_level FROM fin) JOIN (SELECT cluster_id AS k, count(DISTINCT domain) AS domains, min(published_at) AS first_seen FROM cl GROUP BY cluster_id) USING (k)", "cl", "fin"))
def o05_narrative_detail(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).select("k", rules.rounded(F.col("score"), 1).alias("score_"), "alert_level")
    m = clustered(spark, d).groupBy(F.col("cluster_id").cast("long").alias("k")).agg(F.count_distinct("domain").alias("domains"), F.min("published_at").alias("first_seen"))
    return s.join(m, "k").select("k", "score_", "alert_level", "domains", "first_seen")


@query("SELECT date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS clusters, round(sum(value * 10), 1) AS sum_score, round(max(value * 10), 4) AS max_score, count(*) FILTER (WHERE value * 10 >= 80) AS critical FROM events WHERE ts > TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 720 HOURS GROUP BY 1")
def o10_score_timeline(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("ts").cast("timestamp") > as_of() - F.expr("INTERVAL 720 HOURS")).withColumn("score", F.col("value") * 10)
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count_distinct("user_id").alias("clusters"), F.round(F.sum("score"), 1).alias("sum_score"), r4(F.max("score"), "max_score"), F.count_if(F.col("score") >= 80).alias("critical"))


@query(f"WITH p AS ({_PAIRS}) SELECT p.a, p.b, round(p.score, 4) AS score, 'c' || x.label AS label_a, 'c' || y.label AS label_b FROM p JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b ORDER BY p.score DESC, p.a, p.b LIMIT 50")
def o13_match_list(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("c"), "label").alias("label"))
    top = vectors.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", ALIKE).orderBy(F.desc("score"), "a", "b").limit(50)
    return top.join(e.select(F.col("vec_id").alias("a"), F.col("label").alias("label_a")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("label").alias("label_b")), "b").select("a", "b", r4("score"), "label_a", "label_b")


@query("SELECT verdict, count(*) AS n, round(avg(n_chars), 2) AS mean_chars FROM (SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'organic' WHEN toxic = 1 THEN 'coordinated' ELSE 'uncertain' END AS verdict, n_chars FROM labels JOIN documents USING (doc_id)) GROUP BY verdict")
def o14_reviews(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    v = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "organic").when(F.col("toxic") == 1, "coordinated").otherwise("uncertain")
    return r.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 2).alias("mean_chars"))


@query(with_parts("SELECT (SELECT count(DISTINCT n) FROM nb) AS nodes, (SELECT count(*) FROM un) AS links, (SELECT max(c) FROM (SELECT count(*) AS c FROM nb GROUP BY n)) AS most", "un", "nb"))
def o15_graph_status(spark: SparkSession, d: str) -> DataFrame:
    c = _ends(spark, d).withColumn("degree", F.col("o") + F.col("i") - F.col("mutual"))
    return c.agg(F.count("*").alias("nodes"), F.floor(F.sum("degree") / 2).alias("links"), F.max("degree").alias("most"))


@query("SELECT user_id, coalesce(arg_max(value, event_id), 0) AS score, coalesce(arg_max(event_type, event_id), 'none') AS kind, max(event_id) IS NULL AS defaulted FROM (SELECT c_custkey AS user_id FROM customer) LEFT JOIN events USING (user_id) GROUP BY user_id")
def p02_defaults(spark: SparkSession, d: str) -> DataFrame:
    latest = relational.latest(table(spark, d, "events"), "user_id", F.desc("event_id"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).join(latest, "user_id", "left")
    return c.select("user_id", F.coalesce("value", F.lit(0.0)).alias("score"), F.coalesce("event_type", F.lit("none")).alias("kind"), F.col("event_id").isNull().alias("defaulted"))


@query("SELECT event_id, user_id FROM events WHERE event_id = (SELECT max(event_id) FROM events)")
def p01_newest_row(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("event_id")).limit(1).select("event_id", "user_id")


@query("SELECT vec_id, round(embedding[1]::DOUBLE / n, 4) AS first, 0.0::DOUBLE AS second, round(embedding[3]::DOUBLE / n, 4) AS third FROM (SELECT *, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) - embedding[2]::DOUBLE * embedding[2]::DOUBLE) AS n FROM embeddings)")
def p05_clean_matrix(spark: SparkSession, d: str) -> DataFrame:
    broken = F.transform("embedding", lambda x, i: F.when(i == F.lit(1), F.lit(float("nan")).cast("float")).otherwise(x))
    return table(spark, d, "embeddings").withColumn("u", vectors.cleaned_unit(broken)).select("vec_id", *(r4(F.element_at("u", k + 1), n) for k, n in enumerate(("first", "second", "third"))))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'empty_title' WHEN doc_id % 7 = 0 THEN 'thin_content' ELSE 'accepted' END AS reason FROM documents) GROUP BY reason")
def p11_reject_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    title = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 7 == 0, "the one").otherwise("several quite different words stand here")
    return t.groupBy(F.coalesce(tx.reject_reason(title, F.lit(""), F.lit("u")), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query()
def p12_whole_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Every stage, one after the other; rows of each table."""
    p = posts(spark, d).select("post_id", "source", "url", "title", "content", "language", "published_at", "polarity", "tone", "themes", "vector", "feed", "tone_parts")
    done = run_cycle(p, f"{storage.shared_dir(spark)}/cycle-{uuid.uuid4().hex}", F.lit("2024-01-20 00:00:00").cast("timestamp"), least=0.35)
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in done.items()]
    return relational.union_feeds(*out)


@query("SELECT event_id AS k, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'archived' ELSE 'rebuilt' END AS generation FROM events")
def s05_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A rebuild writes a new generation from the old one; readers by the table's path follow the manifest to it."""
    path = f"{storage.shared_dir(spark)}/rebuild-{uuid.uuid4().hex}"
    generations.write(table(spark, d, "events").select(F.col("event_id").alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.lit("active").alias("generation")), path)
    gone = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp")
    generations.write(generations.read(spark, path).withColumn("generation", F.when(gone, "archived").otherwise("rebuilt")), path)
    return generations.read(spark, path).select("k", "generation")


@query("SELECT a, b, n FROM (SELECT a % 50 AS a, b % 50 AS b, count(*) AS n FROM (SELECT vec_id AS a, vec_id * 7 + 3 AS b FROM embeddings) GROUP BY ALL)")
def g03_distinct_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("a"), ((F.col("vec_id") * 7 + 3) % 50).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(with_parts("SELECT cluster_id, round(mean, 4) AS mean_gap, CASE WHEN mean IS NULL THEN 'unknown' WHEN mean < 3600 THEN 'fast' ELSE 'slow' END AS pace FROM (SELECT cluster_id, m AS mean FROM gapc)", "gapc"))
def e09_pace(spark: SparkSession, d: str) -> DataFrame:
    g = temporal.gaps(clustered(spark, d), "cluster_id", "published_at")
    return g.select("cluster_id", r4("gap_mean", "mean_gap"), F.when(F.col("gap_mean").isNull(), "unknown").when(F.col("gap_mean") < 3600, "fast").otherwise("slow").alias("pace"))


@query("SELECT lang, count(DISTINCT text) AS n, true AS close FROM documents GROUP BY lang")
def d02_approximate_distinct(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").groupBy("lang").agg(F.count_distinct("text").alias("n"), F.approx_count_distinct("text", 0.02).alias("a"))
    return t.select("lang", "n", F.col("a").between(F.col("n") * 0.9, F.col("n") * 1.1).alias("close"))


@query(with_parts("SELECT cluster_id, list(term ORDER BY rank) AS words FROM kw8 WHERE rank <= 3 GROUP BY cluster_id", "kw8"))
def j09_leading_words(spark: SparkSession, d: str) -> DataFrame:
    k = clustering.keywords(clustered(spark, d), "cluster_id", "content", 3)
    return k.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("l")).select("cluster_id", F.transform("l", lambda s: s["term"]).alias("words"))


@query(with_parts("SELECT k, CASE WHEN len(l) = 0 THEN ['normal_activity'] ELSE l END AS alternatives FROM (SELECT k, list_filter([CASE WHEN mutation < 0.15 THEN 'wire_distribution' END, CASE WHEN coordination > 1.3 THEN 'editorial_scheduling' END, CASE WHEN burst > 10 AND spread > 0.3 THEN 'breaking_news' END, CASE WHEN spread < 0.2 THEN 'niche_topic' END, CASE WHEN score >= 70 AND mutation > 0.25 THEN 'independent_coverage' END, CASE WHEN burst > 5 AND burst < 15 THEN 'news_cycle' END], lambda x: x IS NOT NULL) AS l FROM fin)", "fin"))
def o02_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return report.interpretation(_scored(spark, d)).select("k", "alternatives")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-02-05 00:00:00' - INTERVAL 30 DAYS")
def s07_archived_rows(spark: SparkSession, d: str) -> DataFrame:
    return retention.archived(table(spark, d, "events"), "ts", F.lit("2024-02-05 00:00:00").cast("timestamp")).where("archived").select("event_id")
