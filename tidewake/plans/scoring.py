"""Queries over features, rules, scores, graphs, fingerprints, life cycles, credibility, reports, retention and streams."""
# ruff: noqa: E501

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import fixed_values as fixed
from tidewake.operators import campaigns, clustering, credibility, fingerprint, graph, lifecycle, reduction, relational, report, retention, rules, signals, temporal, vectors
from tidewake.plans import scenarios
from tidewake.plans.core import _PAIRS, ALIKE, _domains, r4
from tidewake.plans.registry import query
from tidewake.plans.storage import kept, shared_dir
from tidewake.plans.views import CTES, clustered, entities, posts, quoted, table, title_words, with_parts

AS_OF = "2024-02-15 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


# signals ------------------------------------------------------------------------------------------------------------------------

CTES["spr"] = "SELECT hd.cluster_id, hd.h AS dh, hd.k AS ud, hd.n, coalesce(hl.h, 0) AS lh, coalesce(hl.k, 0) AS lk, least(1.0, CASE WHEN coalesce(hl.h, 0) < 0.5 THEN 0.5 ELSE 1 END * (hd.h / 4 * 0.7 + coalesce(hl.h, 0) / 4 * 0.3)) AS spread FROM hd LEFT JOIN hl USING (cluster_id)"


@query(with_parts("SELECT cluster_id, n::BIGINT AS post_count, ud AS unique_domain_count, round(dh, 4) AS domain_entropy, round(lh, 4) AS language_entropy, round(spread, 4) AS spread FROM spr ORDER BY spread DESC, cluster_id LIMIT 10", "spr"))
def i02_spread(spark: SparkSession, d: str) -> DataFrame:
    s = signals.spread(clustered(spark, d), "cluster_id", "domain", "language")
    return s.orderBy(F.desc("spread"), "cluster_id").limit(10).select("cluster_id", "post_count", "unique_domain_count", r4("domain_entropy"), r4("language_entropy"), r4("spread"))


@query(with_parts("SELECT cluster_id, round(mutation, 4) AS mutation, round(similarity, 4) AS similarity FROM mut", "mut"))
def i03_mutation(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mutation(clustered(spark, d), "cluster_id", "vector").select("cluster_id", r4("mutation"), r4("similarity"))


CTES["ton"] = "SELECT cluster_id, CASE WHEN count(polarity) < 5 THEN 0 ELSE greatest(0, 1 - least(1, (0.6 * var_pop(polarity) + 0.4 * coalesce(var_pop(tone), var_pop(polarity))) / 2)) END AS tone_uniformity FROM cl GROUP BY cluster_id"


@query("SELECT event_type, round(greatest(0, 1 - least(1, (0.6 * var_pop(value / 20) + 0.4 * var_pop(value / 40)) / 2)), 4) AS tone_uniformity FROM events GROUP BY event_type")
def i04_tone(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("p", F.col("value") / 20).withColumn("t", F.col("value") / 40)
    return signals.tone_uniformity(e, "event_type", "p", "t").select("event_type", r4("tone_uniformity"))


CTES["gapc"] = "SELECT cluster_id, count(*) AS n, avg(g) AS m, stddev_pop(g) AS s FROM (SELECT cluster_id, (epoch_us(published_at) - lag(epoch_us(published_at)) OVER (PARTITION BY cluster_id ORDER BY published_at)) / 1e6 AS g FROM cl WHERE published_at IS NOT NULL) GROUP BY cluster_id"
_COORD = "CASE WHEN n < 5 OR m IS NULL OR m < 1 THEN 1.0 WHEN s / m < 0.3 THEN least(2.0, 1 + (0.3 - s / m) * 3) WHEN s / m < 0.5 THEN 1 + (0.5 - s / m) ELSE 1.0 END"


@query(with_parts(f"SELECT user_id, round({_COORD}, 4) AS coordination, n >= 5 AND m >= 1 AND s / m < 0.5 AS temporal_sync FROM gap", "gap"))
def i05_coordination(spark: SparkSession, d: str) -> DataFrame:
    return temporal.coordination(temporal.gaps(table(spark, d, "events"), "user_id", "ts")).select("user_id", r4("coordination"), "temporal_sync")


@query("WITH g AS (SELECT k, count(*) AS n, avg(g) AS m, stddev_pop(g) AS s FROM (SELECT event_id // 50 AS k, (epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY event_id // 50 ORDER BY t)) / 1e6 AS g FROM (SELECT event_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id * 900 + (event_id % (1 + event_id // 2000)) * 120) AS t FROM events)) GROUP BY k) SELECT k, n >= 5 AND m >= 1 AND (s / m < 0.15 OR (least(m % 900, 900 - m % 900) < 60 AND s / m < 0.25) OR s / m < 0.20 OR (least(m % 900, 900 - m % 900) < 60 AND s / m < 0.30)) AS batch_artifact FROM g")
def i10_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 50).alias("k"), F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") * 900 + (F.col("event_id") % (1 + F.floor(F.col("event_id") / 2000))) * 120).alias("t"))
    return temporal.batch_cadence(temporal.gaps(e, "k", "t"), F.lit(1.0)).select("k", "batch_artifact")


CTES["hash"] = "SELECT cluster_id, coalesce(count(DISTINCT nullif(content, '')) / nullif(count(nullif(content, '')), 0), 0) AS ratio FROM cl GROUP BY cluster_id"


@query("SELECT source, round(count(DISTINCT nullif(text, '')) / count(nullif(text, '')), 4) AS unique_hash_ratio FROM documents GROUP BY source")
def d06_hash_ratio(spark: SparkSession, d: str) -> DataFrame:
    return signals.hash_ratio(table(spark, d, "documents"), "source", "text").select("source", r4("unique_hash_ratio"))


CTES["path"] = "SELECT n.cluster_id, b.path, coalesce(b.domains, 0) AS path_domains, coalesce(b.c, 0) / n.n AS path_coverage FROM (SELECT cluster_id, count(*) AS n FROM cl GROUP BY cluster_id) n LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY c DESC, path) AS r FROM (SELECT cluster_id, path, count(*) AS c, count(DISTINCT domain) AS domains FROM cl WHERE length(path) > 3 AND length(domain) > 3 GROUP BY ALL)) WHERE r = 1) b USING (cluster_id)"


@query(with_parts("SELECT cluster_id, path, path_domains, round(path_coverage, 4) AS path_coverage FROM path", "path"))
def d13_shared_path(spark: SparkSession, d: str) -> DataFrame:
    return signals.shared_path(clustered(spark, d), "cluster_id", "domain", "path").select("cluster_id", "path", "path_domains", r4("path_coverage"))


CTES["wire"] = "SELECT cluster_id, avg(CASE WHEN domain IN (" + ", ".join(f"'{x}'" for x in (*fixed.WIRE_SERVICES, *fixed.SYNDICATORS)) + ") THEN 1.0 ELSE 0 END) AS wire_share, count(*) AS wire_domains FROM (SELECT DISTINCT cluster_id, domain FROM cl WHERE domain <> '') GROUP BY cluster_id"


@query("SELECT k, n >= 5 AND ((pd >= 3 AND pc >= 0.6 AND m < 0.4) OR (m < 0.25 AND dd >= 3 AND ws >= 0.8)) AS known, n >= 7 AND sim > 0.55 AND ((hr > 0.9 AND sd > 0.65) OR (hr > 0.85 AND sd > 0.4)) AS hashed FROM (SELECT event_id AS k, event_id % 12 AS n, event_id % 5 AS pd, (event_id % 10) / 10 AS pc, (event_id % 7) / 10 AS m, (event_id % 4) / 4 + 0.25 AS ws, event_id % 6 AS dd, (event_id % 9) / 8 AS sim, 0.8 + (event_id % 20) / 100 AS hr, (event_id % 11) / 10 AS sd FROM events)")
def i08_wire(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id AS k", "event_id % 12 AS n", "event_id % 5 AS pd", "(event_id % 10) / 10D AS pc", "(event_id % 7) / 10D AS m", "(event_id % 4) / 4D + 0.25D AS ws", "event_id % 6 AS dd", "(event_id % 9) / 8D AS sim", "0.8D + (event_id % 20) / 100D AS hr", "(event_id % 11) / 10D AS sd")
    c = F.col
    return e.select("k", signals.wire_known(c("n"), c("pd"), c("pc"), c("m"), c("ws"), c("dd")).alias("known"), signals.wire_hash(c("n"), c("sim"), c("hr"), c("sd")).alias("hashed"))


CTES["coh"] = "SELECT c.cluster_id, CASE WHEN c.n >= 3 AND c.covered >= 0.3 * c.n THEN greatest(0, least(1, 0.7 * c.continuity + 0.3 * coalesce(j.jaccard, 0))) ELSE 0.5 END AS coherence FROM cont c LEFT JOIN jac j USING (cluster_id)"


@query(with_parts("SELECT cluster_id, round(coherence, 4) AS narrative_coherence FROM coh", "coh"))
def i07_coherence(spark: SparkSession, d: str) -> DataFrame:
    p = clustered(spark, d)
    return signals.coherence(p, title_words(p), entities(p), "cluster_id", "post_id", "token", "entity").select("cluster_id", r4("narrative_coherence"))


@query(with_parts("SELECT b.cluster_id, b.n >= 8 AND b.share > 0.85 AND coalesce(j.jaccard, 0) < 0.15 AS single_source_bag, b.n >= 15 AND b.share <= 0.15 AND coalesce(j.jaccard, 0) < 0.12 AS multi_source_bag FROM (SELECT cluster_id, max(c) / sum(c) AS share, sum(c) AS n FROM (SELECT cluster_id, source, count(*) AS c FROM cl GROUP BY ALL) GROUP BY cluster_id) b LEFT JOIN jac j USING (cluster_id)", "cl", "jac"))
def j07_topic_bags(spark: SparkSession, d: str) -> DataFrame:
    p = clustered(spark, d)
    return clustering.topic_bags(p, title_words(p), "cluster_id", "post_id", "source", "token")


_NOISE = fixed.NOISE_TITLE.replace("'", "''")
CTES["flg"] = f"SELECT p.cluster_id, p.n >= 5 AND off >= greatest(3, n * 0.4) AS circadian_anomaly, p.n >= 5 AND outliers >= greatest(2, n * 0.3) AS content_anomaly, noise >= greatest(1, floor(n * 0.5)) AS content_noise, langs >= 3 AND least(1.0, dh / 4) > 0.3 AS cross_language_anomaly, p.n >= 5 AND manipulation >= greatest(3, n * 0.3) AND least(1.0, dh / 4) > 0.3 AS high_signal_topic FROM (SELECT cluster_id, count(*) AS n, count(*) FILTER (WHERE hour(published_at) BETWEEN 1 AND 5) AS off, count(*) FILTER (WHERE value * 8 > 35 AND value * 3 > 12 AND value / 40 < 0.3) AS outliers, count(*) FILTER (WHERE theme IN {quoted(fixed.MANIPULATION_THEMES)}) AS manipulation, count(*) FILTER (WHERE length(coalesce(title, '')) < 20 OR regexp_matches(coalesce(title, ''), '(?i){_NOISE}')) AS noise, count(DISTINCT language) FILTER (WHERE language NOT IN ('translated', 'unknown', '')) AS langs FROM cl GROUP BY cluster_id) p JOIN (SELECT cluster_id, dh FROM spr) USING (cluster_id)"


@query(with_parts("SELECT * FROM flg", "flg"))
def i11_flags(spark: SparkSession, d: str) -> DataFrame:
    p = clustered(spark, d)
    s = signals.spread(p, "cluster_id", "domain", "language").select("cluster_id", F.least(F.lit(1.0), F.col("domain_entropy") / 4).alias("source_diversity"))
    return signals.flags(p, "cluster_id", "published_at", "title", "language", "themes", F.col("tone_parts"), s)


# a table of features that reaches every rule --------------------------------------------------------------------------------------

_FEATURES = {
    "post_count": "event_id % 60", "burst": "(event_id % 23) / 2D", "spread": "(event_id % 21) / 20D", "mutation": "(event_id % 17) / 20D", "coordination": "1 + (event_id % 13) / 15D", "tone_uniformity": "(event_id % 11) / 10D", "shared_entity_count": "event_id % 6",
    "source_diversity": "(event_id % 19) / 18D", "batch_artifact": "event_id % 29 = 0", "wire_known": "event_id % 7 = 0", "wire_hash": "event_id % 9 = 0", "dna_match_count": "event_id % 13 - 1", "narrative_coherence": "(event_id % 31) / 30D", "unique_domain_count": "event_id % 15",
    "language_count": "event_id % 4 + 1", "strong_match_count": "event_id % 37", "cross_topic": "event_id % 41 = 0", "circadian_anomaly": "event_id % 8 = 0", "content_anomaly": "event_id % 10 = 0", "content_noise": "event_id % 12 = 0", "cross_language_anomaly": "event_id % 14 = 0",
    "geographic_spread": "event_id % 43 = 0", "high_signal_topic": "event_id % 16 = 0", "domain_entropy": "(event_id % 25) / 6D", "translated": "event_id % 3 = 0",
}


def _plain(sql: str) -> str:
    """Spark's double literals without their D."""
    import re

    return re.sub(r"(?<=\d)D\b", "", sql)


CTES["ft"] = "SELECT event_id AS k, " + ", ".join(f"{_plain(v)} AS {n}" for n, v in _FEATURES.items()) + " FROM events"


def _features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id AS k", *(f"{v} AS {n}" for n, v in _FEATURES.items()))


def _member(w) -> str:
    return f"round(greatest(0, least(100, 100 / (1 + exp(-({w[0]} * burst + {w[1]} * spread - {w[2]} * mutation + {w[3]} * tone_uniformity))) * coordination)), 2)"


CTES["raw"] = "SELECT *, round((s1 * 0.33 + s2 * 0.33 + s3 * 0.34) / 1.0, 2) AS raw_score, greatest(s1, s2, s3) - least(s1, s2, s3) AS ensemble_disagreement FROM (SELECT *, " + ", ".join(f"{_member(w)} AS s{i + 1}" for i, w in enumerate(signals.ENSEMBLE.values())) + " FROM ft)"


@query(with_parts("SELECT k, round(raw_score, 1) AS raw_score, round(ensemble_disagreement, 1) AS ensemble_disagreement FROM raw", "raw"))
def i12_raw_velocity(spark: SparkSession, d: str) -> DataFrame:
    return signals.raw_velocity(_features(spark, d)).select("k", rules.rounded(F.col("raw_score"), 1).alias("raw_score"), rules.rounded(F.col("ensemble_disagreement"), 1).alias("ensemble_disagreement"))


CTES["cf"] = """SELECT *, CASE WHEN dna_match_count >= 5 AND p < 0.65 THEN least(0.70, p + 0.10) ELSE p END AS conf, 1 / sqrt(greatest(3, post_count)) AS mg FROM (
SELECT *, greatest(0.05, least(0.95, CASE WHEN language_count > 1 AND NOT translated THEN p4 * 1.1 ELSE p4 END)) AS p FROM (
SELECT *, CASE WHEN unique_domain_count <= 1 THEN least(p3, 0.40) ELSE p3 END AS p4 FROM (
SELECT *, CASE WHEN domain_entropy < 0.20 THEN p2 * 0.5 ELSE p2 END AS p3 FROM (
SELECT *, greatest(0.05, least(0.95, (p1 + CASE WHEN dna_match_count >= 10 THEN 0.10 WHEN dna_match_count >= 5 THEN 0.07 WHEN dna_match_count >= 1 THEN 0.04 ELSE 0 END) * q)) AS p2 FROM (
SELECT *, p0 * CASE WHEN post_count < 10 AND domain_entropy < 0.3 AND mutation < 0.1 THEN 0.9 ELSE 1 END AS p1,
  least(CASE WHEN post_count < 10 THEN 0.88 WHEN post_count < 25 THEN 0.93 ELSE 1 END, CASE WHEN domain_entropy < 0.3 THEN 0.90 ELSE 1 END, CASE WHEN spread > 0.5 AND mutation > 0.3 THEN 0.88 ELSE 1 END, CASE WHEN batch_artifact THEN 0.82 ELSE 1 END, CASE WHEN dna_match_count = 0 AND post_count < 20 THEN 0.75 WHEN dna_match_count = 0 AND post_count < 50 THEN 0.85 ELSE 1 END)::DOUBLE AS q FROM (
SELECT *, (0.55 + CASE WHEN burst > 10 THEN 0.12 WHEN burst > 5 THEN 0.07 ELSE 0 END + CASE WHEN mutation < 0.1 THEN 0.12 WHEN mutation < 0.2 THEN 0.07 ELSE 0 END + CASE WHEN coordination > 1.5 THEN 0.12 WHEN coordination > 1.2 THEN 0.07 ELSE 0 END
  + CASE WHEN spread < 0.15 THEN 0.12 WHEN spread < 0.3 THEN 0.07 ELSE 0 END + CASE WHEN raw_score >= 80 THEN 0.08 WHEN raw_score >= 60 THEN 0.05 ELSE 0 END)::DOUBLE AS p0 FROM raw))))))"""


@query(with_parts("SELECT k, round(conf, 9) AS confidence, round(greatest(0.05, least(p, p * (1 - mg))), 9) AS lower, round(least(0.99, greatest(p, p * (1 + mg / 2))), 9) AS upper, CASE WHEN post_count >= 50 AND domain_entropy >= 0.4 THEN 'sufficient' WHEN post_count >= 15 THEN 'moderate' WHEN post_count >= 5 THEN 'marginal' ELSE 'insufficient' END AS adequacy FROM cf", "cf"))
def i13_confidence(spark: SparkSession, d: str) -> DataFrame:
    c = signals.confidence(signals.raw_velocity(_features(spark, d)), digits=9)
    return c.select("k", "confidence", F.col("confidence_lower").alias("lower"), F.col("confidence_upper").alias("upper"), "adequacy")


_FIRE = ["batch_artifact", *(f"({_plain(r.when)})" + (" AND NOT batch_artifact" if r.kind in ("cap", "boost") else "") for r in rules.RULES[1:])]
CTES["fired"] = "SELECT *, [" + ", ".join(f"CASE WHEN {w} THEN '{r.name}' END" for w, r in zip(_FIRE, rules.RULES)) + "] AS f, list_min([" + ", ".join(f"CASE WHEN {w} THEN {_plain(r.cap)} END" for w, r in zip(_FIRE, rules.RULES)) + "]) AS cap, list_max([" + ", ".join(f"CASE WHEN {w} THEN {_plain(r.floor)} END" for w, r in zip(_FIRE, rules.RULES)) + "]) AS floor, list_filter([" + ", ".join(f"CASE WHEN {w} THEN {_plain(r.level)} END" for w, r in zip(_FIRE, rules.RULES)) + "], lambda x: x IS NOT NULL) AS lv FROM (SELECT *, round(conf, 3) AS confidence FROM cf)"
CTES["fin"] = "SELECT *, list_filter(f, lambda x: x IS NOT NULL) AS rules_fired, batch_artifact OR content_noise OR confidence < 0.65 AS suppressed, CASE WHEN batch_artifact THEN 0 ELSE round(greatest(least(raw_score, coalesce(cap, 100)), coalesce(floor, 0)), 2) END AS score FROM fired"


@query(with_parts("SELECT k, rules_fired, coalesce(cap, 100)::DOUBLE AS cap, coalesce(floor, 0)::DOUBLE AS floor, suppressed FROM fin", "fin"))
def i14_rules(spark: SparkSession, d: str) -> DataFrame:
    f = rules.apply_rules(signals.confidence(signals.raw_velocity(_features(spark, d))))
    return f.select("k", "rules_fired", "cap", "floor", "suppressed")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return rules.final_score(rules.apply_rules(signals.confidence(signals.raw_velocity(_features(spark, d)))))


_LEVEL = "CASE WHEN suppressed THEN 'normal' WHEN list_contains(lv, 'critical') THEN 'critical' WHEN list_contains(lv, 'elevated') THEN 'elevated' WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'elevated' ELSE 'normal' END"


@query(with_parts(f"SELECT k, round(score, 1) AS score, {_LEVEL} AS alert_level FROM fin", "fin"))
def i16_final_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("k", rules.rounded(F.col("score"), 1).alias("score"), "alert_level")


@query(with_parts("SELECT rule, count(*) AS n FROM (SELECT unnest(rules_fired) AS rule FROM fin) GROUP BY rule", "fin"))
def i17_rule_signals(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select(F.explode("rules_fired").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


CTES["gsrc"] = f"SELECT cluster_id, sum(c) AS n, sum(fed) / sum(c) AS fed, max(c) / sum(c) AS share FROM (SELECT cluster_id, source, count(*) AS c, count(*) FILTER (WHERE feed IN {quoted(fixed.FEEDS)}) AS fed FROM cl GROUP BY ALL) GROUP BY cluster_id"
CTES["glng"] = "SELECT cluster_id, count(DISTINCT coalesce(language, 'unknown')) AS lc, bool_or(coalesce(language, 'unknown') = 'translated') AS tr FROM cl GROUP BY cluster_id"
CTES["gbur"] = "SELECT cluster_id, CASE WHEN epoch(l) - epoch(f) < 60 OR buckets < 2 OR s < 0.01 THEN 0 ELSE greatest(-10, least(10, (newest - m) / s)) END AS burst FROM (SELECT cluster_id, count(*) AS buckets, avg(c) AS m, stddev_pop(c) AS s, arg_max(c, b) AS newest, min(f) AS f, max(l) AS l FROM (SELECT cluster_id, time_bucket(INTERVAL 15 MINUTES, published_at) AS b, count(*) AS c, min(published_at) AS f, max(published_at) AS l FROM cl WHERE published_at IS NOT NULL GROUP BY ALL) GROUP BY cluster_id)"
_CADENCE = "coalesce(a.n >= 5 AND a.m >= 1 AND ((g.fed >= 1 AND (a.s / a.m < 0.15 OR (least(a.m % 900, 900 - a.m % 900) < 60 AND a.s / a.m < 0.25))) OR (g.fed >= 0.8 AND (a.s / a.m < 0.20 OR (least(a.m % 900, 900 - a.m % 900) < 60 AND a.s / a.m < 0.30)))), false)"
_KNOWN = "coalesce(g.n >= 5 AND ((pt.path_domains >= 3 AND pt.path_coverage >= 0.6 AND mu.mutation < 0.4) OR (mu.mutation < 0.25 AND wi.wire_domains >= 3 AND wi.wire_share >= 0.8)), false)"
_HASHED = "coalesce(g.n >= 7 AND mu.similarity > 0.55 AND ((ha.ratio > 0.9 AND least(1.0, sp.dh / 4) > 0.65) OR (ha.ratio > 0.85 AND least(1.0, sp.dh / 4) > 0.4)), false)"
CTES["gft"] = (
    f"SELECT g.cluster_id AS k, g.n AS post_count, coalesce(bu.burst, 0) AS burst, coalesce(sp.spread, 0) AS spread, coalesce(mu.mutation, 0.5) AS mutation, CASE WHEN {_CADENCE} THEN 1.0 ELSE coalesce(a.coord, 1.0) END AS coordination, coalesce(t.tone_uniformity, 0) AS tone_uniformity, co.shared AS shared_entity_count, "
    f"coalesce(least(1.0, sp.dh / 4), 0) AS source_diversity, {_CADENCE} AS batch_artifact, {_KNOWN} AS wire_known, {_HASHED} AS wire_hash, -1 AS dna_match_count, CASE WHEN g.n >= 15 AND g.share <= 0.15 AND coalesce(j.jaccard, 0) < 0.12 THEN 0 ELSE ch.coherence END AS narrative_coherence, coalesce(sp.ud, 0) AS unique_domain_count, "
    "lg.lc AS language_count, 0 AS strong_match_count, false AS cross_topic, fl.circadian_anomaly, fl.content_anomaly, fl.content_noise, fl.cross_language_anomaly, false AS geographic_spread, fl.high_signal_topic, coalesce(sp.dh, 0) AS domain_entropy, lg.tr AS translated "
    f"FROM gsrc g JOIN glng lg USING (cluster_id) LEFT JOIN gbur bu USING (cluster_id) LEFT JOIN spr sp USING (cluster_id) LEFT JOIN mut mu USING (cluster_id) LEFT JOIN (SELECT *, {_COORD} AS coord FROM gapc) a USING (cluster_id) LEFT JOIN ton t USING (cluster_id) LEFT JOIN con co USING (cluster_id) "
    "LEFT JOIN hash ha USING (cluster_id) LEFT JOIN path pt USING (cluster_id) LEFT JOIN wire wi USING (cluster_id) LEFT JOIN coh ch USING (cluster_id) LEFT JOIN jac j USING (cluster_id) LEFT JOIN flg fl USING (cluster_id)"
)
for _name, _from in (("raw", "ft"), ("cf", "raw"), ("fired", "cf"), ("fin", "fired")):
    CTES[f"g{_name}"] = CTES[_name].replace(f"FROM {_from}", f"FROM g{_from}")


@query(with_parts(f"SELECT k AS cluster_id, post_count::BIGINT AS post_count, round(spread, 4) AS spread, round(mutation, 4) AS mutation, round(burst, 4) AS burst, raw_score, confidence, rules_fired, score, {_LEVEL} AS alert_level, suppressed FROM gfin", "gfin"))
def i19_score_groups(spark: SparkSession, d: str) -> DataFrame:
    p = kept(clustered(spark, d), "clustered")
    return signals.score_groups(p, title_words(p), entities(p)).select("cluster_id", "post_count", r4("spread"), r4("mutation"), r4("burst"), "raw_score", "confidence", "rules_fired", "score", "alert_level", "suppressed")


# reports --------------------------------------------------------------------------------------------------------------------------


@query(with_parts("SELECT k, CASE WHEN score >= 90 THEN 'Extreme' WHEN score >= 80 THEN 'Very High' WHEN score >= 60 THEN 'High' WHEN score >= 40 THEN 'Moderate' WHEN score >= 20 THEN 'Low' ELSE 'Minimal' END AS velocity_name, CASE WHEN mutation < 0.05 THEN 'Nearly Identical' WHEN mutation < 0.1 THEN 'Very Similar' WHEN mutation < 0.2 THEN 'Similar' WHEN mutation < 0.4 THEN 'Moderately Varied' ELSE 'Highly Varied' END AS similarity_name, CASE WHEN score >= 80 AND mutation < 0.15 THEN 'near_identical_reporting' WHEN score >= 80 THEN 'broad_independent_attention' WHEN burst > 10 AND spread < 0.15 THEN 'narrow_surge' WHEN score >= 50 THEN 'above_normal' WHEN coordination > 1.3 THEN 'regular_timing' ELSE 'normal' END AS insight, CASE WHEN post_count < 10 THEN 'low_few_sources' WHEN source_diversity < 0.3 AND spread < 0.15 THEN 'moderate_one_source_type' WHEN post_count >= 50 AND source_diversity >= 0.5 THEN 'high' ELSE 'moderate' END AS confidence_note, len(list_filter([mutation < 0.15, coordination > 1.3, burst > 10 AND spread > 0.3, spread < 0.2, score >= 70 AND mutation > 0.25, burst > 5 AND burst < 15], lambda x: x)) AS n_alternatives FROM fin", "fin"))
def o01_interpretation(spark: SparkSession, d: str) -> DataFrame:
    i = report.interpretation(_scored(spark, d))
    n = F.when(F.array_contains("alternatives", "normal_activity"), 0).otherwise(F.size("alternatives")).cast("long")
    return i.select("k", "velocity_name", "similarity_name", "insight", "confidence_note", n.alias("n_alternatives"))


@query(with_parts("SELECT k, list_filter(CASE WHEN len(rules_fired) > 0 THEN [CASE WHEN list_contains(rules_fired, 'organic_viral_spread') THEN 1 END, CASE WHEN list_contains(rules_fired, 'normal_news_cycle') THEN 2 END, CASE WHEN list_contains(rules_fired, 'wire_service') THEN 3 END, CASE WHEN list_contains(rules_fired, 'insufficient_evidence') THEN 4 END] ELSE [CASE WHEN mutation > 0.3 AND source_diversity > 0.6 THEN 1 END, CASE WHEN coordination < 1.1 AND burst < 5 THEN 2 END, CASE WHEN wire_known THEN 3 END, CASE WHEN post_count < 10 THEN 4 END] END, lambda x: x IS NOT NULL) AS criteria FROM fin", "fin"))
def o16_falsification(spark: SparkSession, d: str) -> DataFrame:
    return report.falsification_block(_scored(spark, d)).select("k", "criteria")


_VERDICT = "coalesce(list_filter(list_transform(rules_fired, lambda r: CASE " + " ".join(f"WHEN r = '{a}' THEN '{b}'" for a, b in fixed.RULE_VERDICTS.items()) + " END), lambda x: x IS NOT NULL)[1], CASE WHEN suppressed THEN 'ALERT_SUPPRESSED' END, CASE WHEN " + _LEVEL + " = 'normal' THEN 'NORMAL_COVERAGE' ELSE 'NARRATIVE_ELEVATED' END)"


@query(with_parts(f"SELECT k, CASE WHEN k % 50 = 1 THEN 'TOPIC_BAG' ELSE {_VERDICT} END AS verdict FROM fin", "fin"))
def o17_verdict(spark: SparkSession, d: str) -> DataFrame:
    return report.evidence_verdict(_scored(spark, d).withColumn("single_source_bag", F.col("k") % 50 == 1)).select("k", "verdict")


@query(with_parts("SELECT k, CASE WHEN post_count < 5 THEN 'INSUFFICIENT_DATA' WHEN suppressed OR ((wire_known OR wire_hash) AND mutation < 0.1 AND source_diversity < 0.3) OR batch_artifact OR (k % 50 = 1 AND ensemble_disagreement < 1 AND post_count < 15) THEN 'NARRATIVE_SIGNAL_REDUCED' WHEN score > 60 AND confidence > 0.65 AND (strong_match_count >= 1 OR (mutation < 0.15 AND source_diversity > 0.5)) THEN 'HIGH' ELSE 'UNCERTAIN' END AS public_verdict FROM fin", "fin"))
def o06_public_verdict(spark: SparkSession, d: str) -> DataFrame:
    return report.public_verdict(_scored(spark, d).withColumn("single_source_bag", F.col("k") % 50 == 1)).select("k", "public_verdict")


@query(with_parts("SELECT k, sha256(pack) AS sha256 FROM (SELECT doc_id AS k, '{\"pack_id\":\"pack-1-' || doc_id || '\",\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS pack FROM documents)"))
def o18_pack_hash(spark: SparkSession, d: str) -> DataFrame:
    p = report.evidence_packs(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return report.verified(p).where("valid").select(F.col("doc_id").alias("k"), "sha256")


@query(with_parts(f"SELECT k, round(score, 1) AS score FROM (SELECT *, {_LEVEL} AS alert_level FROM fin) WHERE NOT suppressed AND post_count >= 8 AND alert_level <> 'normal' ORDER BY round(score, 1) DESC, k LIMIT 20", "fin"))
def o04_feed(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).where("NOT suppressed AND post_count >= 8 AND alert_level <> 'normal'")
    return s.select("k", rules.rounded(F.col("score"), 1).alias("score")).orderBy(F.desc("score"), "k").limit(20)


@query(with_parts(f"SELECT camp, count(*) AS members, count(*) FILTER (WHERE alert_level = 'critical') AS critical, count(*) FILTER (WHERE alert_level = 'elevated') AS elevated, round(avg(score), 2) AS mean_score FROM (SELECT *, k % 7 AS camp, {_LEVEL} AS alert_level FROM fin) GROUP BY camp", "fin"))
def o07_campaign_alerts(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy((F.col("k") % 7).alias("camp")).agg(F.count("*").alias("members"), F.count_if(F.col("alert_level") == "critical").alias("critical"), F.count_if(F.col("alert_level") == "elevated").alias("elevated"), F.round(F.avg("score"), 2).alias("mean_score"))


@query(with_parts("SELECT (SELECT count(*) FROM posts) AS posts, (SELECT count(DISTINCT source) FROM posts) AS sources, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT label) FROM embeddings) AS clusters, (SELECT count(*) FROM events WHERE value > 5) AS alerts", "posts"))
def o08_stats(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d).agg(F.count("*").alias("posts"), F.count_distinct("source").alias("sources"))
    e = table(spark, d, "embeddings").agg(F.count("*").alias("vectors"), F.count_distinct("label").alias("clusters"))
    return p.crossJoin(e).crossJoin(table(spark, d, "events").agg(F.count_if(F.col("value") > 5).alias("alerts")))  # one row each


@query("SELECT user_id, event_id, CASE WHEN value >= 8 THEN 'critical' ELSE 'elevated' END AS level FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts > TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 720 HOURS) WHERE r = 1 AND value >= 6")
def o09_alerts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.col("ts").cast("timestamp") > as_of() - F.expr("INTERVAL 720 HOURS"))
    return relational.latest(e, "user_id", F.desc("ts"), F.desc("event_id")).where("value >= 6").select("user_id", "event_id", F.when(F.col("value") >= 8, "critical").otherwise("elevated").alias("level"))


@query("SELECT source, count(*) AS posts, count(DISTINCT lang) AS languages, round(avg(n_chars), 2) AS mean_chars FROM documents GROUP BY source ORDER BY posts DESC, source LIMIT 50")
def o11_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("posts"), F.count_distinct("lang").alias("languages"), F.round(F.avg("n_chars"), 2).alias("mean_chars")).orderBy(F.desc("posts"), "source").limit(50)


@query("SELECT doc_id FROM documents WHERE text ILIKE '%thea%' AND n_chars >= 500 ORDER BY n_chars DESC, doc_id LIMIT 20")
def o12_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").ilike("%thea%") & (F.col("n_chars") >= 500)).orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id")


@query(with_parts("SELECT k, CASE WHEN k % 97 = 0 THEN 'missing' WHEN abs(score - was) > 5 AND array_to_string(list_sort(rules_fired), ',') <> 'confidence_threshold,dna_match' THEN 'drift_both' WHEN abs(score - was) > 5 THEN 'drift_score' WHEN array_to_string(list_sort(rules_fired), ',') <> 'confidence_threshold,dna_match' THEN 'drift_rules' ELSE 'ok' END AS status FROM (SELECT *, 22.0 + (k % 5) AS was FROM fin)", "fin"))
def p08_drift(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    base = s.select("k", (22.0 + (F.col("k") % 5)).alias("was_score"), F.array(F.lit("dna_match"), F.lit("confidence_threshold")).alias("was_rules"))
    return report.drift(base, s.where("k % 97 <> 0"), "k")


@query(with_parts("SELECT k, list_contains(rules_fired, 'dna_match') AS rules_pass, score <= 30 AS score_pass, suppressed = (k % 2 = 0) AS suppression_pass, list_contains(rules_fired, 'dna_match') AND score <= 30 AND suppressed = (k % 2 = 0) AS overall FROM fin", "fin"))
def p09_fixture_check(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    fixtures = s.select("k", F.array(F.lit("dna_match")).alias("expected_rules"), F.lit(False).alias("exact"), F.lit(30.0).alias("score_max"), (F.col("k") % 2 == 0).alias("expected_suppressed"))
    return report.fixture_check(fixtures, s, "k")


def _changed(name: str) -> str:
    literal = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    cases = " ".join(f"WHEN '{s}' THEN {literal(changed[name])}" for s, changed, *_ in scenarios.SCENARIOS if name in changed)
    return f"CASE name {cases} ELSE {name} END AS {name}"


_CHANGED = sorted({c for _, changed, *_ in scenarios.SCENARIOS for c in changed})
CTES["scen"] = f"SELECT * REPLACE ({', '.join(map(_changed, _CHANGED))}) FROM (SELECT *, round(conf, 3) AS confidence FROM gcf), (VALUES " + ", ".join(f"('{n}', {w}, {'NULL' if down is None else down}, {cap})" for n, _, w, down, cap in scenarios.SCENARIOS) + ") t(name, want, down, most_cap)"
CTES["scenf"] = CTES["fired"].replace("(SELECT *, round(conf, 3) AS confidence FROM cf)", "scen")
CTES["scenr"] = "SELECT k, name, want, list_sort(list_filter(f, lambda x: x IS NOT NULL)) AS got, down, batch_artifact OR content_noise OR confidence < 0.65 AS stopped, CASE WHEN batch_artifact THEN 0 ELSE coalesce(cap, 100) END AS cap, most_cap FROM scenf"


def _what_if(spark: SparkSession, d: str) -> DataFrame:
    p = kept(clustered(spark, d), "clustered")
    features = signals.score_groups(p, title_words(p), entities(p))
    return scenarios.evaluate(scenarios.scenario_table(kept(features.select("cluster_id", *(c for c in rules.FEATURES if c in features.columns)), "features"), "cluster_id"), "cluster_id")


@query(with_parts("SELECT k AS cluster_id, name, got AS actual_rules, stopped AS actual_suppressed, cap::DOUBLE AS actual_cap, list_has_all(got, want) AND coalesce(stopped = down, true) AND cap <= most_cap + 0.01 AS passed FROM scenr", "scenr"))
def p10_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return _what_if(spark, d).select("cluster_id", "name", "actual_rules", "actual_suppressed", "actual_cap", "passed")


@query(with_parts("SELECT rule, count(*) FILTER (WHERE list_contains(got, rule) AND list_contains(want, rule)) AS tp, count(*) FILTER (WHERE list_contains(got, rule) AND NOT list_contains(want, rule)) AS fp, count(*) FILTER (WHERE NOT list_contains(got, rule) AND list_contains(want, rule)) AS fn FROM scenr, (SELECT unnest([" + ", ".join(f"'{r.name}'" for r in rules.RULES) + "]) AS rule) GROUP BY rule", "scenr"))
def p10_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return scenarios.by_rule(_what_if(spark, d)).select("rule", "tp", "fp", "fn")


# credibility and life cycle ---------------------------------------------------------------------------------------------------------


@query(with_parts("SELECT g, category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY g), 4) AS share, round(avg(score), 4) AS mean_score FROM (SELECT page_id % 5 AS g, category, score FROM cred) GROUP BY g, category", "cred"))
def d22_breakdown(spark: SparkSession, d: str) -> DataFrame:
    s = credibility.scored_domains(spark, _domains(spark, d), "domain").withColumn("g", F.col("page_id") % 5)
    return credibility.breakdown(s, "g").select("g", "category", "n", r4("share"), r4("mean_score"))


@query(with_parts("SELECT g, CASE WHEN ok >= 60 THEN ok || '% established outlets' WHEN st >= 30 THEN st || '% state-affiliated outlets' WHEN un >= 50 THEN un || '% unverified outlets' ELSE n || ' outlets of ' || kinds || ' kinds' END AS context FROM (SELECT page_id % 5 AS g, round(100 * avg(CASE WHEN category IN ('wire_service', 'major_editorial') THEN 1 ELSE 0 END))::INT AS ok, round(100 * avg(CASE WHEN category = 'state_media' THEN 1 ELSE 0 END))::INT AS st, round(100 * avg(CASE WHEN category = 'unknown' THEN 1 ELSE 0 END))::INT AS un, count(*) AS n, count(DISTINCT category) AS kinds FROM cred GROUP BY 1)", "cred"))
def d23_source_text(spark: SparkSession, d: str) -> DataFrame:
    s = credibility.scored_domains(spark, _domains(spark, d), "domain").withColumn("g", F.col("page_id") % 5)
    return report.source_text(credibility.breakdown(s, "g"), "g")


@query("WITH m AS (SELECT source, lang AS cluster_id, CASE WHEN lang = 'en' THEN 70 ELSE 30 END AS score, (doc_id % 10) / 10 AS mutation, 1 + (doc_id % 4) / 4 AS coordination FROM documents), p AS (SELECT source, count(DISTINCT CASE WHEN score >= 60 THEN cluster_id END) / count(DISTINCT cluster_id) AS part, count(*) FILTER (WHERE score >= 60) AS alerts, avg(mutation) AS mut, avg(coordination) AS coord FROM m GROUP BY source) SELECT source, round(CASE WHEN alerts > 0 THEN greatest(0.05, least(0.99, 0.6 * (1 - 0.2 * least(1, 5 * part)) * (0.8 + 0.2 * least(1, coalesce(nullif(mut, 0), 0.5))) * (1 - 0.1 * greatest(0, coalesce(nullif(coord, 0), 1) - 1)))) ELSE 0.6 END, 4) AS adjusted FROM p")
def d20_source_adjust(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    m = t.select("source", F.col("lang").alias("cluster_id"), F.when(F.col("lang") == "en", 70).otherwise(30).alias("score"), ((F.col("doc_id") % 10) / 10).alias("mutation"), (1 + (F.col("doc_id") % 4) / 4).alias("coordination"))
    return credibility.adjusted(t.select("source").distinct().withColumn("base", F.lit(0.6)), m, "source")


CTES["ser"] = "SELECT user_id, ts, value * 10 AS v, (value * 10 - lag(value * 10) OVER (PARTITION BY user_id ORDER BY ts)) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 / 3600, 0) AS d1, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS newest FROM events"
CTES["ser2"] = "SELECT *, d1 - lag(d1) OVER (PARTITION BY user_id ORDER BY ts) AS d2 FROM ser"


@query(with_parts("SELECT user_id, CASE WHEN k < 2 THEN 'emergence' WHEN idle > 12 OR (cur < 20 AND age > 12) THEN 'dormant' WHEN age < 6 THEN 'emergence' WHEN steps >= 2 AND lo > 0 THEN 'growth' WHEN cur >= 0.9 * peak AND last_d <= 0 AND peak > 30 THEN 'peak' WHEN k >= 3 AND h3 - l3 <= 0.15 * peak AND peak > 30 THEN 'saturation' WHEN steps >= 2 AND hi < 0 THEN 'decay' ELSE 'emergence' END AS phase, round(peak, 4) AS peak, round(cur, 4) AS current, CASE WHEN bend > 0.5 THEN 'accelerating' WHEN bend < -0.5 THEN 'decelerating' ELSE 'steady' END AS trajectory FROM (SELECT user_id, count(*) AS k, max(v) AS peak, arg_max(v, ts) AS cur, (epoch(TIMESTAMP '2024-01-30 23:00:00') - epoch(max(ts))) / 3600 AS idle, (epoch(TIMESTAMP '2024-01-30 23:00:00') - epoch(min(ts))) / 3600 AS age, count(*) FILTER (WHERE newest <= 3 AND d1 IS NOT NULL) AS steps, min(d1) FILTER (WHERE newest <= 3) AS lo, max(d1) FILTER (WHERE newest <= 3) AS hi, max(d1) FILTER (WHERE newest = 1) AS last_d, avg(d2) FILTER (WHERE newest <= 3) AS bend, min(v) FILTER (WHERE newest <= 3) AS l3, max(v) FILTER (WHERE newest <= 3) AS h3 FROM ser2 GROUP BY user_id)", "ser2"))
def n01_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.col("value") * 10)
    return lifecycle.phases(e, "user_id", "ts", "v", F.lit("2024-01-30 23:00:00").cast("timestamp")).select("user_id", "phase", r4("peak"), r4("current"), "trajectory")


# graph and campaigns ---------------------------------------------------------------------------------------------------------------

CTES["eg"] = "SELECT a.user_id AS src, b.user_id AS dst, count(*) AS weight FROM events a JOIN events b ON a.user_id <> b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 600 SECONDS GROUP BY ALL"
CTES["un"] = "SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM eg"
CTES["nb"] = "SELECT u AS n, v AS m FROM un UNION ALL SELECT v, u FROM un"


def _ends(spark: SparkSession, d: str) -> DataFrame:
    """The ends of all edges, as in the SQL: only l01's are cut to a node's heaviest."""
    return graph.follow_ends(table(spark, d, "events"), "user_id", "ts", 600)


@query(with_parts("SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM eg) WHERE r <= 100", "eg"))
def l01_amplification_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.amplification_edges(table(spark, d, "events"), "user_id", "ts", 600)


@query(with_parts("SELECT d.n AS node, d.degree, coalesce(t.t, 0) AS triangles, round(CASE WHEN d.degree < 2 THEN 0 ELSE 2 * coalesce(t.t, 0) / (d.degree * (d.degree - 1)) END, 4) AS coefficient FROM (SELECT n, count(*) AS degree FROM nb GROUP BY n) d LEFT JOIN (SELECT a.n, count(*) // 2 AS t FROM nb a JOIN nb b ON a.n = b.n AND a.m <> b.m JOIN nb c ON c.n = a.m AND c.m = b.m GROUP BY a.n) t USING (n)", "nb"))
def l03_clustering_coeff(spark: SparkSession, d: str) -> DataFrame:
    return graph.follow_clustering(table(spark, d, "events"), "user_id", "ts", 600).select("node", "degree", "triangles", r4("coefficient"))


@query(with_parts("SELECT (SELECT count(DISTINCT n) FROM nb) AS nodes, (SELECT count(*) FROM eg) AS edges, round((SELECT count(*) FROM eg) / ((SELECT count(DISTINCT n) FROM nb) * ((SELECT count(DISTINCT n) FROM nb) - 1)), 4) AS density, round((SELECT count(*) FROM eg a JOIN eg b ON a.src = b.dst AND a.dst = b.src) / (SELECT count(*) FROM eg), 4) AS reciprocity, round(avg(d), 4) AS mean, round(stddev_pop(d), 4) AS std, median(d) AS median FROM (SELECT n, count(*) AS d FROM (SELECT src AS n FROM eg UNION ALL SELECT dst FROM eg) GROUP BY n)", "nb", "eg"))
def l06_degree_metrics(spark: SparkSession, d: str) -> DataFrame:
    return graph.metrics_of(_ends(spark, d)).select("nodes", "edges", r4("density"), r4("reciprocity"), r4("mean"), r4("std"), "median")


@query()
def l04_paths_l05_small_world_l08_centrality(spark: SparkSession, d: str) -> DataFrame:
    p = clustered(spark, d).where("published_at is not null")
    return graph.group_graphs(graph.amplification_edges(p, "source", "published_at", 7200, by=("cluster_id",)), "cluster_id")


@query(with_parts("SELECT cluster_id, src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, src ORDER BY weight DESC, dst) AS r FROM (SELECT a.cluster_id, a.source AS src, b.source AS dst, count(*) AS weight FROM cl a JOIN cl b ON a.cluster_id = b.cluster_id AND a.source <> b.source AND b.published_at > a.published_at AND b.published_at <= a.published_at + INTERVAL 7200 SECONDS GROUP BY ALL)) WHERE r <= 100", "cl"))
def l02_ego_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.amplification_edges(clustered(spark, d), "source", "published_at", 7200, by=("cluster_id",))


@query("WITH m AS (SELECT event_id AS k, event_id % 50 AS nodes, event_id % 80 AS edges, (event_id % 10) / 10 AS clustering, (event_id % 7) / 2 AS path_length, (event_id % 5)::DOUBLE AS small_world, (event_id % 9)::DOUBLE AS mean, (event_id % 20)::DOUBLE AS std, (event_id % 40)::DOUBLE AS most, (event_id % 11) / 20 AS reciprocity, (event_id % 13) / 30 AS core_ratio, (event_id % 15) / 10 - 1 AS in_out, (event_id % 100) / 120 AS density FROM events) SELECT k, CASE WHEN nodes >= 3 AND edges >= 2 THEN round((CASE WHEN clustering > 0.6 THEN 0.15 ELSE 0 END + CASE WHEN path_length < 2.5 AND nodes > 5 THEN 0.15 ELSE 0 END + CASE WHEN small_world > 2 AND nodes > 10 THEN 0.10 ELSE 0 END + CASE WHEN std > 1.5 * mean AND most > 3 * mean THEN 0.10 ELSE 0 END + CASE WHEN reciprocity < 0.15 AND edges > 5 THEN 0.10 ELSE 0 END + CASE WHEN core_ratio > 0.05 AND core_ratio < 0.3 THEN 0.10 ELSE 0 END + CASE WHEN in_out < -0.3 THEN 0.10 ELSE 0 END + CASE WHEN density < 0.01 THEN 0.05 WHEN density > 0.5 THEN 0.10 ELSE 0 END)::DOUBLE, 4) END AS topology FROM m")
def l07_topology(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").selectExpr("event_id AS k", "event_id % 50 AS nodes", "event_id % 80 AS edges", "(event_id % 10) / 10D AS clustering", "(event_id % 7) / 2D AS path_length", "CAST(event_id % 5 AS DOUBLE) AS small_world", "CAST(event_id % 9 AS DOUBLE) AS mean", "CAST(event_id % 20 AS DOUBLE) AS std", "CAST(event_id % 40 AS DOUBLE) AS most", "(event_id % 11) / 20D AS reciprocity", "(event_id % 13) / 30D AS core_ratio", "(event_id % 15) / 10D - 1 AS in_out", "(event_id % 100) / 120D AS density")
    return graph.topology_score(m).select("k", "topology")


_REACH = f"WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT a, b, score FROM p UNION ALL SELECT b, a, score FROM p), r AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"


@query(f"{_REACH} SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def l09_components(spark: SparkSession, d: str) -> DataFrame:
    return clustering.threshold_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", ALIKE, 2).select(F.col("vec_id").alias("node"), F.col("cluster").alias("component"))


@query(f"{_REACH}, c AS (SELECT a AS node, min(b) AS campaign FROM r GROUP BY a) SELECT campaign, count(*) AS size, arg_max('L' || e.label, (e.label * 7 % 10, -node)) AS label, round(avg(e.label * 7 % 10), 4) AS campaign_score FROM c JOIN embeddings e ON e.vec_id = node GROUP BY campaign HAVING count(*) >= 2")
def m06_campaigns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    links = vectors.similar_pairs(e, "vec_id", "embedding", ALIKE).withColumnRenamed("score", "strength")
    groups = e.select("vec_id", F.concat(F.lit("L"), "label").alias("label"), (F.col("label") * 7 % 10).alias("score"))
    return campaigns.campaigns(links, groups, "vec_id", above=0.3).select("campaign", "size", "label", r4("campaign_score"))


@query("WITH s AS (SELECT DISTINCT source, lang || (n_chars % 5) AS dom FROM documents), n AS (SELECT source, count(*) AS n FROM s GROUP BY source) SELECT a, b, round(c / (x.n + y.n - c), 4) AS strength FROM (SELECT p.source AS a, q.source AS b, count(*) AS c FROM s p JOIN s q ON p.dom = q.dom AND p.source < q.source GROUP BY ALL) JOIN n x ON x.source = a JOIN n y ON y.source = b WHERE x.n >= 2 AND y.n >= 2 AND c / (x.n + y.n - c) > 0.5 AND NOT a = 'src3' AND NOT b = 'src3'")
def m01_source_overlap(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    s = t.select("source", F.concat("lang", F.col("n_chars") % 5).alias("dom"))
    scores = t.select("source").distinct().withColumn("score", F.when(F.col("source") == "src3", 10.0).otherwise(50.0))
    return campaigns.source_overlap(s, "source", "dom", scores)


@query(with_parts("SELECT a, b, round(c / (na + nb - c), 4) AS strength FROM (SELECT x.cluster_id AS a, y.cluster_id AS b, count(*) AS c FROM (SELECT DISTINCT cluster_id, term FROM kw8) x JOIN (SELECT DISTINCT cluster_id, term FROM kw8) y ON x.term = y.term AND x.cluster_id < y.cluster_id GROUP BY ALL) JOIN (SELECT cluster_id AS a, count(*) AS na FROM kw8 GROUP BY 1) USING (a) JOIN (SELECT cluster_id AS b, count(*) AS nb FROM kw8 GROUP BY 1) USING (b) WHERE c / (na + nb - c) > 0.4", "kw8"))
def m02_theme_affinity(spark: SparkSession, d: str) -> DataFrame:
    p = clustered(spark, d)
    labels = p.select("cluster_id").distinct().withColumn("label", F.concat(F.lit("L"), "cluster_id"))
    return campaigns.theme_affinity(clustering.keywords(p, "cluster_id", "content"), "cluster_id", "term", labels)


@query(with_parts("SELECT a, b, round(0.5 * cos + 0.5 * ratio, 4) AS strength FROM (SELECT x.cluster_id AS a, y.cluster_id AS b, count(*) / any_value(n.n) AS ratio FROM (SELECT DISTINCT cluster_id, source FROM cl) x JOIN (SELECT DISTINCT cluster_id, source FROM cl) y ON x.source = y.source AND x.cluster_id <> y.cluster_id JOIN (SELECT cluster_id, count(DISTINCT source) AS n FROM cl GROUP BY cluster_id) n ON n.cluster_id = x.cluster_id GROUP BY ALL) JOIN (SELECT cluster_id AS a, min(published_at) AS ta FROM cl GROUP BY 1) USING (a) JOIN (SELECT cluster_id AS b, min(published_at) AS tb FROM cl GROUP BY 1) USING (b) JOIN (SELECT p.cluster_id AS a, q.cluster_id AS b, list_cosine_similarity(p.c, q.c) AS cos FROM cen p JOIN cen q ON p.cluster_id <> q.cluster_id) USING (a, b) WHERE tb - ta >= INTERVAL 30 MINUTES AND ratio >= 0.5 AND cos + 0.5 >= 0.5 AND 0.5 * (cos + 0.5) + 0.5 * ratio > 0.4", "cl", "cen").replace("0.5 * cos + 0.5 * ratio, 4", "0.5 * (cos + 0.5) + 0.5 * ratio, 4"))
def m03_chain(spark: SparkSession, d: str) -> DataFrame:
    """Random centroids are hardly alike, so their cosine is raised by a half here to let pairs through."""
    p = kept(clustered(spark, d), "clustered")
    return campaigns.amplification_chain(p.groupBy("cluster_id").agg(F.min("published_at").alias("first_seen")), p, "cluster_id", "source", vectors.centroids(p, "cluster_id", "vector"), raised=0.5)


@query(f"WITH p AS ({_PAIRS}) SELECT a, b, score FROM p WHERE NOT (a % 3 = 0)")
def m05_fingerprint_links(spark: SparkSession, d: str) -> DataFrame:
    m = vectors.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", ALIKE)
    return campaigns.fingerprint_links(m, m.where("a % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")), ALIKE)


# fingerprints and clusters -----------------------------------------------------------------------------------------------------------


@query()
def k01_style(spark: SparkSession, d: str) -> DataFrame:
    s = fingerprint.style(table(spark, d, "documents"), "source", "text", "doc_id")
    return s.select("source", F.posexplode("style").alias("i", "x")).select("source", "i", r4("x"))


@query()
def k02_cadence(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.cadence(table(spark, d, "events"), "user_id", "ts").select("user_id", F.posexplode("cadence").alias("i", "x")).select("user_id", "i", r4("x"))


@query()
def k03_network(spark: SparkSession, d: str) -> DataFrame:
    e = graph.amplification_edges(clustered(spark, d), "source", "published_at", 7200, by=("cluster_id",))
    return fingerprint.network(e, "cluster_id").select("cluster_id", F.posexplode("network").alias("i", "x")).select("cluster_id", "i", r4("x"))


@query()
def k04_entity_bias(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.entity_bias(entities(clustered(spark, d)), "cluster_id", "post_id", "entity").select("cluster_id", F.posexplode("entity").alias("i", "x")).select("cluster_id", "i", r4("x"))


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    p = kept(clustered(spark, d), "clustered")
    s, c = fingerprint.style(p, "cluster_id", "content", "post_id"), fingerprint.cadence(p, "cluster_id", "published_at")
    n, e = fingerprint.network(graph.amplification_edges(p, "source", "published_at", 7200, by=("cluster_id",)), "cluster_id"), fingerprint.entity_bias(entities(p), "cluster_id", "post_id", "entity")
    return kept(fingerprint.combined(p.select("cluster_id").distinct().join(s, "cluster_id", "left").join(c, "cluster_id", "left").join(n, "cluster_id", "left").join(e, "cluster_id", "left")), "fingerprints")


@query()
def k07_fingerprint_matches(spark: SparkSession, d: str) -> DataFrame:
    f = _fingerprints(spark, d)
    return vectors.similar_pairs(f, "cluster_id", "fingerprint", 0.5).select("a", "b", r4("score"))


@query()
def k06_pair_scores(spark: SparkSession, d: str) -> DataFrame:
    """The parts' weighted score of every pair whose fingerprints are alike at all."""
    f = _fingerprints(spark, d)
    parts = f.select("cluster_id", F.struct(*fingerprint.PARTS).alias("p"))
    a, b = parts.select(F.col("cluster_id").alias("a"), F.col("p").alias("pa")), parts.select(F.col("cluster_id").alias("b"), F.col("p").alias("pb"))
    pairs = vectors.similar_pairs(f, "cluster_id", "fingerprint", 0.01).select("a", "b")
    return pairs.join(a, "a").join(b, "b").select("a", "b", fingerprint.pair_score("pa", "pb").alias("m")).select("a", "b", "m.*")


@query(f"WITH p AS ({_PAIRS}), e AS (SELECT a AS n, score, (a + b) % 3 AS z FROM p UNION ALL SELECT b, score, (a + b) % 3 FROM p) SELECT v.vec_id, CASE WHEN v.vec_id % 10 = 9 THEN -1 ELSE count(e.n) FILTER (WHERE e.score >= 0.75) END AS dna_match_count, count(e.n) FILTER (WHERE e.score >= 0.9) AS strong_match_count, count(e.n) FILTER (WHERE e.z = 1) >= 2 AS cross_topic FROM embeddings v LEFT JOIN e ON e.n = v.vec_id GROUP BY v.vec_id")
def k10_match_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    m = vectors.similar_pairs(e, "vec_id", "embedding", ALIKE).withColumn("style", F.lit(0.9)).withColumn("cadence", F.lit(0.9)).withColumn("entity", F.when((F.col("a") + F.col("b")) % 3 == 1, 0.2).otherwise(0.8))
    return fingerprint.match_counts(m, e.select("vec_id", (F.col("vec_id") % 10 != 9).alias("fingerprinted")), "vec_id")


@query()
def j01_reduced_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of the vectors in five dimensions."""
    reduced = reduction.reduce(table(spark, d, "embeddings"), "vec_id", "embedding")
    return clustering.density_clusters(reduced, "vec_id", "reduced", metric="euclidean").select("vec_id", "resolution", "cluster")


@query()
def j02_density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.density_clusters(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(f"{_REACH}, c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a) SELECT node AS vec_id, component AS cluster FROM c WHERE component IN (SELECT component FROM c GROUP BY component HAVING count(*) >= 3)")
def j03_threshold_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.threshold_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", ALIKE, 3)


@query(with_parts("SELECT cluster_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '…' ELSE t END AS label FROM (SELECT cluster_id, t, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, t) AS r FROM (SELECT cluster_id, trim(split_part(title, ' | ', 1)) AS t FROM cl WHERE length(title) >= 15 AND NOT starts_with(title, 'http') AND length(trim(split_part(title, ' | ', 1))) >= 10) GROUP BY cluster_id, t) WHERE r = 1", "cl"))
def j10_labels(spark: SparkSession, d: str) -> DataFrame:
    p = clustered(spark, d)
    return clustering.labels(p, "cluster_id", "title", clustering.keywords(p, "cluster_id", "content"))


# retention and streams ---------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, ts < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAYS AS archived FROM events")
def s01_archive(spark: SparkSession, d: str) -> DataFrame:
    return retention.archived(table(spark, d, "events"), "ts", as_of()).select("event_id", "archived")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 DAYS + (event_id % 40) * INTERVAL 1 DAY)")
def s02_prune_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Stamps are shifted so that some posts are archived and others aren't."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp") - F.make_dt_interval(days=F.col("event_id") % 40))
    p = retention.archived(e, "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return retention.prune(table(spark, d, "embeddings"), p, "vec_id", "event_id").select("vec_id")


@query(f"WITH p AS ({_PAIRS}), g AS (SELECT event_id FROM events WHERE event_id % 2 = 0 AND ts < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 14 DAYS) SELECT a, b FROM p WHERE a NOT IN (SELECT event_id FROM g) AND b NOT IN (SELECT event_id FROM g)")
def s03_purge(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").withColumn("status", F.when(F.col("event_id") % 2 == 0, "archived").otherwise("active"))
    stay = retention.purge(g, {"vectors": (table(spark, d, "embeddings"), ["vec_id"])}, "event_id", "ts", as_of())["vectors"]  # links of purged groups are never made
    return vectors.similar_pairs(stay, "vec_id", "embedding", ALIKE).select("a", "b")


@query(f"WITH p AS ({_PAIRS}) SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM p) WHERE r <= 2")
def s04_cap_matches(spark: SparkSession, d: str) -> DataFrame:
    return retention.cap_matches(vectors.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", ALIKE, most=2), 2).select("a", "b")


@query("SELECT count(DISTINCT text) AS contents FROM documents")
def t01_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The streaming form of deduplication, run to the end of its input."""
    from tidewake.streaming import jobs

    src = table(spark, d, "documents").schema
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(src).parquet(_stream_dir(spark, d, "documents", root)).select("doc_id", F.col("text").alias("content"), F.timestamp_seconds(F.lit(1704067200)).alias("published_at"))
    q = jobs.each_batch_once(jobs.deduplicated(stream).select("doc_id", "content_hash"), f"{root}/out", f"{root}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").agg(F.count_distinct("content_hash").alias("contents"))


def _stream_dir(spark: SparkSession, d: str, name: str, root: str) -> str:
    """File streams read folders: the table is landed as one."""
    table(spark, d, name).write.parquet(f"{root}/in")
    return f"{root}/in"


@query("SELECT user_id, time_bucket(INTERVAL 15 MINUTES, ts) AS start, count(*) AS cnt FROM events WHERE time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 15 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 2 HOURS GROUP BY ALL")
def t02_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows in append mode: a window comes out once the watermark has passed it."""
    from tidewake.streaming import jobs

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    src = table(spark, d, "events").schema
    stream = spark.readStream.schema(src).parquet(_stream_dir(spark, d, "events", root)).select("user_id", F.col("ts").cast("timestamp").alias("published_at"))
    q = jobs.each_batch_once(jobs.window_counts(stream, "user_id"), f"{root}/out", f"{root}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "cnt")
