"""The falsification rules: eighteen ordered tests of a group's features, folded into caps, floors, suppression and a trace.

Every rule is a Boolean expression with a cap, a floor or a forced level; a row gets the array of those that fired. Nothing here is a UDF.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_MATCHES_KNOWN, COHERENCE_UNKNOWN = -1, 0.5

#: Feature columns and their defaults.
FEATURES = {
    "post_count": 0, "burst": 0.0, "spread": 0.0, "mutation": 0.5, "coordination": 1.0, "tone_uniformity": 0.0, "entity_concentration": 0.5, "shared_entity_count": 0,
    "unique_hash_ratio": 1.0, "embedding_similarity_mean": 0.0, "inter_arrival_mean": None, "inter_arrival_std": None, "feed_fraction": 0.0, "source_diversity": 0.0,
    "batch_artifact": False, "wire_known": False, "wire_hash": False, "dna_match_count": -1, "ensemble_disagreement": 0.0, "ensemble_red_flag": False,
    "narrative_coherence": 0.5, "unique_domain_count": 5, "dominant_lang_fraction": 1.0, "language_count": 1, "strong_match_count": 0, "cross_topic": False,
    "circadian_anomaly": False, "content_anomaly": False, "content_noise": False, "cross_language_anomaly": False, "geographic_spread": False, "high_signal_topic": False,
    "confidence": 0.5,
}


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str  # terminal, suppress, cap or boost
    when: str
    cap: str = "100D"
    floor: str = "0D"
    level: str = "NULL"


#: In order. The expressions are the same in Spark SQL and other dialects, but for the D of double literals.
RULES = [
    Rule("gdelt_batch_artifact", "terminal", "batch_artifact"),
    Rule("content_noise", "suppress", "content_noise"),
    Rule("insufficient_evidence", "cap", "post_count < 10", cap="CASE WHEN post_count >= 5 THEN 70D ELSE 40D END"),
    Rule("single_source_cluster", "cap", "unique_domain_count <= 1 OR source_diversity < 0.20D", cap="15D"),
    Rule("wire_service", "cap", "wire_known OR wire_hash", cap="CASE WHEN wire_known AND wire_hash THEN 20D ELSE 25D END"),
    Rule("dna_match", "cap", "(dna_match_count = -1 AND post_count >= 10) OR (dna_match_count = 0 AND post_count < 20)", cap="25D"),
    Rule("cross_language", "boost", "cross_language_anomaly AND source_diversity >= 0.3D", floor="65D", level="'elevated'"),
    Rule("geographic_spread", "boost", "geographic_spread", floor="60D", level="'elevated'"),
    Rule("high_signal_topic", "boost", "high_signal_topic", floor="55D", level="'elevated'"),
    Rule("circadian_anomaly", "boost", "circadian_anomaly AND source_diversity >= 0.3D", floor="CASE WHEN post_count >= 10 THEN 65D ELSE 50D END", level="'elevated'"),
    Rule("content_anomaly", "boost", "content_anomaly", floor="50D", level="'elevated'"),
    Rule(
        "cross_cluster_velocity", "boost",
        "NOT (wire_known OR wire_hash) AND NOT (shared_entity_count <= 1 AND narrative_coherence < 0.30D) AND (cross_topic OR (strong_match_count >= 5 AND source_diversity >= 0.5D))",
        floor="CASE WHEN cross_topic OR strong_match_count >= 20 THEN 80D ELSE 65D END", level="CASE WHEN cross_topic OR strong_match_count >= 20 THEN 'critical' ELSE 'elevated' END",
    ),
    Rule("ensemble_uncertainty", "cap", "ensemble_disagreement < 1.0D AND post_count < 15", cap="35D"),
    Rule("entity_concentration", "cap", "shared_entity_count <= 1 AND post_count >= 15", cap="35D"),
    Rule("narrative_coherence", "cap", "narrative_coherence <> 0.5D AND narrative_coherence < 0.22D", cap="20D"),
    Rule("organic_viral_spread", "cap", "mutation > 0.30D AND source_diversity > 0.60D", cap="30D"),
    Rule("normal_news_cycle", "cap", "coordination < 1.05D AND burst < 1.5D AND post_count < 15 AND NOT (source_diversity >= 0.7D OR dna_match_count >= 5)", cap="35D"),
    Rule("confidence_threshold", "suppress", "confidence < 0.65D"),
]


def with_defaults(features: DataFrame) -> DataFrame:
    """Every feature column, with its default where it is missing or null."""
    out = features
    for name, default in FEATURES.items():
        if name not in features.columns:
            out = out.withColumn(name, F.lit(default))
        elif default is not None:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return out


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once.

    Projections are merged and filters moved down by copying expressions; over the cascade's steps those copies would multiply. An
    explode of one struct is a border that neither crosses, inside generated code and without a shuffle.
    """
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_settled")
    return df.select(*(c for c in df.columns if c not in columns), one).select("*", "_settled.*").drop("_settled")


def rounded(c: Column, digits: int) -> Column:
    """``c`` to some places as SQL engines on doubles do it: halves of the scaled value go up. Spark's own rounds the shortest decimal text, so that
    70.945, which is a little less than that, would become 70.95."""
    return F.round(c * float(10**digits)) / float(10**digits)


def apply_rules(features: DataFrame) -> DataFrame:
    """Adds rules_fired (names in order), rule_trace (structs), cap, floor, zero, suppressed and forced_level.

    A terminal rule silences all later ones but those that suppress.
    """
    ended = F.expr(RULES[0].when)
    structs = []
    for r in RULES:
        fired = F.coalesce(F.expr(r.when), F.lit(False))
        if r.kind in ("cap", "boost"):
            fired = fired & ~ended
        structs.append(
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), fired.alias("fired"), F.expr(r.cap).cast("double").alias("cap"), F.expr(r.floor).cast("double").alias("floor"), F.expr(r.level).cast("string").alias("level"))
        )
    traced = settled(with_defaults(features), rule_trace=F.array(*structs))
    traced = settled(traced, _fired=F.filter("rule_trace", lambda g: g["fired"]))
    any_of = lambda kind: F.exists("_fired", lambda g: g["kind"] == kind)
    levels = F.transform("_fired", lambda g: g["level"])
    return settled(
        traced,
        rules_fired=F.transform("_fired", lambda g: g["rule"]),
        cap=F.coalesce(F.array_min(F.transform("_fired", lambda g: g["cap"])), F.lit(100.0)),
        floor=F.coalesce(F.array_max(F.transform("_fired", lambda g: g["floor"])), F.lit(0.0)),
        zero=any_of("terminal"),
        suppressed=any_of("suppress") | any_of("terminal"),
        forced_level=F.when(F.array_contains(levels, "critical"), "critical").when(F.array_contains(levels, "elevated"), "elevated"),
    ).drop("_fired")


def final_score(ruled: DataFrame, raw: str = "raw_score") -> DataFrame:
    """score and alert_level: the floor beats the cap, a terminal rule gives zero, suppression gives ``normal``."""
    score = F.when(F.col("zero"), 0.0).otherwise(rounded(F.greatest(F.least(F.col(raw), F.col("cap")), F.col("floor")), 2))
    level: Column = F.when(F.col("suppressed"), "normal").when(F.col("forced_level").isNotNull(), F.col("forced_level")).when(F.col("score") >= 80, "critical").when(F.col("score") >= 60, "elevated").otherwise("normal")
    return settled(settled(ruled, score=score), alert_level=level)


def refreshed_matches(snapshots: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Snapshots with the match counts of today: where the stamped count differs, the match rule is decided again.

    ``live``: key, live. Adds dna_evidence_strong (five matches or more); rules_fired and dna_match_count are replaced, all else stays.
    """
    j = snapshots.join(live, key, "left")
    changed = F.coalesce(F.col("live") != F.col("dna_match_count"), F.lit(False))
    fired = F.when(F.col("live") == -1, F.col("post_count") >= 10).otherwise((F.col("live") == 0) & (F.col("post_count") < 20))
    kept = F.filter(F.array(*(F.lit(r.name) for r in RULES)), lambda n: F.when(n == "dna_match", fired).otherwise(F.array_contains("rules_fired", n)))
    j = j.withColumn("rules_fired", F.when(changed, kept).otherwise(F.col("rules_fired"))).withColumn("dna_match_count", F.coalesce("live", "dna_match_count"))
    return j.withColumn("dna_evidence_strong", F.col("dna_match_count") >= 5).drop("live")
