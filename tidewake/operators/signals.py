"""Features of groups of posts: spread, tone, wire signals, flags, the velocity ensemble, confidence; and the whole scoring job.

Each function takes all posts and gives one row for each group, so a job is a handful of aggregations over the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import fixed_values as fixed
from tidewake.functions import text as tx
from tidewake.operators import rules, sets, temporal, vectors

#: Weights of the three members: burst, spread, mutation, tone, then the member's own weight.
ENSEMBLE = {"burst": (0.35, 0.20, 0.28, 0.20, 0.33), "spread": (0.20, 0.35, 0.28, 0.20, 0.33), "mutation": (0.25, 0.25, 0.30, 0.20, 0.34)}


def spread(posts: DataFrame, key: str, domain: str, language: str) -> DataFrame:
    d, l = sets.entropy(posts, key, domain), sets.entropy(posts, key, language)  # noqa: E741
    both = d.select(key, F.col("h").alias("domain_entropy"), F.col("k").alias("unique_domain_count"), F.col("n").alias("post_count")).join(l.select(key, F.col("h").alias("language_entropy"), F.col("k").alias("language_count")), key, "left")
    s = F.col("domain_entropy") / 4 * 0.7 + F.coalesce("language_entropy", F.lit(0.0)) / 4 * 0.3
    return both.withColumn("spread", F.least(F.lit(1.0), F.when(F.coalesce("language_entropy", F.lit(0.0)) < 0.5, s * 0.5).otherwise(s)))


def tone_uniformity(posts: DataFrame, key: str, polarity: str, tone: str) -> DataFrame:
    per = posts.groupBy(key).agg(F.count(polarity).alias("_count"), F.var_pop(polarity).alias("p"), F.var_pop(tone).alias("t"))
    v = 0.6 * F.col("p") + 0.4 * F.coalesce("t", "p")
    return per.select(key, F.when(F.col("_count") < 5, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), v / 2))).alias("tone_uniformity"))


def hash_ratio(posts: DataFrame, key: str, content: str) -> DataFrame:
    h = F.when(F.coalesce(F.col(content), F.lit("")) != "", F.sha2(content, 256))
    return posts.groupBy(key).agg(F.coalesce(F.try_divide(F.count_distinct(h), F.count(h)), F.lit(0.0)).alias("unique_hash_ratio"))


def shared_path(posts: DataFrame, key: str, domain: str, path: str) -> DataFrame:
    """(key, path, domains, coverage) of the group's most common URL path over three characters."""
    n = posts.groupBy(key).agg(F.count("*").alias("n"))
    counts = posts.where((F.length(path) > 3) & (F.length(domain) > 3)).groupBy(key, path).agg(F.count("*").alias("c"), F.count_distinct(domain).alias("domains"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("c"), path))).where("r = 1")
    return n.join(best, key, "left").select(key, path, F.coalesce("domains", F.lit(0)).alias("path_domains"), (F.coalesce("c", F.lit(0)) / F.col("n")).alias("path_coverage"))


def wire_share(posts: DataFrame, key: str, domain: str) -> DataFrame:
    """Share of known wire domains among a group's distinct domains."""
    wires = [*fixed.WIRE_SERVICES, *fixed.SYNDICATORS]
    one = posts.where(F.coalesce(F.col(domain), F.lit("")) != "").select(key, domain).distinct()
    return one.groupBy(key).agg(F.avg(F.col(domain).isin(wires).cast("double")).alias("wire_share"), F.count("*").alias("wire_domains"))


def wire_known(n: Column, path_domains: Column, path_coverage: Column, mutation: Column, share: Column, domains: Column) -> Column:
    return F.coalesce((n >= 5) & (((path_domains >= 3) & (path_coverage >= 0.60) & (mutation < 0.40)) | ((mutation < 0.25) & (domains >= 3) & (share >= 0.80))), F.lit(False))


def wire_hash(n: Column, similarity: Column, hash_ratio_: Column, diversity: Column) -> Column:
    return F.coalesce((n >= 7) & (similarity > 0.55) & (((hash_ratio_ > 0.90) & (diversity > 0.65)) | ((hash_ratio_ > 0.85) & (diversity > 0.40))), F.lit(False))


def flags(posts: DataFrame, key: str, ts: str, title: str, language: str, themes: str, tone: Column, diversity: DataFrame) -> DataFrame:
    """circadian_anomaly, content_anomaly, content_noise, cross_language_anomaly, high_signal_topic; ``tone`` is a struct as ``parse_tone`` gives."""
    off = F.hour(F.col(ts).cast("timestamp")).between(1, 5)
    outlier = (tone["activity_density"] > 35) & (tone["negative"] > 12) & (tone["self_reference"] < 0.3)
    per = posts.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(off).alias("off"), F.count_if(outlier).alias("outliers"), F.count_if(tx.is_noise_title(F.col(title))).alias("noise"),
        F.count_distinct(F.when(~F.coalesce(language, F.lit("")).isin("translated", "unknown", ""), F.col(language))).alias("langs"),
        F.count_if(F.coalesce(F.arrays_overlap(themes, tx.lit_array(fixed.MANIPULATION_THEMES)), F.lit(False))).alias("manipulation"),
    ).join(diversity, key, "left")
    n, some = F.col("n"), F.col("n") >= 5
    least = lambda k, share: F.greatest(F.lit(float(k)), n * share)
    return per.select(
        key, (some & (F.col("off") >= least(3, 0.4))).alias("circadian_anomaly"), (some & (F.col("outliers") >= least(2, 0.3))).alias("content_anomaly"), (F.col("noise") >= F.greatest(F.lit(1), F.floor(n * 0.5))).alias("content_noise"),
        ((F.col("langs") >= 3) & (F.col("source_diversity") > 0.3)).alias("cross_language_anomaly"), (some & (F.col("manipulation") >= least(3, 0.3)) & (F.col("source_diversity") > 0.3)).alias("high_signal_topic"),
    )


def raw_velocity(f: DataFrame) -> DataFrame:
    """raw_score, ensemble_disagreement, ensemble_red_flag from burst, spread, mutation, tone_uniformity and coordination."""
    scores = []
    for a, b, c, d, _ in ENSEMBLE.values():
        x = a * F.col("burst") + b * F.col("spread") - c * F.col("mutation") + d * F.col("tone_uniformity")
        scores.append(rules.rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 / (1 + F.exp(-x)) * F.col("coordination"))), 2))
    weights = [w[4] for w in ENSEMBLE.values()]
    out = rules.settled(f, _s=F.array(*scores))
    total = sum((F.col("_s")[k] * w for k, w in enumerate(weights)), F.lit(0.0)) / sum(weights)
    out = rules.settled(out, raw_score=rules.rounded(total, 2), ensemble_disagreement=F.array_max("_s") - F.array_min("_s"))
    return out.withColumn("ensemble_red_flag", (F.col("ensemble_disagreement") < 1) & (F.col("post_count") < 15)).drop("_s")


def _ladder(c: Column, *steps: tuple[float, float], above: bool = True) -> Column:
    out = F.lit(0.0)
    for bound, value in reversed(steps):
        out = F.when(c > bound if above else c < bound, value).otherwise(out)
    return out


def confidence(f: DataFrame, bits: str = "domain_entropy", digits: int = 3) -> DataFrame:
    """confidence, confidence_lower, confidence_upper and adequacy; ``bits`` is source entropy in bits."""
    n, sd, m = F.col("post_count"), F.col(bits), F.col("dna_match_count")
    p = (
        0.55 + _ladder(F.col("burst"), (10, 0.12), (5, 0.07)) + _ladder(F.col("mutation"), (0.1, 0.12), (0.2, 0.07), above=False) + _ladder(F.col("coordination"), (1.5, 0.12), (1.2, 0.07))
        + _ladder(F.col("spread"), (0.15, 0.12), (0.3, 0.07), above=False) + F.when(F.col("raw_score") >= 80, 0.08).when(F.col("raw_score") >= 60, 0.05).otherwise(0.0)
    )
    p = F.when((n < 10) & (sd < 0.3) & (F.col("mutation") < 0.1), p * 0.90).otherwise(p)
    q = F.least(
        F.lit(1.0), F.when(n < 10, 0.88).when(n < 25, 0.93).otherwise(1.0), F.when(sd < 0.3, 0.90).otherwise(1.0), F.when((F.col("spread") > 0.5) & (F.col("mutation") > 0.3), 0.88).otherwise(1.0),
        F.when(F.col("batch_artifact"), 0.82).otherwise(1.0), F.when((m == 0) & (n < 20), 0.75).when((m == 0) & (n < 50), 0.85).otherwise(1.0),
    )
    p = p + F.when(m >= 10, 0.10).when(m >= 5, 0.07).when(m >= 1, 0.04).otherwise(0.0)
    clamp = lambda c: F.greatest(F.lit(0.05), F.least(F.lit(0.95), c))
    f = rules.settled(f, _q=clamp(p * q))
    p = F.col("_q")
    p = F.when(sd < 0.20, p * 0.5).otherwise(p)
    p = F.when(F.col("unique_domain_count") <= 1, F.least(p, F.lit(0.40))).otherwise(p)
    p = clamp(F.when((F.col("language_count") > 1) & ~F.col("translated"), p * 1.1).otherwise(p))
    out = rules.settled(f, _p=p, _m=1 / F.sqrt(F.greatest(F.lit(3), n)))
    raised = F.when((m >= 5) & (F.col("_p") < 0.65), F.least(F.lit(0.70), F.col("_p") + 0.10)).otherwise(F.col("_p"))
    return (
        out.withColumn("confidence", rules.rounded(raised, digits))
        .withColumn("confidence_lower", rules.rounded(F.greatest(F.lit(0.05), F.least(F.col("_p"), F.col("_p") * (1 - F.col("_m")))), digits))
        .withColumn("confidence_upper", rules.rounded(F.least(F.lit(0.99), F.greatest(F.col("_p"), F.col("_p") * (1 + F.col("_m") / 2))), digits))
        .withColumn("adequacy", F.when((n >= 50) & (sd >= 0.4), "sufficient").when(n >= 15, "moderate").when(n >= 5, "marginal").otherwise("insufficient"))
        .drop("_p", "_m", "_q")
    )


def coherence(posts: DataFrame, tokens: DataFrame, entities: DataFrame, key: str, member: str, token: str, entity: str) -> DataFrame:
    """0.7 of continuity and 0.3 of the titles' mean similarity; 0.5 under three posts or 30 % of posts with entities."""
    n = posts.groupBy(key).agg(F.count_distinct(member).alias("n"))
    covered = entities.groupBy(key).agg(F.count_distinct(member).alias("_covered"))
    c = sets.continuity(posts, entities, key, member, entity, list(fixed.GENERIC_ENTITIES))
    j = sets.mean_jaccard(tokens, key, member, token)
    joined = n.join(covered, key, "left").join(c, key, "left").join(j.select(key, "jaccard"), key, "left")
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.70 * F.col("continuity") + 0.30 * F.coalesce("jaccard", F.lit(0.0))))
    enough = (F.col("n") >= 3) & (F.coalesce("_covered", F.lit(0)) >= 0.30 * F.col("n"))
    return joined.select(key, F.when(enough, value).otherwise(0.5).alias("narrative_coherence"), F.coalesce("jaccard", F.lit(0.0)).alias("title_jaccard"))


def sources(posts: DataFrame, key: str, feed: str, source: str) -> DataFrame:
    """(key, post_count, feed_fraction, source_share): posts, the share of batch feeds, and of the commonest source."""
    counts = posts.groupBy(key, feed, source).agg(F.count("*").alias("c"))
    by_source = counts.groupBy(key, source).agg(F.sum("c").alias("c"), F.sum(F.when(F.col(feed).isin(*fixed.FEEDS), F.col("c")).otherwise(0)).alias("fed"))
    per = by_source.groupBy(key).agg(F.sum("c").alias("post_count"), F.sum("fed").alias("fed"), F.max("c").alias("most"))
    return per.select(key, "post_count", (F.col("fed") / F.col("post_count")).alias("feed_fraction"), (F.col("most") / F.col("post_count")).alias("source_share"))


def languages(posts: DataFrame, key: str, language: str) -> DataFrame:
    """(key, language_count, translated): kinds of language, unknown and translated ones too, and whether any post is a translation."""
    l = F.coalesce(F.col(language), F.lit("unknown"))  # noqa: E741
    return posts.groupBy(key).agg(F.count_distinct(l).alias("language_count"), F.max(l == "translated").alias("translated"))


def score_groups(posts: DataFrame, tokens: DataFrame, entities: DataFrame, matches: DataFrame | None = None, key: str = "cluster_id") -> DataFrame:
    """All features, the rules and the final score of every group, in one job.

    ``posts``: key, post_id, source, feed, domain, path, language, title, content, published_at, vector, polarity, tone, tone_parts (as
    ``parse_tone`` gives), themes; each of the parts below reads them, so hand in a stored table. ``tokens`` and ``entities``: (key, post_id,
    token) and (key, post_id, entity). ``matches``: key, dna_match_count, strong_match_count, cross_topic. A batch artifact
    takes the coordination multiplier back; a bag of unrelated titles from many sources has no coherence; groups under three posts
    are insufficient: their score is zero.
    """
    s = spread(posts, key, "domain", "language").drop("post_count", "language_count").withColumn("source_diversity", F.least(F.lit(1.0), F.col("domain_entropy") / 4))
    g, from_ = temporal.gaps(posts, key, "published_at"), sources(posts, key, "feed", "source")
    parts = [
        from_, languages(posts, key, "language"), temporal.burst(posts, key, "published_at").select(key, "burst"), vectors.mutation(posts, key, "vector").withColumnRenamed("similarity", "embedding_similarity_mean"), tone_uniformity(posts, key, "polarity", "tone"),
        temporal.coordination(g).select(key, F.col("n").alias("stamped"), F.col("gap_mean").alias("inter_arrival_mean"), F.col("gap_std").alias("inter_arrival_std"), "coordination"),
        hash_ratio(posts, key, "content"), shared_path(posts, key, "domain", "path"), wire_share(posts, key, "domain"),
        sets.concentration(posts, entities, key, "post_id", "entity").select(key, F.col("concentration").alias("entity_concentration"), F.col("shared").alias("shared_entity_count")),
        coherence(posts, tokens, entities, key, "post_id", "token", "entity"),
        flags(posts, key, "published_at", "title", "language", "themes", F.col("tone_parts"), s.select(key, "source_diversity")),
    ]
    out = from_.select(key).join(s, key, "left")  # a group without any domain has no entropy, but a score
    for p in [*parts, *([matches] if matches is not None else [])]:
        out = out.join(p, key, "left")
    cadence = temporal.batch_artifact(F.col("stamped"), F.col("inter_arrival_mean"), F.col("inter_arrival_std"), F.col("feed_fraction"))
    out = out.withColumn("batch_artifact", cadence).withColumn("coordination", F.when(F.col("batch_artifact"), 1.0).otherwise(F.col("coordination")))
    bag = (F.col("post_count") >= 15) & (F.col("source_share") <= 0.15) & (F.col("title_jaccard") < 0.12)
    out = out.withColumn("narrative_coherence", F.when(bag, 0.0).otherwise(F.col("narrative_coherence"))).withColumn("unique_domain_count", F.coalesce("unique_domain_count", F.lit(0)))
    out = out.withColumn("wire_known", wire_known(F.col("post_count"), F.col("path_domains"), F.col("path_coverage"), F.col("mutation"), F.col("wire_share"), F.col("wire_domains")))
    out = out.withColumn("wire_hash", wire_hash(F.col("post_count"), F.col("embedding_similarity_mean"), F.col("unique_hash_ratio"), F.col("source_diversity")))
    scored = confidence(raw_velocity(rules.with_defaults(out).withColumn("domain_entropy", F.coalesce("domain_entropy", F.lit(0.0)))))
    final = rules.final_score(rules.apply_rules(scored)).withColumn("insufficient_data", F.col("post_count") < 3)
    short = lambda c, value: F.when(F.col("insufficient_data"), value).otherwise(F.col(c)).alias(c)
    return final.select(*(short(c, {"score": 0.0, "alert_level": "normal"}[c]) if c in ("score", "alert_level") else F.col(c) for c in final.columns))
