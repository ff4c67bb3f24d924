"""Readable results: interpretation ladders, verdicts, feeds, statistics and signed evidence packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import fixed_values as fixed
from tidewake.plans.storage import kept


def ladder(c: Column, steps: list[tuple[float, str]], last: str, below: bool = False) -> Column:
    """The name of the first bound that the value reaches (or, with ``below``, stays under)."""
    out = None
    for bound, name in steps:
        test = c < bound if below else c >= bound
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(last)


def interpretation(df: DataFrame) -> DataFrame:
    """Names for a row's score, burst, spread, mutation and coordination; insight, risks, actions, alternatives and a note on confidence.

    Insight, risks and so on are codes of a message each, in order.
    """
    score, burst, spread, mutation, coord = (F.col(c) for c in ("score", "burst", "spread", "mutation", "coordination"))
    some = lambda *pairs: F.filter(F.array(*(F.when(c, F.lit(name)) for c, name in pairs)), lambda x: x.isNotNull())
    insight = (
        F.when((score >= 80) & (mutation < 0.15), "near_identical_reporting").when(score >= 80, "broad_independent_attention").when((burst > 10) & (spread < 0.15), "narrow_surge").when(score >= 50, "above_normal").when(coord > 1.3, "regular_timing").otherwise("normal")
    )
    risks = some((score >= 80, "early_reports_unreliable"), (score >= 80, "first_impressions_dominate"), (mutation < 0.1, "same_claim_repeated"), (spread < 0.15, "weak_confirmation"), (burst > 15, "faster_than_verification"), (coord > 1.5, "synchronized_timing"))
    risks = F.when(F.size(risks) > 0, risks).when(score >= 50, F.array(F.lit("developing"))).otherwise(F.array(F.lit("none")))
    actions = some(
        (score >= 80, "wait_for_confirmation"), (score >= 80, "look_for_unrelated_sources"), (score >= 80, "share_with_care"), (mutation < 0.1, "check_for_copies"), ((spread < 0.15) & (score >= 50), "seek_other_ecosystems"), (burst > 20, "details_will_change"),
        (score < 50, "no_special_caution"),
    )
    alternatives = some(
        (mutation < 0.15, "wire_distribution"), (coord > 1.3, "editorial_scheduling"), ((burst > 10) & (spread > 0.3), "breaking_news"), (spread < 0.2, "niche_topic"), ((score >= 70) & (mutation > 0.25), "independent_coverage"), ((burst > 5) & (burst < 15), "news_cycle")
    )
    note = F.when(F.col("post_count") < 10, "low_few_sources").when((F.col("source_diversity") < 0.3) & (spread < 0.15), "moderate_one_source_type").when((F.col("post_count") >= 50) & (F.col("source_diversity") >= 0.5), "high").otherwise("moderate")
    return df.select(
        "*", ladder(score, [(90, "Extreme"), (80, "Very High"), (60, "High"), (40, "Moderate"), (20, "Low")], "Minimal").alias("velocity_name"), ladder(burst, [(30, "Explosive"), (15, "Very Fast"), (5, "Fast"), (2, "Above Normal"), (0, "Normal")], "Declining").alias("speed_name"),
        ladder(spread, [(0.7, "Highly Independent"), (0.4, "Moderately Independent"), (0.15, "Limited Independence")], "Single Ecosystem").alias("independence_name"),
        ladder(mutation, [(0.05, "Nearly Identical"), (0.1, "Very Similar"), (0.2, "Similar"), (0.4, "Moderately Varied")], "Highly Varied", below=True).alias("similarity_name"),
        ladder(coord, [(1.7, "Highly Synchronized"), (1.3, "Suspicious Timing"), (1.1, "Slightly Regular")], "Normal Timing").alias("timing_name"),
        F.when(score >= 80, "critical").when(score >= 50, "elevated").otherwise("normal").alias("alert_name"), insight.alias("insight"), risks.alias("risks"), actions.alias("actions"), F.when(F.size(alternatives) > 0, alternatives).otherwise(F.array(F.lit("normal_activity"))).alias("alternatives"), note.alias("confidence_note"),
    )


def falsification_block(df: DataFrame) -> DataFrame:
    """criteria (ids 1-4 that hold): from the fired rules, or from raw signals where no rules are known."""
    fired = F.col("rules_fired")
    by_rule = F.filter(F.transform(F.array(*(F.struct(F.lit(i).alias("id"), F.array_contains(fired, n).alias("on")) for i, n in ((1, "organic_viral_spread"), (2, "normal_news_cycle"), (3, "wire_service"), (4, "insufficient_evidence")))), lambda s: F.when(s["on"], s["id"])), lambda x: x.isNotNull())
    raw = F.filter(F.array(F.when((F.col("mutation") > 0.30) & (F.col("source_diversity") > 0.60), 1), F.when((F.col("coordination") < 1.10) & (F.col("burst") < 5), 2), F.when(F.coalesce(F.col("wire_known"), F.lit(False)), 3), F.when(F.col("post_count") < 10, 4)), lambda x: x.isNotNull())
    return df.withColumn("criteria", F.when(F.size(fired) > 0, by_rule).otherwise(raw)).withColumn("any_triggered", F.size("criteria") > 0)


def evidence_verdict(df: DataFrame) -> DataFrame:
    """verdict: a single-source bag beats all; else the first fired rule that has one; else by suppression and level."""
    names = F.create_map(*(F.lit(x) for kv in fixed.RULE_VERDICTS.items() for x in kv))
    first = F.try_element_at(F.filter(F.transform("rules_fired", lambda r: F.try_element_at(names, r)), lambda v: v.isNotNull()), F.lit(1))
    return df.withColumn("verdict", F.when(F.coalesce(F.col("single_source_bag"), F.lit(False)), "TOPIC_BAG").when(first.isNotNull(), first).when(F.col("suppressed"), "ALERT_SUPPRESSED").when(F.col("alert_level") == "normal", "NORMAL_COVERAGE").otherwise("NARRATIVE_ELEVATED"))


def public_verdict(df: DataFrame) -> DataFrame:
    """(public_verdict, verdict_confidence) of scored groups; a null score means that a group has no snapshot."""
    c, m, sd = F.col("confidence"), F.col("mutation"), F.col("source_diversity")
    thin = F.col("score").isNull() | (F.col("post_count") < 5)
    reduced = F.col("suppressed") | ((F.col("wire_known") | F.col("wire_hash")) & (m < 0.10) & (sd < 0.3)) | F.col("batch_artifact") | (F.coalesce(F.col("single_source_bag"), F.lit(False)) & F.col("ensemble_red_flag"))
    high = (F.col("score") > 60) & (c > 0.65) & ((F.col("strong_match_count") >= 1) | ((m < 0.15) & (sd > 0.5)))
    return df.withColumn("public_verdict", F.when(thin, "INSUFFICIENT_DATA").when(reduced, "NARRATIVE_SIGNAL_REDUCED").when(high, "HIGH").otherwise("UNCERTAIN")).withColumn(
        "verdict_confidence", F.round(F.when(F.col("score").isNull(), 0.0).when(thin, F.least(F.lit(0.3), c)).when(reduced, c * 0.5).otherwise(c), 4)
    )


def source_text(breakdown: DataFrame, key: str) -> DataFrame:
    """(key, context): what kind of outlets carry a group. ``breakdown``: key, category, n."""
    per = breakdown.groupBy(key).agg(
        F.sum("n").alias("all"), F.count("*").alias("kinds"), F.sum(F.when(F.col("category").isin("wire_service", "major_editorial"), F.col("n")).otherwise(0)).alias("ok"), F.sum(F.when(F.col("category") == "state_media", F.col("n")).otherwise(0)).alias("state"), F.sum(F.when(F.col("category") == "unknown", F.col("n")).otherwise(0)).alias("unknown")
    )
    pct = lambda c: F.round(F.col(c) / F.col("all") * 100).cast("int")
    say = lambda c, text: F.concat(pct(c).cast("string"), F.lit(text))
    return per.select(
        key, F.when(pct("ok") >= 60, say("ok", "% established outlets")).when(pct("state") >= 30, say("state", "% state-affiliated outlets")).when(pct("unknown") >= 50, say("unknown", "% unverified outlets")).otherwise(F.concat(F.col("all").cast("string"), F.lit(" outlets of "), F.col("kinds").cast("string"), F.lit(" kinds"))).alias("context")
    )


def precision(reviews: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 in one pass."""
    c = reviews.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"))


def distinct_labels(ranked: DataFrame, label: str, order: str, limit: int = 20, batch: int = 1000) -> DataFrame:
    """The first ``limit`` labels in order that repeat no earlier one: not the same, nor 65 % of the same long words.

    Of equal labels the first is found in parallel. Each further choice depends on those before, so the first ``batch`` labels are chosen from in order;
    then all labels that a chosen one rules out are dropped in parallel, and the next ``batch`` are looked at. A round chooses one label at least, so
    there are at most ``limit`` rounds, and nothing but ``batch`` rows and ``limit`` labels is ever in one place. Equal ranks go by label.
    """
    low = F.lower(F.trim(F.coalesce(F.col(label), F.lit(""))))
    first = ranked.withColumn("_low", low).withColumn("_rank", F.row_number().over(Window.partitionBy("_low").orderBy(order, label))).where("_rank = 1").drop("_rank", "_low")
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(label), F.lit(""))), r"\s+"), lambda w: F.length(w) > 3))
    left = kept(first.withColumn("_words", words), "labels")
    seen: list[frozenset] = []
    chosen: list[tuple] = []
    while len(chosen) < limit:
        rows = left.orderBy(order, label).limit(batch).collect()
        before = len(seen)
        for r in rows:
            own = frozenset(r["_words"])
            if len(own) > 4:
                if any(len(own & s) / len(own | s) >= 0.65 for s in seen):
                    continue
                seen.append(own)
            chosen.append(tuple(r)[:-1])
            if len(chosen) == limit:
                break
        if len(rows) < batch:
            break
        kinds = {f.name: f.dataType for f in ranked.schema}
        last = F.struct(*(F.lit(rows[-1][c]).cast(kinds[c]).alias(c) for c in (order, label)))
        left = left.where(F.struct(F.col(order), F.col(label)) > last)
        for s in seen[before:]:
            known = F.array(*map(F.lit, sorted(s)))
            left = left.where((F.size("_words") <= 4) | (F.size(F.array_intersect("_words", known)) / F.size(F.array_union("_words", known)) < 0.65))
        left = kept(left, "labels")
    return ranked.sparkSession.createDataFrame(chosen, ranked.schema)


def evidence_packs(df: DataFrame, key: str, version: str = "1") -> DataFrame:
    """(key, pack, sha256): each row as JSON with its pack id inside, and the digest of exactly those bytes."""
    pack = F.to_json(F.struct(F.concat_ws("-", F.lit("pack"), F.lit(version), F.col(key)).alias("pack_id"), *(F.col(c) for c in sorted(df.columns))))
    return df.select(key, pack.alias("pack")).withColumn("sha256", F.sha2("pack", 256))


def verified(packs: DataFrame) -> DataFrame:
    return packs.withColumn("valid", F.sha2("pack", 256) == F.col("sha256"))


def drift(baseline: DataFrame, scores: DataFrame, key: str, tolerance: float = 5.0) -> DataFrame:
    """(key, status): ok, missing, or drift of score, rules or both; ``baseline``: key, was_score, was_rules."""
    j = baseline.join(scores.select(key, "score", "rules_fired"), key, "left")
    moved = F.abs(F.col("score") - F.col("was_score")) > tolerance
    other = F.array_sort("was_rules") != F.array_sort("rules_fired")
    return j.select(key, F.when(F.col("score").isNull(), "missing").when(moved & other, "drift_both").when(moved, "drift_score").when(other, "drift_rules").otherwise("ok").alias("status"))


def fixture_check(fixtures: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """(key, rules_pass, score_pass, suppression_pass, overall); ``fixtures``: key, expected_rules, exact, score_max, expected_suppressed."""
    j = fixtures.join(scores.select(key, "score", "rules_fired", "suppressed"), key)
    missing = F.size(F.array_except("expected_rules", "rules_fired"))
    extra = F.size(F.array_except("rules_fired", "expected_rules"))
    r, s, u = (missing == 0) & (~F.col("exact") | (extra == 0)), F.col("score") <= F.col("score_max"), F.col("suppressed") == F.col("expected_suppressed")
    return j.select(key, r.alias("rules_pass"), s.alias("score_pass"), u.alias("suppression_pass"), (r & s & u).alias("overall"))
