"""A harness for the rules: what-if changes to every group's features through the real cascade, per-rule precision and recall, and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidewake.operators import rules

#: What each scenario changes, the rules that must then fire, whether the result must be suppressed (None: either), and the greatest cap.
SCENARIOS = [
    ("batch_feed", {"batch_artifact": True}, ["gdelt_batch_artifact"], True, 0.0),
    ("noise", {"batch_artifact": False, "content_noise": True}, ["content_noise"], True, 100.0),
    ("four_posts", {"batch_artifact": False, "post_count": 4}, ["insufficient_evidence"], None, 40.0),
    ("one_domain", {"batch_artifact": False, "unique_domain_count": 1}, ["single_source_cluster"], None, 15.0),
    ("two_kinds_of_wire", {"batch_artifact": False, "wire_known": True, "wire_hash": True}, ["wire_service"], None, 20.0),
    ("no_matches", {"batch_artifact": False, "dna_match_count": 0, "post_count": 12}, ["dna_match"], None, 25.0),
    ("at_night", {"batch_artifact": False, "circadian_anomaly": True, "source_diversity": 0.6, "post_count": 30}, ["circadian_anomaly"], None, 100.0),
    ("across_topics", {"batch_artifact": False, "wire_known": False, "wire_hash": False, "cross_topic": True, "narrative_coherence": 0.6}, ["cross_cluster_velocity"], None, 100.0),
    ("incoherent", {"batch_artifact": False, "narrative_coherence": 0.1}, ["narrative_coherence"], None, 20.0),
    ("unsure", {"batch_artifact": False, "content_noise": False, "confidence": 0.4}, ["confidence_threshold"], True, 100.0),
]


def scenario_table(features: DataFrame, key: str, scenarios: list[tuple] = SCENARIOS) -> DataFrame:
    """key, name, expected_rules, expected_suppressed, most_cap and every feature, changed: each row of ``features`` under each scenario."""
    rows = rules.with_defaults(features)
    kinds = {f.name: f.dataType for f in rows.schema}
    value = lambda name, changed: (F.lit(changed[name]) if name in changed else F.col(name)).cast(kinds[name]).alias(name)
    one = [
        F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, fired)).alias("expected_rules"), F.lit(stopped).cast("boolean").alias("expected_suppressed"), F.lit(cap).alias("most_cap"), *(value(f, changed) for f in rules.FEATURES))
        for name, changed, fired, stopped, cap in scenarios
    ]
    return rows.select(key, F.explode(F.array(*one)).alias("s")).select(key, "s.*")


def evaluate(scenarios: DataFrame, key: str) -> DataFrame:
    """key, name, expected_rules, actual_rules, expected_suppressed, actual_suppressed, most_cap, actual_cap and passed of each scenario.

    One passes if all expected rules fire, suppression is as expected and the cap no higher.
    """
    r = rules.apply_rules(scenarios)
    stopped, cap = F.col("suppressed") | F.col("zero"), F.when(F.col("zero"), 0.0).otherwise(F.col("cap"))
    passed = (F.size(F.array_except("expected_rules", "rules_fired")) == 0) & F.coalesce(stopped == F.col("expected_suppressed"), F.lit(True)) & (cap <= F.col("most_cap") + 0.01)
    return r.select(key, "name", F.array_sort("expected_rules").alias("expected_rules"), F.array_sort("rules_fired").alias("actual_rules"), "expected_suppressed", stopped.alias("actual_suppressed"), "most_cap", cap.alias("actual_cap"), passed.alias("passed"))


def by_rule(results: DataFrame) -> DataFrame:
    """rule, tp, fp, fn, precision, recall, f1 of every rule over all scenarios; 1 where nothing counts against it.

    A rule that fires because of what a group is like, not because of the change, is a false positive here.
    """
    each = results.select("expected_rules", "actual_rules", F.explode(F.array(*(F.lit(r.name) for r in rules.RULES))).alias("rule"))
    said, was = F.array_contains("actual_rules", F.col("rule")), F.array_contains("expected_rules", F.col("rule"))
    c = each.groupBy("rule").agg(F.count_if(said & was).alias("tp"), F.count_if(said & ~was).alias("fp"), F.count_if(~said & was).alias("fn"))
    p, r = (F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(x)), F.lit(1.0)) for x in ("fp", "fn"))
    return c.select("rule", "tp", "fp", "fn", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 3).alias("f1"))


def report(results: list[Row], rules_: list[Row]) -> str:
    """Markdown of both tables."""
    good = sum(r.passed for r in results)
    out = [f"# Scenarios: {good} of {len(results)} as expected", "", "| scenario | expected | actual | suppressed | cap | |", "|-|-|-|-|-|-|"]
    for r in results:
        said = lambda names: ", ".join(names) or "none"
        out.append(f"| {r.name} | {said(r.expected_rules)} | {said(r.actual_rules)} | {r.expected_suppressed}, {r.actual_suppressed} | {r.most_cap:g}, {r.actual_cap:g} | {'pass' if r.passed else 'FAIL'} |")
    out += ["", "| rule | tp | fp | fn | precision | recall | f1 |", "|-|-|-|-|-|-|-|"]
    return "\n".join([*out, *(f"| {r.rule} | {r.tp} | {r.fp} | {r.fn} | {r.precision} | {r.recall} | {r.f1} |" for r in sorted(rules_, key=lambda r: r.rule))])
