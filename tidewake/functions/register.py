"""The package's expressions as SQL functions, and the rules as a table function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def entropy(values: pd.Series) -> float:
    """Shannon entropy in bits of a group's or a frame's values, nulls aside; null without values.

    An aggregate for GROUP BY and OVER. It gets a group's rows in one task, so for groups of any size take ``sets.entropy``, which counts before it
    shuffles.
    """
    c = values.value_counts().to_numpy(float)
    n = c.sum()
    return max(0.0, float(np.log2(n) - (c * np.log2(c)).sum() / n)) if n else None


def register_rules(spark: SparkSession) -> None:
    """The table function ``rule_trace``: one row for each rule (rule, kind, fired, cap, floor, level) of a group's features, given by name.

    Features left out have their defaults. With LATERAL it goes over a table: ``SELECT * FROM groups, LATERAL rule_trace(post_count => n)``. A rule
    that a terminal one silences isn't fired.
    """
    from tidewake.operators.rules import FEATURES, RULES

    kinds = {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE", type(None): "DOUBLE"}
    literal = lambda v: "NULL" if v is None else f"{v}D" if isinstance(v, float) else str(v)
    given = ", ".join(f"{n} {kinds[type(v)]} DEFAULT {literal(v)}" for n, v in FEATURES.items())
    ended = RULES[0].when
    rows = ", ".join(
        f"struct({k} AS place, '{r.name}' AS rule, '{r.kind}' AS kind, coalesce(({r.when}){f' AND NOT ({ended})' if r.kind in ('cap', 'boost') else ''}, false) AS fired, CAST({r.cap} AS DOUBLE) AS cap, CAST({r.floor} AS DOUBLE) AS floor, CAST({r.level} AS STRING) AS level)"
        for k, r in enumerate(RULES)
    )
    columns = "place INT, rule STRING, kind STRING, fired BOOLEAN, cap DOUBLE, floor DOUBLE, level STRING"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rule_trace({given}) RETURNS TABLE({columns}) RETURN SELECT r.place, r.rule, r.kind, r.fired, r.cap, r.floor, r.level FROM (SELECT explode(array({rows})) AS r)")


def register(spark: SparkSession) -> None:
    """SQL functions (not UDFs: their bodies are inlined) jaccard, cosine, domain_of, logistic, shannon_entropy (of counts); the aggregate entropy; the rules as a table."""
    register_rules(spark)
    spark.udf.register("entropy", entropy)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE RETURN try_divide(size(array_intersect(a, b)), size(array_union(a, b)))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))"
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION domain_of(url STRING) RETURNS STRING RETURN regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION logistic(x DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + exp(-x))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION shannon_entropy(counts ARRAY<BIGINT>) RETURNS DOUBLE RETURN log2(aggregate(counts, 0L, (s, x) -> s + x)) - aggregate(counts, 0D, (s, x) -> s + x * log2(x)) / aggregate(counts, 0L, (s, x) -> s + x)"
    )
