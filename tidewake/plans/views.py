"""The tables that queries start from: posts and what is read off them, on the driver's tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import fixed_values as fixed
from tidewake.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    d, e = t("documents"), t("embeddings").withColumnRenamed("vec_id", "doc_id")
    p, v = t("pages").select(F.col("page_id").alias("doc_id"), "url"), t("events").withColumnRenamed("event_id", "doc_id")
    url = F.col("url")
    return d.join(e, "doc_id", "left").join(p, "doc_id", "left").join(v, "doc_id", "left").select(
        F.col("doc_id").alias("post_id"), F.col("label").alias("cluster_id"), "source", "url", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.when((F.col("label") % 5 == 4) & (F.col("doc_id") % 7 == 0), "translated").otherwise(F.col("lang")).alias("language"), F.col("ts").alias("published_at"),
        "value", "event_type", "user_id", F.col("embedding").alias("vector"), F.coalesce(F.nullif(tx.domain_at_least(url, 1), F.lit("")), F.col("source")).alias("domain"), tx.url_path(F.coalesce(url, F.lit(""))).alias("path"), F.col("value").alias("polarity"), (F.col("value") / 2).alias("tone"),
        F.array(F.when((F.col("label") % 4 == 1) & (F.col("event_type") == "click"), "PROPAGANDA").otherwise(F.upper(F.coalesce("event_type", F.lit(""))))).alias("themes"), "n_chars",
        F.when((F.col("label") % 2 == 0) | (F.col("doc_id") % 4 != 0), fixed.FEEDS[0]).otherwise(F.col("source")).alias("feed"),
        F.struct((F.col("value") * 8).alias("activity_density"), (F.col("value") * 3).alias("negative"), (F.col("value") / 40).alias("self_reference")).alias("tone_parts"),
    )


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).where("cluster_id is not null")


def title_words(p: DataFrame) -> DataFrame:
    return p.select("cluster_id", "post_id", F.explode(tx.title_tokens(F.col("title"))).alias("token"))


def entities(p: DataFrame) -> DataFrame:
    """Words of six letters and more of a title stand for the names in it."""
    return title_words(p).where(F.length("token") >= 6).withColumnRenamed("token", "entity")


def quoted(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_NETLOC = r"coalesce(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9_+.\-]*://([^/?#]*)', 1), '')"
_BARE = rf"regexp_replace(lower({_NETLOC}), '^www\.', '')"


def netloc_sql(url: str) -> str:
    return _NETLOC.format(u=url)


def bare_sql(url: str) -> str:
    return _BARE.format(u=url)


#: Named parts of oracle SQL, each built on earlier ones.
CTES: dict[str, str] = {
    "posts": rf"""SELECT d.doc_id AS post_id, e.label AS cluster_id, d.source, p.url, split_part(d.text, chr(10), 1) AS title, d.text AS content, CASE WHEN e.label % 5 = 4 AND d.doc_id % 7 = 0 THEN 'translated' ELSE d.lang END AS language, v.ts AS published_at, v.value, v.event_type, v.user_id, e.embedding AS vector,
  coalesce(nullif({bare_sql("p.url")}, ''), d.source) AS domain, rtrim(coalesce(regexp_extract(p.url, '^[a-zA-Z][a-zA-Z0-9_+.\-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path, v.value AS polarity, v.value / 2 AS tone, CASE WHEN e.label % 4 = 1 AND v.event_type = 'click' THEN 'PROPAGANDA' ELSE upper(coalesce(v.event_type, '')) END AS theme, d.n_chars, CASE WHEN e.label % 2 = 0 OR d.doc_id % 4 <> 0 THEN 'gdelt_gkg' ELSE d.source END AS feed
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN events v ON v.event_id = d.doc_id""",
    "cl": "SELECT * FROM posts WHERE cluster_id IS NOT NULL",
    "tok": rf"""SELECT DISTINCT cluster_id, post_id, token FROM (SELECT cluster_id, post_id, unnest(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_''\-]+')) AS token FROM cl) WHERE length(token) > 2 AND token NOT IN {quoted(fixed.TITLE_STOPWORDS)}""",
    "ent": "SELECT cluster_id, post_id, token AS entity FROM tok WHERE length(token) >= 6",
}


def with_parts(sql: str, *names: str) -> str:
    """SQL with the named parts, and all before them that they need, in front."""
    order = list(CTES)
    need: set[str] = set()

    def add(n: str) -> None:
        if n in need:
            return
        for m in order[: order.index(n)]:
            if f" {m} " in f" {CTES[n].replace('(', ' ').replace(')', ' ').replace(',', ' ').replace(chr(10), ' ').replace('.', ' ')} ":
                add(m)
        need.add(n)

    for n in names:
        add(n)
    if not need:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in order if n in need) + "\n" + sql
