"""Queries over time, sets, vectors, joins and tables."""
# ruff: noqa: E501

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions import fixed_values as fixed
from tidewake.functions import text as tx
from tidewake.operators import clustering, follows, relational, rules, sets, temporal, vectors
from tidewake.plans.registry import query
from tidewake.plans.views import CTES, bare_sql, clustered, entities, netloc_sql, posts, quoted, table, title_words, with_parts
from tidewake.sources import landing

r4 = lambda c, name=None: rules.rounded(F.col(c) if isinstance(c, str) else c, 4).alias(name or c)


# sources ------------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def a10_content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return relational.dedup_content(table(spark, d, "documents"), "text", F.col("doc_id")).select("doc_id", "content_hash")


_LINE = "concat_ws('\t', cast(doc_id AS STRING), '20240102030405', '', source, concat('https://www.', source, '.org/a/', doc_id), '', '', concat('ELECTION;', lang, ';X_', doc_id % 3), '', 'Here', '', 'Ann Lee;Bo', '', 'Org One', '', concat_ws(',', doc_id % 7, '1.5', '2.5', doc_id % 11, '20', '0.5'), '', 'g', '', 'img', concat('<PAGE_TITLE>', source, ' news</PAGE_TITLE>'))"


@query("SELECT doc_id::VARCHAR AS record_id, TIMESTAMP '2024-01-02 03:04:05' AS published_at, source, 'https://www.' || source || '.org/a/' || doc_id AS url, 3::INT AS themes, (doc_id % 7)::DOUBLE AS tone, (doc_id % 11)::DOUBLE AS polarity, source || ' news' AS page_title FROM documents")
def a03_knowledge_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.expr(_LINE).alias("value"))
    r = landing.knowledge_rows(lines)
    return r.select("record_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "source", "url", F.size("themes").alias("themes"), F.col("tone.tone").alias("tone"), F.col("tone.polarity").alias("polarity"), "page_title")


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE doc_id % 4 = 0) AS dropped FROM documents")
def a05_short_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, "a\tb").otherwise(F.expr(_LINE)).alias("value"))
    return landing.short_rows(lines)


@query("SELECT 'gdelt_doc' AS source, 'T' || doc_id AS title, 'https://x.org/' || doc_id AS url, CASE lang WHEN 'en' THEN 'en' ELSE lang END AS language, TIMESTAMP '2024-05-06 07:08:09' AS published_at FROM documents")
def a01_article_lists(spark: SparkSession, d: str) -> DataFrame:
    name = F.create_map(F.lit("en"), F.lit("English"), F.lit("fr"), F.lit("French"), F.lit("de"), F.lit("German"), F.lit("es"), F.lit("Spanish"))
    one = table(spark, d, "documents").select(F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("T"), "doc_id").alias("title"), F.concat(F.lit("https://x.org/"), "doc_id").alias("url"), F.try_element_at(name, F.col("lang")).alias("language"), F.lit("20240506T070809Z").alias("seendate"))).alias("articles"))).alias("value"))
    return landing.articles(one).select("source", "title", "url", "language", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("SELECT 'https://bsky.app/profile/did' || conv_id || '/post/' || turn AS url, text AS content, 'did' || conv_id AS author, 'en' AS language, TIMESTAMP '2024-05-06 07:08:09.123' AS published_at FROM conversations WHERE role = 'user' AND length(text) >= 10")
def a07_post_events(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    record = F.struct(F.col("text"), F.lit("2024-05-06T07:08:09.123Z").alias("createdAt"))
    event = F.to_json(F.struct(F.lit("commit").alias("kind"), F.concat(F.lit("did"), "conv_id").alias("did"), F.struct(F.when(F.col("role") == "user", "create").otherwise("delete").alias("operation"), F.lit("app.bsky.feed.post").alias("collection"), F.col("turn").cast("string").alias("rkey"), record.alias("record")).alias("commit")))
    return landing.post_events(c.select(event.alias("value"))).select("url", "content", "author", "language", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


_REL = "length(text) >= 30 AND (" + " OR ".join(f"contains(lower(text), '{w}')" for w in fixed.SIGNAL_PHRASES) + " OR (" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in fixed.SIGNAL_WORDS) + ") >= 2)"


@query(f"SELECT doc_id, {_REL} AS relevant FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' Propaganda leaked ' WHEN doc_id % 7 = 0 THEN text || ' FALSE FLAG' ELSE text END AS text FROM documents)")
def a08_relevance(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" Propaganda leaked "))).when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" FALSE FLAG"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", tx.relevance(t).alias("relevant"))


@query("SELECT event_id, (event_type = 'purchase' AND event_id % 2 = 0) OR (value > 5 AND value * 2 > 3 AND value IS NOT NULL) AS high FROM events")
def a11_prefilter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    themes = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0), F.array(F.lit("ELECTION"))).otherwise(F.array(F.lit("WEATHER")))
    return e.select("event_id", tx.high_signal(themes, F.col("value"), F.col("value") * 2).alias("high"))


@query("SELECT feed, count(*) AS n, count(url) AS urls FROM (SELECT 'docs' AS feed, doc_id AS id, NULL AS url FROM documents UNION ALL SELECT 'pages', page_id, url FROM pages) GROUP BY feed")
def a12_union_feeds(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select(F.lit("docs").alias("feed"), F.col("doc_id").alias("id"))
    b = table(spark, d, "pages").select(F.lit("pages").alias("feed"), F.col("page_id").alias("id"), "url")
    return relational.union_feeds(a, b).groupBy("feed").agg(F.count("*").alias("n"), F.count("url").alias("urls"))


@query()
def a14_embed_missing(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d).select("post_id", "title", "content")
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("post_id"))
    return landing.embed_missing(p, have, "post_id").select("post_id", F.size("vector").alias("width"), F.round(vectors.norm(F.col("vector")), 3).alias("norm"))


@query(with_parts("SELECT post_id FROM posts WHERE vector IS NOT NULL AND published_at > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 480 HOURS", "posts"))
def a15_recent_vectors(spark: SparkSession, d: str) -> DataFrame:
    p = posts(spark, d)
    return landing.recent_vectors(p.select("post_id", "published_at"), p.where("vector is not null").select("post_id", "vector"), "post_id", F.lit("2024-01-20 00:00:00").cast("timestamp"), 480).select("post_id")


# rows ---------------------------------------------------------------------------------------------------------------------------


@query(rf"SELECT page_id, {bare_sql('url')} AS domain, rtrim(coalesce(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9_+.\-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages")
def b01_domain_path_title(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", tx.domain_at_least(F.col("url"), 0).alias("domain"), tx.url_path(F.col("url")).alias("path"), tx.page_title(F.col("html"), "title").alias("title"))


_FEED = "CASE WHEN page_id % 3 = 0 THEN 'gdelt_gkg' WHEN page_id % 3 = 1 THEN 'gdelt_doc' ELSE 'Other' END"


@query(
    f"SELECT page_id, CASE WHEN s <> 'Other' AND length(b) > 3 THEN b ELSE s END AS v1, CASE WHEN s <> 'Other' THEN coalesce(nullif(b, ''), 'unknown') ELSE s END AS v2, CASE WHEN length(b) >= 3 THEN b END AS v3, lower(regexp_replace(coalesce(nullif({netloc_sql('u')}, ''), split_part(coalesce(u, ''), '/', 1)), '^www\\.', '')) AS v4, CASE WHEN length(b) > 3 THEN b ELSE lower(s) END AS v5 FROM (SELECT page_id, {_FEED} AS s, u, {bare_sql('u')} AS b FROM (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'plain/x' ELSE url END AS u FROM pages))"
)
def b02_domain_variants(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 10 == 0, "plain/x").otherwise(F.col("url")).alias("u"), F.expr(_FEED).alias("s"))
    u, s = F.col("u"), F.col("s")
    return p.select("page_id", tx.domain_of_feed(u, s).alias("v1"), tx.domain_or_unknown(u, s).alias("v2"), tx.domain_at_least(u, 3).alias("v3"), tx.domain_for_credibility(u).alias("v4"), tx.domain_or_source(u, s).alias("v5"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE hour(ts) BETWEEN 1 AND 5) AS off_hours, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def b07_json_props_offhours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint", {"mode": "PERMISSIVE"}))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.hour(F.col("ts").cast("timestamp")).between(1, 5)).alias("off_hours"), F.sum("p.k").alias("k"))


@query("SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(string_split(source || ';Ann Lee; B#x ;ab;' || upper(lang) || 'XYZ', ';'), lambda x: lower(trim(x))), lambda x: length(x) > 2 AND NOT contains(x, '#')))) AS names, list_sort(list_distinct(list_filter(list_transform(string_split(source || ';;Tax', ';'), lambda x: lower(trim(x))), lambda x: x <> ''))) AS themes FROM documents")
def b08_metadata_sets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", F.array_sort(tx.name_list(F.concat("source", F.lit(";Ann Lee; B#x ;ab;"), F.upper("lang"), F.lit("XYZ")))).alias("names"), F.array_sort(tx.theme_list(F.concat("source", F.lit(";;Tax")))).alias("themes"))


@query(with_parts("SELECT p.post_id, count(t.token) AS n FROM cl p LEFT JOIN tok t USING (post_id) GROUP BY p.post_id", "cl", "tok"))
def b10_title_tokens(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d).select("post_id", F.size(tx.title_tokens(F.col("title"))).cast("long").alias("n"))


_SUFFIXED = "CASE WHEN doc_id % 3 = 0 THEN source || ' — Site - x' WHEN doc_id % 3 = 1 THEN source || ' - Site' ELSE source END"


@query(f"SELECT doc_id, trim(CASE WHEN contains(t, ' — ') THEN split_part(t, ' — ', 1) WHEN contains(t, ' - ') THEN split_part(t, ' - ', 1) ELSE t END) AS title FROM (SELECT doc_id, {_SUFFIXED} AS t FROM documents)")
def b12_title_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.normal_title(F.expr(_SUFFIXED)).alias("title"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ' é' ELSE source END AS fixed FROM documents")
def b13_mojibake(spark: SparkSession, d: str) -> DataFrame:
    broken = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit(" Ã©"))).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", tx.fix_mojibake(broken).alias("fixed"))


_THIN = quoted(fixed.THIN_STOPWORDS)
_REASON_T = "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'TAX_FNCACT_X ECON_Y' WHEN 2 THEN 'The Cat' ELSE split_part(text, chr(10), 1) END"


@query(
    f"""WITH s AS (SELECT doc_id, {_REASON_T} AS t, CASE WHEN doc_id % 5 = 2 THEN 'is a cat' ELSE source END AS c, CASE WHEN doc_id % 11 = 3 THEN '' ELSE 'u' END AS u FROM documents),
w AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(t || ' ' || c, '\\b[A-Z]+_[A-Z_0-9]+\\b', ' ', 'g')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 1 AND x NOT IN {_THIN})) AS ws, len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+')) AS n, len(regexp_extract_all(t, '\\b[A-Z]+_[A-Z_0-9]+\\b')) AS k FROM s)
SELECT doc_id, CASE WHEN u = '' THEN 'missing_url' WHEN trim(t) = '' THEN 'empty_title' WHEN n = 0 OR k / n > 0.3 THEN 'title_is_theme_codes' WHEN len(ws) < 4 THEN 'thin_content' END AS reason FROM w"""
)
def b16_reject_reason(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'TAX_FNCACT_X ECON_Y' WHEN 2 THEN 'The Cat' ELSE substring_index(text, '\n', 1) END")
    return table(spark, d, "documents").select("doc_id", tx.reject_reason(t, F.when(F.col("doc_id") % 5 == 2, "is a cat").otherwise(F.col("source")), F.when(F.col("doc_id") % 11 == 3, "").otherwise("u")).alias("reason"))


@query(
    f"WITH s AS (SELECT page_id, page_id % 9 = 0 AS tr, regexp_extract(regexp_replace(lower({netloc_sql('url')}), ':[0-9]*$', ''), '\\.([a-z]+)$', 1) AS tld FROM pages), m AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}','{v}')" for k, v in fixed.TLD_LANGUAGE.items())
    + ") t(tld, l)) SELECT page_id, CASE WHEN tr THEN 'translated' ELSE coalesce(l, 'unknown') END AS language FROM s LEFT JOIN m USING (tld)"
)
def b18_language_map(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.language_of_url(F.col("url"), F.col("page_id") % 9 == 0).alias("language"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'es' WHEN 1 THEN 'ur' WHEN 2 THEN 'en' ELSE 'en' END AS code FROM documents")
def b19_language_code(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Spanish' WHEN 1 THEN 'Urdu' WHEN 2 THEN '' ELSE 'English' END")
    return table(spark, d, "documents").select("doc_id", tx.language_code(name).alias("code"))


_NOISE = fixed.NOISE_TITLE.replace("'", "''")


@query(with_parts(f"SELECT post_id, length(t) < 20 OR regexp_matches(t, '(?i){_NOISE}') AS noise FROM (SELECT post_id, CASE WHEN post_id % 6 = 0 THEN '10 Best ' || title ELSE coalesce(title, '') END AS t FROM posts)", "posts"))
def b20_noise_titles(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("post_id", tx.is_noise_title(F.when(F.col("post_id") % 6 == 0, F.concat(F.lit("10 Best "), "title")).otherwise(F.col("title"))).alias("noise"))


_BADCHARS = "[" + "".join(fixed.MOJIBAKE_CHARS) + "]"


@query(with_parts(f"SELECT post_id, list_sort(list_filter(list_transform(string_split(title, ' ') || ['tax_x', 'WB_12'], lambda x: lower(x)), lambda x: length(x) >= 3 AND x NOT IN {quoted(fixed.LABEL_STOPWORDS)} AND NOT regexp_matches(x, '{_BADCHARS}') AND NOT regexp_matches(x, '{fixed.TAXONOMY_CODE}'))) AS tokens FROM cl", "cl"))
def b24_label_tokens(spark: SparkSession, d: str) -> DataFrame:
    return clustered(spark, d).select("post_id", F.array_sort(tx.label_tokens(F.concat(F.split("title", " "), F.array(F.lit("tax_x"), F.lit("WB_12"))))).alias("tokens"))


@query(
    f"SELECT page_id, CASE WHEN length(t) < 15 THEN 'short' WHEN starts_with(t, 'http') THEN 'url' WHEN regexp_matches(trim(t), '^[a-zA-Z0-9]([a-zA-Z0-9\\-]*[a-zA-Z0-9])?(\\.[a-zA-Z]{{2,}})+$') THEN 'domain' WHEN regexp_matches(lower(t), '\\.(html|htm|php)$') THEN 'file' WHEN length(trim(split_part(t, ' | ', 1))) < 10 THEN 'short_head' END AS reason FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN {netloc_sql('url')} WHEN 2 THEN 'some long file name.html' WHEN 3 THEN 'ab | ' || url ELSE 'a plain title of words' END AS t FROM pages)"
)
def b25_title_rejects(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("page_id") % 5 == 0, F.col("url")).when(F.col("page_id") % 5 == 1, tx.netloc(F.col("url"))).when(F.col("page_id") % 5 == 2, "some long file name.html").when(F.col("page_id") % 5 == 3, F.concat(F.lit("ab | "), "url")).otherwise("a plain title of words")
    return table(spark, d, "pages").select("page_id", tx.title_reject(t).alias("reason"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Crime' WHEN 1 THEN 'Thing' ELSE 'Protests' END AS theme FROM documents")
def b26_theme_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.theme_name(F.expr("CASE doc_id % 3 WHEN 0 THEN 'Soc Generalcrime' WHEN 1 THEN 'Econ Thing' ELSE 'Protest' END")).alias("theme"))


@query("SELECT doc_id, r::INT AS r FROM (SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN lang = 'fr' THEN 0 ELSE 1 END, doc_id) AS r FROM documents WHERE text ILIKE '%the%' AND source <> '' AND length(text) > 5) WHERE r <= 20")
def b28_preferred_first(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where(F.col("text").ilike("%the%") & (F.col("source") != "") & (F.length("text") > 5))
    w = Window.orderBy(F.when(F.col("lang") == "fr", 0).otherwise(1), "doc_id")
    top = t.orderBy(F.when(F.col("lang") == "fr", 0).otherwise(1), "doc_id").limit(20)
    return top.select("doc_id", "lang").withColumn("r", F.row_number().over(w)).select("doc_id", "r")


# joins --------------------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def c02_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest(table(spark, d, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "value")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def c03_missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("SELECT event_id, user_id FROM events WHERE event_id IN (SELECT max(event_id) FROM events GROUP BY user_id)")
def c04_semi_max_id(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.join(e.groupBy("user_id").agg(F.max("event_id").alias("event_id")).select("event_id"), "event_id", "left_semi").select("event_id", "user_id")


@query("SELECT a.user_id AS src, b.user_id AS dst, count(*) AS weight FROM events a JOIN events b ON a.user_id <> b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 7200 SECONDS GROUP BY ALL")
def c06_interval_join(spark: SparkSession, d: str) -> DataFrame:
    return follows.interval_join(table(spark, d, "events"), "user_id", "ts", 7200)


#: The cosine that counts as a match of the driver's vectors, which are less alike than fingerprints.
ALIKE = 0.35
_PAIRS = f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= {ALIKE}"


@query(f"SELECT a, b, round(score, 4) AS score FROM ({_PAIRS})")
def c07_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", ALIKE).select("a", "b", r4("score"))


@query("SELECT b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score FROM embeddings a JOIN embeddings b ON a.vec_id = 7 AND b.vec_id <> 7")
def c08_one_vs_all(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 7").select(F.col("embedding").alias("q"))
    return e.where("vec_id <> 7").crossJoin(F.broadcast(one)).select("vec_id", r4(vectors.cosine(F.col("q"), F.col("embedding")), "score"))  # one row


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", ALIKE)


@query(f"WITH p AS ({_PAIRS}) SELECT node, count(*) AS n FROM (SELECT a AS node FROM p UNION ALL SELECT b FROM p) GROUP BY node")
def c09_other_endpoint(spark: SparkSession, d: str) -> DataFrame:
    return relational.other_endpoint(_pairs(spark, d), "a", "b").groupBy("node").agg(F.count("*").alias("n"))


@query(f"WITH p AS ({_PAIRS}) SELECT e.vec_id, count(p.a) AS n, count(p.a) FILTER (WHERE p.score >= 0.5) AS strong FROM embeddings e LEFT JOIN p ON p.a = e.vec_id OR p.b = e.vec_id GROUP BY e.vec_id")
def c10_or_endpoints(spark: SparkSession, d: str) -> DataFrame:
    ends = relational.other_endpoint(_pairs(spark, d), "a", "b").groupBy(F.col("node").alias("vec_id")).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("strong"))
    return table(spark, d, "embeddings").select("vec_id").join(ends, "vec_id", "left").fillna(0, ["n", "strong"])


@query(f"WITH p AS ({_PAIRS}), k AS (SELECT vec_id FROM embeddings WHERE label < 5) SELECT a, b FROM p WHERE a IN (SELECT vec_id FROM k) AND b IN (SELECT vec_id FROM k)")
def c11_both_in_set(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    some = e.join(e.where("label < 5").select("vec_id"), "vec_id", "left_semi")  # pairs with others are never made
    return vectors.similar_pairs(some, "vec_id", "embedding", ALIKE).select("a", "b")


@query(f"WITH p AS ({_PAIRS}) SELECT p.a, p.b, x.label AS la, y.label AS lb FROM p JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b")
def c12_two_labels(spark: SparkSession, d: str) -> DataFrame:
    p = vectors.similar_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", ALIKE, carry="label")
    return p.select("a", "b", F.col("a_label").alias("la"), F.col("b_label").alias("lb"))


CTES["vx"] = "SELECT cluster_id, post_id, unnest(range(1, len(vector) + 1)) AS i, unnest(vector)::DOUBLE AS x FROM cl WHERE vector IS NOT NULL"
CTES["cen"] = "SELECT cluster_id, list(x ORDER BY i) AS c FROM (SELECT cluster_id, i, avg(x) AS x FROM vx GROUP BY cluster_id, i) GROUP BY cluster_id"
CTES["sim"] = "SELECT p.cluster_id, p.post_id, list_inner_product(p.vector::DOUBLE[], k.c) / ((sqrt(list_inner_product(p.vector::DOUBLE[], p.vector::DOUBLE[])) + 1e-8) * (sqrt(list_inner_product(k.c, k.c)) + 1e-8)) AS s FROM cl p JOIN cen k USING (cluster_id) WHERE p.vector IS NOT NULL"
CTES["mut"] = "SELECT cluster_id, CASE WHEN count(*) < 2 THEN 0.5 ELSE least(1.0, 10 * var_pop(s)) END AS mutation, CASE WHEN count(*) < 2 THEN 0 ELSE avg(s) END AS similarity FROM sim GROUP BY cluster_id"


@query(with_parts("SELECT vec_id, cluster_id::INT AS cluster_id, round(s, 4) AS score FROM (SELECT e.vec_id, k.cluster_id, s, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(s, 6) DESC, k.cluster_id) AS r FROM embeddings e JOIN cen k ON true, LATERAL (SELECT list_inner_product(e.embedding::DOUBLE[], k.c) / ((sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) + 1e-8) * (sqrt(list_inner_product(k.c, k.c)) + 1e-8)) AS s)) WHERE r = 1 AND round(s, 6) >= 0.3", "cen"))
def c14_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    c = vectors.centroids(clustered(spark, d), "cluster_id", "vector")
    return vectors.nearest_centroid(table(spark, d, "embeddings"), "vec_id", "embedding", c, "cluster_id", 0.3).select("vec_id", "cluster_id", r4("score"))


_MEM = "SELECT vec_id, 3 AS rank, 'a' || label AS cluster FROM embeddings UNION ALL SELECT vec_id, 5, 'b' || (label // 2) FROM embeddings UNION ALL SELECT vec_id, 10, 'c' || (label // 5) FROM embeddings WHERE label < 8"


def _members(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.explode(F.filter(F.array(F.struct(F.lit(3).alias("rank"), F.concat(F.lit("a"), "label").alias("cluster")), F.struct(F.lit(5).alias("rank"), F.concat(F.lit("b"), F.floor(F.col("label") / 2)).alias("cluster")), F.struct(F.lit(10).alias("rank"), F.when(F.col("label") < 8, F.concat(F.lit("c"), F.floor(F.col("label") / 5))).alias("cluster"))), lambda s: s["cluster"].isNotNull())).alias("m")).select("vec_id", "m.rank", "m.cluster")


CTES["mem"] = _MEM
CTES["over"] = "SELECT l.cluster AS low, l.rank AS rl, h.cluster AS high, h.rank AS rh, count(*) AS shared FROM mem l JOIN mem h ON l.vec_id = h.vec_id AND l.rank < h.rank GROUP BY ALL"
CTES["overj"] = "SELECT o.*, shared / (nl.n + nh.n - shared) AS jaccard FROM over o JOIN (SELECT cluster, rank, count(*) AS n FROM mem GROUP BY ALL) nl ON nl.cluster = low AND nl.rank = rl JOIN (SELECT cluster, rank, count(*) AS n FROM mem GROUP BY ALL) nh ON nh.cluster = high AND nh.rank = rh"


@query(with_parts("SELECT low, rl, high, rh, shared, round(jaccard, 4) AS jaccard FROM overj", "overj"))
def c15_resolution_overlap(spark: SparkSession, d: str) -> DataFrame:
    return clustering.resolution_overlap(_members(spark, d), "vec_id").withColumn("jaccard", F.round("jaccard", 4))


@query(with_parts("SELECT m.cluster, m.rank, round(CASE WHEN coalesce(k, 0) >= 2 THEN least(1.0, 0.6 + 0.2 * k + 0.1 * j) WHEN k = 1 THEN least(0.8, 0.4 + 0.3 * j) WHEN m.rank <= 3 THEN 0.25 ELSE 0.35 END, 4)::DOUBLE AS confidence FROM (SELECT DISTINCT cluster, rank FROM mem) m LEFT JOIN (SELECT cluster, rank, count(*) AS k, max(jaccard) AS j FROM (SELECT low AS cluster, rl AS rank, jaccard FROM overj UNION ALL SELECT high, rh, jaccard FROM overj) GROUP BY ALL) o ON o.cluster = m.cluster AND o.rank = m.rank", "mem", "overj"))
def j05_resolution_confidence(spark: SparkSession, d: str) -> DataFrame:
    m = _members(spark, d)
    return clustering.resolution_confidence(m, clustering.resolution_overlap(m, "vec_id"))


_REG = "(VALUES " + ", ".join(f"({k}, '{f}', '{c}', {s}::DOUBLE)" for k, (f, c, s) in enumerate(fixed.REGISTRY)) + ") t(priority, fragment, category, score)"
CTES["dom"] = f"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'www.smart.com' WHEN page_id % 4 = 1 THEN 'news.bbc.co.uk' ELSE {bare_sql('url')} END AS domain FROM pages"
CTES["reg"] = f"SELECT * FROM {_REG}"
CTES["cred"] = "SELECT d.page_id, d.domain, coalesce(first(r.category ORDER BY r.priority), 'unknown') AS category, coalesce(first(r.score ORDER BY r.priority), 0.5) AS score FROM dom d LEFT JOIN reg r ON contains(d.domain, r.fragment) GROUP BY d.page_id, d.domain"


def _domains(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", F.when(F.col("page_id") % 4 == 0, "www.smart.com").when(F.col("page_id") % 4 == 1, "news.bbc.co.uk").otherwise(tx.domain_at_least(F.col("url"), 0)).alias("domain"))


@query(with_parts("SELECT page_id, domain, category, score FROM cred", "cred"))
def c16_registry_substring(spark: SparkSession, d: str) -> DataFrame:
    from tidewake.operators import credibility

    return credibility.scored_domains(spark, _domains(spark, d), "domain").select("page_id", "domain", "category", "score")


@query("SELECT doc_id, source, coalesce(s.score, 0.5) AS score FROM documents LEFT JOIN (SELECT 'src' || s_suppkey AS source, round(s_acctbal / 10000, 2) AS score FROM supplier) s USING (source)")
def c18_source_scores(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.concat(F.lit("src"), "s_suppkey").alias("source"), F.round(F.col("s_acctbal") / 10000, 2).alias("score"))
    return table(spark, d, "documents").join(s, "source", "left").select("doc_id", "source", F.coalesce("score", F.lit(0.5)).alias("score"))


@query("SELECT e.vec_id, min(c.id) AS campaign FROM embeddings e JOIN (SELECT unnest([1, 2, 3]) AS id) c ON e.label % c.id = 0 WHERE e.label > 0 GROUP BY e.vec_id")
def c19_campaign_membership(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("label > 0")
    ids = e.groupBy().agg(F.collect_set("label").alias("l"))  # ten labels
    camp = ids.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("id"), "l").select("id", F.filter("l", lambda x: x % F.col("id") == 0).alias("narrative_ids"))
    hit = camp.select("id", F.explode("narrative_ids").alias("label"))
    return e.join(hit, "label").groupBy("vec_id").agg(F.min("id").alias("campaign"))


# aggregates ---------------------------------------------------------------------------------------------------------------------


@query("SELECT source, count(*) AS posts, count(DISTINCT lang) AS langs, count(DISTINCT text) AS texts, sum(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)::BIGINT AS long_posts FROM documents GROUP BY source")
def d01_group_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("posts"), F.count_distinct("lang").alias("langs"), F.count_distinct("text").alias("texts"), F.count_if(F.col("n_chars") > 1000).alias("long_posts"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS most, count(*) FILTER (WHERE value > 5) AS alerts FROM events GROUP BY 1")
def d03_hourly_timeline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), r4(F.avg("value"), "mean"), F.max("value").alias("most"), F.count_if(F.col("value") > 5).alias("alerts"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 60")
def d04_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 60")


CTES["hd"] = "SELECT cluster_id, greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS h, count(*) AS k, sum(c) AS n FROM (SELECT cluster_id, domain, count(*) AS c FROM cl WHERE domain IS NOT NULL GROUP BY ALL) GROUP BY cluster_id"
CTES["hl"] = "SELECT cluster_id, greatest(0, -sum(p * log2(p))) AS h, count(*) AS k FROM (SELECT cluster_id, language, count(*) / sum(count(*)) OVER (PARTITION BY cluster_id) AS p FROM cl WHERE language IS NOT NULL GROUP BY cluster_id, language) GROUP BY cluster_id"


@query(with_parts("SELECT cluster_id, round(h, 4) AS h, k, n::BIGINT AS n FROM hd", "hd"))
def d05_entropy(spark: SparkSession, d: str) -> DataFrame:
    return sets.entropy(clustered(spark, d), "cluster_id", "domain").select("cluster_id", r4("h"), "k", "n")


CTES["kw"] = rf"SELECT cluster_id, w AS term, count(*) AS cnt FROM (SELECT cluster_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}\p{{M}}_]+')) AS w FROM cl) WHERE regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN {quoted(fixed.KEYWORD_STOPWORDS)} GROUP BY cluster_id, w"
CTES["kw8"] = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cnt DESC, term) AS rank FROM kw) WHERE rank <= 8"


@query(with_parts("SELECT cluster_id, term, cnt, rank::INT AS rank FROM kw8", "kw8"))
def d09_keywords_top8(spark: SparkSession, d: str) -> DataFrame:
    return clustering.keywords(clustered(spark, d), "cluster_id", "content")


CTES["jac"] = "SELECT m.cluster_id, m.members, coalesce(s, 0) / (m.members * (m.members - 1) / 2) AS jaccard FROM (SELECT cluster_id, count(DISTINCT post_id) AS members FROM tok GROUP BY cluster_id) m LEFT JOIN (SELECT cluster_id, sum(c / (na + nb - c)) AS s FROM (SELECT a.cluster_id, a.post_id, b.post_id, count(*) AS c, any_value(x.n) AS na, any_value(y.n) AS nb FROM tok a JOIN tok b ON a.cluster_id = b.cluster_id AND a.token = b.token AND a.post_id < b.post_id JOIN (SELECT post_id, count(*) AS n FROM tok GROUP BY post_id) x ON x.post_id = a.post_id JOIN (SELECT post_id, count(*) AS n FROM tok GROUP BY post_id) y ON y.post_id = b.post_id GROUP BY ALL) GROUP BY cluster_id) t USING (cluster_id)"


@query(with_parts("SELECT cluster_id, members, round(jaccard, 4) AS jaccard FROM jac", "jac"))
def d10_mean_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return sets.mean_jaccard(title_words(clustered(spark, d)), "cluster_id", "post_id", "token").select("cluster_id", "members", r4("jaccard"))


CTES["con"] = "SELECT p.cluster_id, CASE WHEN e.sets >= 3 AND e.sets >= 0.3 * p.n THEN e.top * 0.6 + least(1.0, e.shared / 3) * 0.4 ELSE 0.5 END AS concentration, CASE WHEN e.sets >= 3 AND e.sets >= 0.3 * p.n THEN e.shared ELSE 0 END AS shared FROM (SELECT cluster_id, count(DISTINCT post_id) AS n FROM cl GROUP BY cluster_id) p LEFT JOIN (SELECT c.cluster_id, max(c.c / s.sets) AS top, count(*) FILTER (WHERE c.c >= 0.2 * s.sets) AS shared, any_value(s.sets) AS sets FROM (SELECT cluster_id, entity, count(*) AS c FROM ent GROUP BY ALL) c JOIN (SELECT cluster_id, count(DISTINCT post_id) AS sets FROM ent GROUP BY cluster_id) s USING (cluster_id) GROUP BY c.cluster_id) e USING (cluster_id)"


@query(with_parts("SELECT cluster_id, round(concentration, 4) AS concentration, shared::BIGINT AS shared FROM con", "con"))
def d11_entity_concentration(spark: SparkSession, d: str) -> DataFrame:
    p = clustered(spark, d)
    return sets.concentration(p, entities(p), "cluster_id", "post_id", "entity").select("cluster_id", r4("concentration"), F.col("shared").cast("long").alias("shared"))


CTES["top3"] = f"SELECT cluster_id, entity FROM (SELECT cluster_id, entity, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, entity) AS r FROM ent WHERE entity NOT IN {quoted(fixed.GENERIC_ENTITIES)} GROUP BY cluster_id, entity) WHERE r <= 3"
CTES["cont"] = "SELECT p.cluster_id, p.n, coalesce(t.t, 0) / p.n AS continuity, coalesce(k.k, 0) AS covered FROM (SELECT cluster_id, count(DISTINCT post_id) AS n FROM cl GROUP BY cluster_id) p LEFT JOIN (SELECT e.cluster_id, count(DISTINCT e.post_id) AS t FROM ent e JOIN top3 USING (cluster_id, entity) GROUP BY e.cluster_id) t USING (cluster_id) LEFT JOIN (SELECT cluster_id, count(DISTINCT post_id) AS k FROM ent GROUP BY cluster_id) k USING (cluster_id)"


@query(with_parts("SELECT cluster_id, round(continuity, 4) AS continuity FROM cont", "cont"))
def d12_continuity(spark: SparkSession, d: str) -> DataFrame:
    p = clustered(spark, d)
    return sets.continuity(p, entities(p), "cluster_id", "post_id", "entity", list(fixed.GENERIC_ENTITIES)).select("cluster_id", r4("continuity"))


@query("SELECT doc_group, list_sort(list(lang || ':' || c)) AS languages, round(max(c) / sum(c), 4) AS dominant FROM (SELECT source AS doc_group, lang, count(*) AS c FROM documents GROUP BY ALL) GROUP BY doc_group")
def d16_language_map(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy(F.col("source").alias("doc_group"), "lang").agg(F.count("*").alias("c"))
    return c.groupBy("doc_group").agg(F.array_sort(F.collect_list(F.concat("lang", F.lit(":"), "c"))).alias("languages"), r4(F.max("c") / F.sum("c"), "dominant"))


@query(
    with_parts(
        "SELECT x, y, c, round(ln(c * n / (cx * cy)), 4) AS pmi FROM (SELECT a.entity AS x, b.entity AS y, count(*) AS c, any_value(a.c) AS cx, any_value(b.c) AS cy FROM (SELECT e.post_id, e.entity, t.c FROM e30 t JOIN (SELECT DISTINCT post_id, entity FROM ent) e USING (entity)) a JOIN (SELECT e.post_id, e.entity, t.c FROM e30 t JOIN (SELECT DISTINCT post_id, entity FROM ent) e USING (entity)) b ON a.post_id = b.post_id AND a.entity < b.entity GROUP BY ALL), (SELECT count(DISTINCT post_id) AS n FROM ent)",
        "ent",
    ).replace("\nSELECT x", ",\ne30 AS (SELECT entity, count(*) AS c FROM (SELECT DISTINCT post_id, entity FROM ent) GROUP BY entity ORDER BY c DESC, entity LIMIT 30)\nSELECT x", 1)
)
def d17_pmi_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sets.pmi_pairs(entities(clustered(spark, d)), "post_id", "entity").select("x", "y", "c", r4("pmi"))


@query("SELECT tp, fp, fn, tn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1 FROM (SELECT count(*) FILTER (WHERE p AND q) AS tp, count(*) FILTER (WHERE p AND NOT q) AS fp, count(*) FILTER (WHERE NOT p AND q) AS fn, count(*) FILTER (WHERE NOT p AND NOT q) AS tn FROM (SELECT n_chars > 800 AS p, quality = 1 AS q FROM labels JOIN documents USING (doc_id)))")
def d18_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    from tidewake.operators import report

    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return report.precision(j, F.col("n_chars") > 800, F.col("quality") == 1)


@query("SELECT language, count(*) AS n FROM (SELECT source, arg_max(lang, (c, lang)) AS language FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL) GROUP BY source) GROUP BY language")
def d21_dominant_language(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("c"))
    return c.groupBy("source").agg(F.max_by("lang", F.struct("c", "lang")).alias("language")).groupBy("language").agg(F.count("*").alias("n"))


# sequences ----------------------------------------------------------------------------------------------------------------------

CTES["gap"] = "SELECT user_id, count(*) AS n, avg(g) AS m, stddev_pop(g) AS s FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS g FROM events WHERE ts IS NOT NULL) GROUP BY user_id"


@query(with_parts("SELECT user_id, n, round(m, 4) AS gap_mean, round(s, 4) AS gap_std FROM gap", "gap"))
def e01_inter_arrival(spark: SparkSession, d: str) -> DataFrame:
    return temporal.gaps(table(spark, d, "events"), "user_id", "ts").select("user_id", "n", r4("gap_mean"), r4("gap_std"))


CTES["bk"] = "SELECT user_id, time_bucket(INTERVAL 15 MINUTES, ts) AS b, count(*) AS c, min(ts) AS f, max(ts) AS l FROM events WHERE ts IS NOT NULL GROUP BY ALL"


@query(with_parts("SELECT user_id, buckets, round(CASE WHEN epoch(l) - epoch(f) < 60 OR buckets < 2 OR s < 0.01 THEN 0 ELSE greatest(-10, least(10, (newest - m) / s)) END, 4) AS burst FROM (SELECT user_id, count(*) AS buckets, avg(c) AS m, stddev_pop(c) AS s, arg_max(c, b) AS newest, min(f) AS f, max(l) AS l FROM bk GROUP BY user_id)", "bk"))
def e02_burst_z(spark: SparkSession, d: str) -> DataFrame:
    return temporal.burst(table(spark, d, "events"), "user_id", "ts").select("user_id", "buckets", r4("burst"))


@query("SELECT event_id, round(d1, 4) AS d1, round(d1 - lag(d1) OVER (PARTITION BY user_id ORDER BY ts), 4) AS d2 FROM (SELECT *, CASE WHEN h > 0 THEN (value - lag(value) OVER (PARTITION BY user_id ORDER BY ts)) / h END AS d1 FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 / 3600 AS h FROM events))")
def e04_derivatives(spark: SparkSession, d: str) -> DataFrame:
    return temporal.derivatives(table(spark, d, "events"), "user_id", "ts", "value").select("event_id", r4("d1"), r4("d2"))


@query("WITH s AS (SELECT user_id, date_trunc('day', ts) AS at, avg(value) AS v FROM events GROUP BY ALL) SELECT a, b, points, round(r, 4) AS r FROM (SELECT x.user_id AS a, y.user_id AS b, count(*) AS points, corr(x.v, y.v) AS r, stddev_pop(x.v) AS sa, stddev_pop(y.v) AS sb FROM s x JOIN s y ON x.at = y.at AND x.user_id < y.user_id GROUP BY ALL) WHERE points >= 3 AND sa >= 0.01 AND sb >= 0.01 AND r > 0.7")
def e07_series_correlation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.date_trunc("day", "ts"))
    return temporal.correlated_series(e, "user_id", "at", "value").select("a", "b", "points", r4("r"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5")
def e06_topk_per_key(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_per_key(table(spark, d, "events"), "user_id", 5, F.desc("value"), F.col("event_id")).select("user_id", "event_id", "value")


@query("SELECT event_id, coalesce(value, 0) AS value FROM events ORDER BY coalesce(value, 0) DESC, event_id LIMIT 100")
def f02_topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.coalesce("value", F.lit(0.0)).alias("value")).orderBy(F.desc("value"), "event_id").limit(100)


@query("SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 50")
def f04_bounded_rows(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_per_key(table(spark, d, "embeddings"), "label", 50, F.col("vec_id")).select("vec_id")


@query()
def f05_label_dedup(spark: SparkSession, d: str) -> DataFrame:
    from tidewake.operators import report

    t = table(spark, d, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("label"), F.col("doc_id").alias("place"))
    return report.distinct_labels(t, "label", "place", 50)


@query("SELECT a.source AS a, b.source AS b, len(list_intersect(a.l, b.l)) AS inter, len(list_distinct(list_concat(a.l, b.l))) AS uni, len(list_filter(a.l, lambda x: NOT list_contains(b.l, x))) AS diff, len(list_filter(a.l, lambda x: NOT list_contains(b.l, x))) = 0 AS subset FROM (SELECT source, list_distinct(list(lang)) AS l FROM documents GROUP BY source) a JOIN (SELECT source, list_distinct(list(lang)) AS l FROM documents GROUP BY source) b ON a.source < b.source")
def g02_set_algebra(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("l"))
    a, b = s.select(F.col("source").alias("a"), F.col("l").alias("x")), s.select(F.col("source").alias("b"), F.col("l").alias("y"))
    size = lambda c: F.size(c).cast("long")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", size(F.array_intersect("x", "y")).alias("inter"), size(F.array_union("x", "y")).alias("uni"), size(F.array_except("x", "y")).alias("diff"), (F.size(F.array_except("x", "y")) == 0).alias("subset"))


@query("SELECT o_orderkey, o_totalprice, src FROM (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, 'new' AS src FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_totalprice, 'old' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0)")
def g05_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    old = o.where("o_orderkey % 2 = 0").withColumn("src", F.lit("old"))
    new = o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("src", F.lit("new"))
    return relational.upsert(old, new, "o_orderkey")


@query("SELECT vec_id, round(CASE WHEN n < 1e-10 OR m < 1e-10 THEN 0 ELSE dp / (n * m) END, 4) AS hard, round(dp / ((n + 1e-8) * (m + 1e-8)), 4) AS soft, round(1 / (1 + exp(-dp)), 4) AS sig FROM (SELECT vec_id, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, sqrt(list_inner_product(list_reverse(embedding)::DOUBLE[], list_reverse(embedding)::DOUBLE[])) AS m, list_inner_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]) AS dp FROM embeddings)")
def p04_vector_helpers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("r", F.reverse("embedding"))
    a, b = F.col("embedding"), F.col("r")
    return e.select("vec_id", r4(vectors.cosine(a, b), "hard"), r4(vectors.cosine_soft(a, b), "soft"), r4(vectors.logistic(vectors.dot(a, b)), "sig"))


# relational coverage ------------------------------------------------------------------------------------------------------------


@query("SELECT n_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, grouping(n_name) + 0 AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_name, o_orderpriority)")
def r01_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.rollup("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.grouping("n_name").cast("long").alias("g"))


@query("(SELECT n_name AS name FROM nation UNION SELECT r_name FROM region) EXCEPT SELECT r_name FROM region WHERE r_regionkey > 2")
def r02_set_ops(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region")
    return n.union(r.select("r_name")).distinct().exceptAll(r.where("r_regionkey > 2").select("r_name"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def r03_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, d, "customer").join(o.where("o_totalprice > 200000"), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS running, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def r04_window_frames(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("running"), F.lead("role").over(w).alias("next_role"))
