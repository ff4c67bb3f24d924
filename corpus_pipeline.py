"""The corpus pipeline: score, clean, deduplicate and pack ``documents``.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor kept, and returns the columns of ``documents``, but for
the last one, which returns packed pieces. Results are written as Parquet in the shared folder and read again for the next stage.

Every stage takes empty tables (and returns them), null texts (empty ones), texts of any length, rows that are repeated (each by itself) and documents
with further columns, which ``run`` leaves out. What it does with null ids and ties is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import line_dedup, near_dedup, packing, quality_classifier, quality_rules
from tidewake.llm._shared import stored
from tidewake.llm.queries import WORD_MODEL, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier predicts to be of low quality; it learns from the labelled rows of the stage's own input.

    Rows with a null id are scored like others but teach nothing; without labels of both kinds no document goes.
    """
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.classify(docs, model, keep=COLUMNS)
    return (scored.where("predicted = 1") if model else scored).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove failing lines, drop documents that the rules reject: null and empty texts and those of under 50 words among them. Null ids are no matter."""
    cleaned = quality_rules.apply_rules(docs, keep=COLUMNS).where("kept")
    return cleaned.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete blocks of lines that an earlier document has; a document that loses all its lines goes.

    The earlier of two documents is that of the smaller id; rows that repeat an id aren't compared with each other; a null id takes no part and stays
    as it is.
    """
    done = line_dedup.dedup_lines(docs.select(*COLUMNS)).where("deleted_lines_ = 0 or deleted_lines_ < n_lines_")
    return done.select("doc_id", "text", "lang", "source", F.when(F.col("deleted_lines_") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates: the smallest id. Rows of an id that goes all go; a null id takes no part and stays."""
    gone = near_dedup.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(stored(gone, "near-copies"), "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens at the sources' own proportions; null sources are one source, null ids are packed like others."""
    pieces = packing.pack(docs, WORD_MODEL, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", quality_scores), ("quality rules", rules), ("line dedup", lines), ("near-duplicates", near_copies), ("packing", pack)]

#: The classifier can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
