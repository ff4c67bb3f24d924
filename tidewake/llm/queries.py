"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import byte_bpe, hard_negatives, html_extract, line_dedup, near_dedup, packing, prefix_trie, quality_classifier, quality_rules, sentencepiece_bpe, token_files, topk_search, warc_store
from tidewake.llm._shared import scratch, stored

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_classifier.classify(documents, quality_classifier.train(documents, table(spark, sf_dir, "labels")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc_store.write(table(spark, sf_dir, "pages"), path)
    return warc_store.payload_facts(spark, path).withColumnRenamed("key", "page_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.col("n_lines_").alias("n_lines"), F.col("deleted_lines_").alias("deleted_lines"), F.col("deleted_words_").alias("deleted_words"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_files.round_trip(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), WORD_MODEL, end_id=1)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_MODEL, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_MODEL)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations")), "turns")
    nodes = prefix_trie.trie(prefix_trie.rebuilt(turns))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_quality_classifier, op3_quality_rules, op4_warc, op5_line_dedup, op6_token_files, op7_packing, op8_html_extract, op9_near_dedup, op10_topk_search, op11_byte_bpe, op12_hard_negatives, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules.ORACLE, "op4_warc": warc_store.ORACLE, "op9_near_dedup": near_dedup.ORACLE, "op10_topk_search": topk_search.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
