"""Queries of this subpackage, by name, with production parameters, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_model, page_templates, pseudonyms, quality_rules, sentence_pieces, shingle_join, token_files, toxicity, url_filter
from .common import crc32_mod, documents, pages


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_files.write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(spark, tokens).withColumnRenamed("id", "doc_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(documents(spark, sf_dir))
    return out.selectExpr("id AS doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(pages(spark, sf_dir), url_filter.standard_entries(spark, spark.conf.get("spark.veilgraph.url.list", None))).withColumnRenamed("id", "page_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def toxicity_model(spark: SparkSession, sf_dir: str):
    """Learned from labelled documents whose crc32 modulo 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc32_mod("doc_id", 3) != 1)
    return toxicity.train(documents(spark, sf_dir), labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(documents(spark, sf_dir), toxicity_model(spark, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


#: For tests and comparisons alone: everybody has it, so that its pseudonyms hide nothing.
DEMO_KEY = b"veilgraph demonstration key"


def release_key(spark: SparkSession) -> bytes:
    """The key of the session, spark.veilgraph.pseudonym.key; the demonstration key where it is unset."""
    return (spark.conf.get("spark.veilgraph.pseudonym.key", None) or DEMO_KEY.decode()).encode()[:64]


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(documents(spark, sf_dir), release_key(spark), keep=["doc_id"])
    return out.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_pii"), F.transform("pii_spans", lambda x: x["kind"]).alias("kinds"))


def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.classes(documents(spark, sf_dir))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir), crc32_mod("doc_id", 7) != 2).withColumnRenamed("id", "doc_id")


def op8_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_templates.extract(pages(spark, sf_dir)).withColumnRenamed("id", "page_id")


QUERIES = {
    f.__name__: f
    for f in (op1_sentence_pieces, op2_token_files, op3_decontamination, op4_quality_rules, op5_toxicity, op6_url_filter, op7_shingle_join, op8_page_templates, op9_pseudonyms, op10_language_model)
}
ORACLE: dict[str, str] = {}
