"""A corpus pipeline of five stages over documents. Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Other columns pass through up to the last stage, whatever their names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm import decontamination, pseudonyms, sentence_pieces, shingle_join, toxicity
from veilgraph.llm.common import documents, fresh, shared_dir, stored
from veilgraph.llm.queries import release_key, toxicity_model

#: Ids of removed copies up to which they are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7. Null, empty and wordless texts score low and stay, repeated rows are judged
    one by one, an empty table gives an empty one."""
    mark = fresh("toxicity", docs.columns)
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir), out_col=mark)
    return scored.where(F.col(f"`{mark}`") < 0.7).drop(mark)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id, those without an id last; rows of one id are documents of
    their own. Null, empty and wordless texts are copies of nothing and stay."""
    row = fresh("row", docs.columns)
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        rows = docs.withColumn(row, F.col("doc_id"))
        gone = shingle_join.classes(rows, id_col=row).where("component_id <> doc_id").select(F.col("doc_id").alias(row))
    else:  # ids can't tell rows apart: the rows are numbered, and written so that they keep their numbers
        rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), shared_dir(spark, "rows"))
        classes = shingle_join.classes(rows, id_col=row).select(F.col("doc_id").alias("r"), "component_id")
        order = rows.select(F.col(row).alias("r"), F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col(row).alias("r")).alias("place"))
        classes = classes.join(order, "r")
        gone = classes.join(classes.groupBy("component_id").agg(F.min("place").alias("first")), "component_id").where("place <> first").select(F.col("r").alias(row))
        gone = stored(gone, shared_dir(spark, "gone"))
    out = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, row, "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to its edit budget. Null and empty texts and items match nothing; repeated
    rows are judged one by one; without items all documents stay."""
    key, items = fresh("id", docs.columns), fresh("item_ids", docs.columns)
    found = decontamination.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns, out_id=key, out_col=items)
    return found.where(F.size(F.col(f"`{items}`")) == 0).drop(key, items)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data as pseudonyms under the session's key, n_chars counted anew; null texts stay null."""
    out = pseudonyms.pseudonymise(docs, release_key(spark), spans=False)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each document; null texts are empty."""
    return sentence_pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("personal_data", replace_personal_data), ("sentence_pieces", tokenise)]

#: The stages are no SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
