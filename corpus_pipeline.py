"""Corpus preparation: quality classifier, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes what the one before kept, written as Parquet and read again. All but the last
return the columns of documents; a document is a row of one doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import decontamination, importance, neardup, packing, pii
from credence.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards well-labelled text draws; rows without doc_id stay."""
    judged = importance.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = judged.where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the lowest doc_id of each class; rows without doc_id stay."""
    classes = neardup.near_duplicates(docs)
    dropped = classes.where("class_id <> doc_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; rows without doc_id stay."""
    found = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind; n_chars follows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text"), "lang", "source", pii.spans(text).alias("spans"))
    clean = found.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("text"), "lang", "source")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("personal_data", personal_data), ("packed", packed)]

#: Sampling, signatures and tokenizing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
