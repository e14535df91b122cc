"""A training corpus from the table documents: quality rules, near-duplicate join, pseudonyms, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import jaccard_join, mixing, packing, pii, quality, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    return quality.kept_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of the n-gram Jaccard join."""
    return jaccard_join.one_of_each(docs)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by pseudonyms of its format; n_chars follows the text."""
    out = pii.pseudonymised(docs, key=pii.key_of(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of its source does."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the documents' pieces in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("pseudonyms", pseudonym_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs


#: The pseudonyms and tokenizer have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None
