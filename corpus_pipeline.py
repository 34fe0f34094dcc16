"""From documents to token ids: toxicity, language, near-duplicates, mixing, BPE.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir), docs being
the Parquet that its predecessor wrote, or the table documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.llm import bpe, langid, mixing, shingles, toxicity
from callscope.llm.common import fresh_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from the labelled ones."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised."""
    return langid.drop_unknown(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of at least 0.8) the document with the smallest id."""
    return shingles.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian unsigned 32-bit) of each document."""
    coded = bpe.encode_ids(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxicity_stage), ("language", language_stage), ("dedup", dedup_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Trained models and hashed shingles are beyond SQL; a brute-force version stands in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = fresh_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
