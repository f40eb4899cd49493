"""A corpus pipeline: STAGES run one after another, each over all documents that the one before kept.

Language ID drops documents that are in no learned language, exact dedup keeps the last of equal texts, near-dedup one of each group of near copies, by op3's fingerprints and by shingle sets,
PII masks personal data, and packing cuts what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskspark.llm.common import new_dir, read_table
from riskspark.llm.exact_dedup import drop_copies
from riskspark.llm.language_id import accept_language
from riskspark.llm.packing import pack
from riskspark.llm.pii import masked
from riskspark.llm.simhash import drop_near_copies
from riskspark.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return accept_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return drop_near_copies(docs, fingerprint_words=3)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Language profiles, near-dup groups, the PII classifier and packing have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
