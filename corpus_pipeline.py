"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlog.llm import decontaminate, minhash, pieces, pii, quality
from siftlog.llm.common import staged, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near some language's reference."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.mask(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, as a binary of 2 bytes an id."""
    return pieces.encode(docs).selectExpr("doc_id", "cast(length(ids) / 2 as long) as n_tokens", "ids")


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", clean), ("personal_data", private), ("encoding", encoded)]
#: Sampling, alignment and segmentation can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
