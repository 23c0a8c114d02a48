"""A corpus from raw documents to packed training sequences.

Stages: reject bad documents, keep one of each near-duplicate group, redact personal data, mix sources to their
target weights, pack into sequences.  Each stage takes the documents that its predecessor left, as a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetspark.llm.common import cut, table
from packetspark.llm.mixing import mixed_documents
from packetspark.llm.neardup import one_of_each
from packetspark.llm.packing import pack_documents
from packetspark.llm.pii import redact
from packetspark.llm.quality import good_documents
from packetspark.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship_package(spark)
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    ship_package(spark)
    return one_of_each(docs, shingle=5, similarity=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced by their kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences."""
    ship_package(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: A classifier, token ids and best-fit packing are beyond SQL; the operators are tested against brute force on their own, run() for its shape.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
