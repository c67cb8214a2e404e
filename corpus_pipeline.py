"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as the
next stage's ``docs``.  Stages with Python tasks bound the bytes of the session's Arrow batches.  All but the last return the columns of ``documents``: rejected documents and all but one
of a group of near copies go, personal data is replaced in the text, and the mix repeats documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import bootstrap_pii, divergence, mixing, near_copies, packing
from wayfold.session import shared_folder, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    return divergence.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 80 % of the five-word shingles in common."""
    small_batches(spark)
    return near_copies.keep_one_near_copy(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    small_batches(spark)
    return bootstrap_pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("pack", pack)]

#: Hashing, models and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
