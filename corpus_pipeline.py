"""A training corpus in five stages: each is written as Parquet and read again by the next one.

quality classifier, near-duplicates, personal data, source mix, packing into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm.common import materialize, table
from lexmill.llm.mixing import mixed_documents
from lexmill.llm.near_duplicates import without_near_duplicates
from lexmill.llm.packing import pack
from lexmill.llm.pii import sanitised
from lexmill.llm.resampling import resampled

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resampled(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitised(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, with_text=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("source_mix", source_mix),
    ("packing", sequences),
]

#: Training a model, near-duplicate groups and packing are beyond SQL; tests/llm hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
