"""The corpus pipeline: what is worth keeping of ``documents``, packed for training.

Each stage works on everything its predecessor kept and its decisions take effect. Stages get
(spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgrid.llm.bytecnn import THRESHOLD, scored, trained
from symgrid.llm.common import table, work_dir
from symgrid.llm.contain import without_leaks
from symgrid.llm.packing import pack
from symgrid.llm.secrets import redacted
from symgrid.llm.simhash import one_of_each


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, doesn't reject.

    Null and empty texts are rated like any other; equal texts are kept or rejected alike; columns
    may have any name; an empty table, or one without labels, loses no row.
    """
    model = trained(docs, table(spark, sf_dir, "labels"))
    # A row travels as one struct, so that no name of its columns can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("text"))
    return scored(rows, model).where(F.col("score") >= THRESHOLD).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets replaced by a mark."""
    return redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in its sequence."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the packing: tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    path = work_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{number}-{name}")
        docs = spark.read.parquet(f"{path}/{number}-{name}")
    return docs
