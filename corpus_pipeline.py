"""Training-data pipeline over `documents`: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.llm.exact import exact_duplicates
from labelspark.llm.jaccard import similar_rows
from labelspark.llm.keep import keep_rows
from labelspark.llm.pack import pack
from labelspark.llm.stored import read_table, stored
from labelspark.llm.toxicity import drop_toxic, fit_toxicity
from labelspark.llm.winnow import contamination

#: Texts and models decide, so there is no SQL for the whole; tests use brute-force versions.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return keep_rows(docs, exact_duplicates(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with 0.8 of their five-word shingles in common, the row with the smallest doc_id stays.

    A component without any doc_id keeps all its rows.
    """
    rows = similar_rows(docs, k=5, percent=80)
    kept = F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    return keep_rows(docs, rows.select("doc_id", "raw_sha256", kept.alias("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a span of a benchmark item go."""
    rows = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return keep_rows(docs, rows.select("doc_id", "raw_sha256", (~F.col("contaminated")).alias("kept")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 4096 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
