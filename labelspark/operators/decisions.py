"""Decisions on checked labels.

Decisions are appended to a log and never edited. The state is the last entry
per label, found by an aggregate, so a label with very many entries is reduced
on the map side first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def latest(log: DataFrame, key: str, order: list[str], value: list[str]) -> DataFrame:
    """Last row per key by the order columns."""
    last = F.max_by(F.struct(*value), F.struct(*order))
    return log.groupBy(key).agg(last.alias("_last")).select(key, "_last.*")


def current_decisions(log: DataFrame) -> DataFrame:
    """Label and decision; the last write wins and an undo clears it."""
    last = latest(log, "label_id", ["ts", "entry_no"], ["decision", "ts"])
    return last.filter(F.col("decision") != "undo")


def overlay(report: DataFrame, decisions: DataFrame) -> DataFrame:
    """Batch rows with their decision, if any."""
    return report.join(decisions.select("label_id", "decision"), "label_id", "left")


def bucket_of(decision: Column) -> Column:
    return (
        F.when(decision == "approve", "approved")
        .when(decision == "decline", "rejected")
        .otherwise("under_review")
    )


def move_applications(store: DataFrame, decided: DataFrame) -> DataFrame:
    """Store after the decisions: a decided entry moves to the new bucket and keeps the rest.

    ``store`` and ``decided`` hold one entry per id and ``bucket``; a decision on
    an id the store does not know adds the entry.
    """
    to = decided.select("id", F.col("bucket").alias("_to"))
    moved = store.join(to, "id", "left").withColumn("bucket", F.coalesce("_to", "bucket"))
    added = decided.join(store.select("id"), "id", "left_anti")
    return moved.drop("_to").unionByName(added, allowMissingColumns=True)


def bucket_counts(store: DataFrame) -> DataFrame:
    return store.groupBy("bucket").agg(F.count("*").alias("applications"))
