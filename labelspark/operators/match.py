"""Applications to label files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_files(files: DataFrame) -> DataFrame:
    """First file in listing order per key: an aggregate, so many copies of one name
    are reduced before the exchange."""
    order = "listing_no" if "listing_no" in files.columns else "path"
    first = F.min_by(F.struct("path", F.col(order).alias("listed")), order)
    return files.groupBy("file_key").agg(first.alias("f")).select("file_key", "f.*")


def match_files(applications: DataFrame, files: DataFrame) -> DataFrame:
    """Application with its label file: exact key first, else ignoring case.

    The file side has one row per key, so a label_id that a third of the
    applications share is split by the adaptive skew join.
    """
    by_key = first_files(files)
    exact = by_key.drop("listed")
    folded = by_key.groupBy(F.lower("file_key").alias("folded_key")).agg(
        F.min_by("path", "listed").alias("folded_path")
    )
    joined = (
        applications.join(exact, F.col("label_id") == F.col("file_key"), "left")
        .withColumn(
            "_rest", F.when(F.col("path").isNull(), F.lower("label_id"))
        )
        .join(folded, F.col("_rest") == F.col("folded_key"), "left")
        .withColumn("path", F.coalesce("path", "folded_path"))
    )
    return joined.filter(F.col("path").isNotNull()).drop(
        "file_key", "_rest", "folded_key", "folded_path"
    )


def missing_files(applications: DataFrame, files: DataFrame) -> DataFrame:
    """Applications no file belongs to."""
    keys = files.select(F.lower("file_key").alias("_key"))
    return applications.join(keys, F.lower("label_id") == F.col("_key"), "left_anti")
