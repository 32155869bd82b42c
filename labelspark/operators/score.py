"""Rule results to an overall status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READY, REVIEW, CRITICAL = "Ready to approve", "Needs review", "Critical issues"


def overall(fail_count: Column, review_count: Column) -> Column:
    return (
        F.when(fail_count > 0, CRITICAL).when(review_count > 0, REVIEW).otherwise(READY)
    )


def status_key(status: Column) -> Column:
    """Anything but fail and needs_review counts as a pass, null and '' included."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s.isin("fail", "needs_review"), s).otherwise("pass")


def score_array(checked: DataFrame) -> DataFrame:
    """Counts and overall status from the ``results`` array, without an exchange."""
    states = F.transform("results", lambda r: status_key(r["status"]))

    def count(name):
        return F.size(F.filter("states", lambda s: s == name))

    out = checked.withColumn("states", states).select(
        "*",
        count("pass").alias("pass_count"),
        count("needs_review").alias("review_count"),
        count("fail").alias("fail_count"),
    )
    return out.drop("states").withColumn(
        "overall_status", overall(F.col("fail_count"), F.col("review_count"))
    )


def score_table(labels: DataFrame, rule_results: DataFrame) -> DataFrame:
    """The same from the long table; labels without results are ready to approve."""
    state = status_key(F.col("status"))
    counts = rule_results.groupBy("label_id").agg(
        F.count_if(state == "pass").alias("pass_count"),
        F.count_if(state == "needs_review").alias("review_count"),
        F.count_if(state == "fail").alias("fail_count"),
    )
    names = ["pass_count", "review_count", "fail_count"]
    return (
        labels.select("label_id")
        .join(counts, "label_id", "left")
        .select("label_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
        .withColumn("overall_status", overall(F.col("fail_count"), F.col("review_count")))
    )
