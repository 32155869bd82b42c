"""OCR words to line blocks.

Everything up to the blocks is keyed by the text line, not by the label, so one
exchange on the line key serves the gap window, the split threshold, the
sub-line numbering and the final aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.config import NUTRITION_SPLIT_WORDS

LINE = ["label_id", "pass_id", "block_num", "par_num", "line_num"]
HIERARCHY = ["block_num", "par_num", "line_num"]


def with_hierarchy(words: DataFrame) -> DataFrame:
    """Without layout columns every word is a line of its own, in word order."""
    if all(c in words.columns for c in HIERARCHY):
        return words
    return words.drop(*HIERARCHY).select(
        "*",
        F.lit(0).alias("block_num"),
        F.lit(0).alias("par_num"),
        F.col("word_no").alias("line_num"),
    )


def word_gaps(words: DataFrame) -> DataFrame:
    """Add ``gap`` to the word on the left and that word's text as ``prev_text``."""
    by_x = Window.partitionBy(*LINE).orderBy("left", "word_no")
    return with_hierarchy(words).withColumn(
        "gap", F.col("left") - F.lag(F.col("left") + F.col("width")).over(by_x)
    ).withColumn("prev_text", F.lower(F.lag("text").over(by_x)))


def gap_thresholds(gaps: DataFrame) -> DataFrame:
    """Add the adaptive ``threshold`` of the line: max(p75, 2 * median, 18)."""
    line = Window.partitionBy(*LINE)
    cuts = F.percentile("gap", F.array(F.lit(0.5), F.lit(0.75))).over(line)
    return (
        gaps.withColumn("cuts", cuts)
        .withColumn(
            "threshold",
            F.greatest(F.col("cuts")[1], F.col("cuts")[0] * 2, F.lit(18.0)),
        )
        .drop("cuts")
    )


def sub_lines(words: DataFrame) -> DataFrame:
    """Number the parts of each line, left to right, as ``sub_line``."""
    by_x = Window.partitionBy(*LINE).orderBy("left", "word_no")
    # The column test looks at the word before the gap, as the reference does.
    nutrition = F.col("prev_text").rlike("|".join(NUTRITION_SPLIT_WORDS))
    split = (F.col("gap") > F.col("threshold")) | (nutrition & (F.col("gap") > 8))
    running = by_x.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return gap_thresholds(word_gaps(words)).withColumn(
        "sub_line", F.sum(F.coalesce(split, F.lit(False)).cast("int")).over(running)
    )


def ordered_text(order: list[str], text: str = "text", sep: str = " ") -> Column:
    """Aggregate: texts of the group joined in the given order."""
    item = F.struct(*[F.col(c) for c in order], F.col(text).alias("_text"))
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_text"]), sep
    )


def line_blocks(words: DataFrame) -> DataFrame:
    """Usable words to blocks; the position columns keep the order of the blocks."""
    parts = sub_lines(words)
    return parts.groupBy(*LINE, "sub_line").agg(
        ordered_text(["left", "word_no"]).alias("text"),
        F.min("left").cast("int").alias("x1"),
        F.min("top").cast("int").alias("y1"),
        F.max(F.col("left") + F.col("width")).cast("int").alias("x2"),
        F.max(F.col("top") + F.col("height")).cast("int").alias("y2"),
        F.avg("conf").alias("confidence"),
    )
