"""CSV records from lines: files are read in splits, and quoted line breaks are found by parity.

A line stands inside a quoted field if an odd number of quotes comes before it in its file, as a
quote inside a field is doubled. Quotes are counted per split of a file, the counts of the splits
before give each split's first parity, and a running sum inside it the parity of every line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_READING = {"escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
_BLOCK = ["file", "block"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): lines with their split and, inside it, an increasing number."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )


def _quotes() -> Column:
    return F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))


def _filled() -> Column:
    return F.regexp_like("value", F.lit(r"\S"))


def _line_states(lines: DataFrame) -> DataFrame:
    """Lines with `start` (they begin a record), `quotes`, and the record's `start_at` if it is in
    the same block; `head`, where the file's first line with any text stands."""
    counted = lines.withColumn("quotes", _quotes())
    blocks = counted.groupBy(*_BLOCK).agg(
        F.sum("quotes").alias("q"), F.expr(r"min(at) FILTER (WHERE regexp_like(value, '\\S'))").alias("first_at")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    head = F.min(F.when(F.col("first_at").isNotNull(), F.struct("block", "first_at"))).over(Window.partitionBy("file"))
    entered = blocks.select(*_BLOCK, (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2).alias("parity"), head.alias("head"))
    inside = Window.partitionBy(*_BLOCK).orderBy("at")
    ran = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("ran", ran).join(entered, _BLOCK).withColumn("start", (F.col("ran") + F.col("parity")) % 2 == 0)
    own = F.max(F.when(F.col("start"), F.col("at"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("start_at", own)


def records(lines: DataFrame) -> DataFrame:
    """(file, block, at, record, is_head) of `lines` (file, block, at, value).

    A record has the place of its first line. Lines are dealt once by split, so no task holds more
    than one; records of one line, nearly all, are complete there. Only lines of longer records
    meet again, also from several splits, and are glued with a line break. Blank lines between
    records are left out. A quote that is never closed makes the rest of its file one record, as
    in any reader of this form.
    """
    states = _line_states(lines)
    whole = states.where("start AND quotes % 2 = 0").where(_filled()).select("file", "block", "at", F.col("value").alias("record"), "head")
    parts = states.where("NOT (start AND quotes % 2 = 0)")
    # lines before the first start of a block belong to the last start of the blocks before
    last = states.where("start").groupBy(*_BLOCK).agg(F.max("at").alias("last_at"))
    every = states.select(*_BLOCK).distinct().join(last, _BLOCK, "left")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(
        *_BLOCK,
        F.last(F.when(F.col("last_at").isNotNull(), F.struct(F.col("block").alias("b"), F.col("last_at").alias("a"))), True)
        .over(earlier).alias("carried"),
    )
    owned = parts.join(carried, _BLOCK).select(
        "file", F.when(F.col("start_at").isNotNull(), F.col("block")).otherwise(F.col("carried.b")).alias("b"),
        F.coalesce("start_at", "carried.a").alias("a"), "head", F.struct("block", "at", "value").alias("line"),
    )
    glued = owned.groupBy("file", "b", "a").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x["value"]), "\n").alias("record"),
        F.first("head").alias("head"),
    )
    both = whole.unionByName(glued.select("file", F.col("b").alias("block"), F.col("a").alias("at"), "record", "head"))
    is_head = (F.col("block") == F.col("head.block")) & (F.col("at") == F.col("head.first_at"))
    return both.select("file", "block", "at", F.regexp_replace("record", "\r$", "").alias("record"), is_head.alias("is_head"))


def parsed(records_: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of text of the records, without the first one of each file, their header."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    rows = records_.where(~F.col("is_head")).select(F.from_csv("record", schema, _READING).alias("r"))
    return rows.select("r.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, all columns as text; quoted fields may hold line breaks.

    Large files are read by several tasks. The names are those of the first file's header.
    """
    head = spark.read.csv(
        path, header=True, inferSchema=False, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )
    return parsed(records(read_lines(spark, path)), head.columns)
