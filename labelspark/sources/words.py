"""OCR word table: the entry of the label side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark import schemas
from labelspark.functions.text import let, strip


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Word table from parquet; the usable-word filter is pushed to the scan."""
    return usable_words(spark.read.schema(schemas.OCR_WORDS).parquet(path))


def usable_words(words: DataFrame) -> DataFrame:
    """Drop blank text and the negative confidence OCR gives to non-words."""
    conf = F.coalesce(F.col("conf"), F.lit(0.0))
    return (
        words.filter((conf >= 0) & strip(F.col("text")).rlike("."))
        .withColumn("text", strip(F.col("text")))
        .withColumn("conf", conf.cast("double"))
    )


def union_passes(*passes: DataFrame) -> DataFrame:
    """Word tables of several OCR passes as one table with ``pass_id`` 0, 1, ..."""
    tagged = [p.withColumn("pass_id", F.lit(i)) for i, p in enumerate(passes)]
    return reduce(DataFrame.unionByName, tagged)


#: Columns of a word that have to be numbers where they are given.
NUMBERS = {"pass_id": "int", "word_no": "int", "block_num": "int", "par_num": "int", "line_num": "int", "conf": "double",
           "left": "int", "top": "int", "width": "int", "height": "int"}
NEEDED = ["left", "top", "width", "height"]


def read_raw_words(spark: SparkSession, path: str) -> DataFrame:
    """Word rows of JSON lines as text, unparsed; a line that is no object keeps it in `unreadable`."""
    schema = ", ".join(f"`{c}` string" for c in schemas.OCR_WORDS.names) + ", unreadable string"
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "unreadable").json(path)


def typed_words(raw: DataFrame) -> DataFrame:
    """Rows of text as words, with `error`: why a row is none, null where it is one.

    A number that cannot be read, a missing box or one of negative size, and an unreadable line
    are errors. Nothing raises, nothing is dropped. Each row is read once, in a generator of one
    row: a filter on `error` stays above it instead of taking a copy of all the casts along.
    """
    have = set(raw.columns)
    text = {c: strip(F.col(c)) if c in have else F.lit("") for c in NUMBERS}

    def number(c, kind):
        """A cast skips the usual white space itself; the pattern is for what it cannot read."""
        stripped = text[c].try_cast(kind)
        return F.coalesce(F.col(c).cast("string").try_cast(kind), stripped) if c in have else stripped

    def read(v):
        told = F.concat(F.lit("word "), F.when(text["word_no"] == "", "?").otherwise(text["word_no"]), F.lit(": "))
        checks = [F.when(v[c].isNull() & (text[c] != ""), F.concat(told, F.lit(f"{c} is not a number"))) for c in NUMBERS]
        checks += [F.when(v[c].isNull() & (text[c] == ""), F.concat(told, F.lit(f"{c} is missing"))) for c in NEEDED]
        checks += [F.when(v[c] < 0, F.concat(told, F.lit(f"{c} is negative"))) for c in ("width", "height")]
        if "unreadable" in have:
            checks.insert(0, F.when(F.col("unreadable").isNotNull(), F.lit("unreadable line")))
        return F.struct(*[v[c].alias(c) for c in NUMBERS], F.coalesce(*checks).alias("error"))

    values = F.struct(*[number(c, kind).alias(c) for c, kind in NUMBERS.items()])
    kept = raw.select("*", F.explode(F.array(let(values, read))).alias("_read"))
    columns = [F.col(f"_read.{f.name}") if f.name in NUMBERS else F.col(f.name) for f in schemas.OCR_WORDS]
    return kept.select(*columns, "_read.error")


def word_errors(typed: DataFrame) -> DataFrame:
    """(label_id, error, bad_words): the first error of each label by the alphabet, and how many rows have one.

    Rows that name no label are counted under null.
    """
    return typed.where("error is not null").groupBy("label_id").agg(
        F.min("error").alias("error"), F.count("*").alias("bad_words")
    )
