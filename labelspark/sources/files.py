"""Index of label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.functions.text import strip


def index_files(paths: DataFrame) -> DataFrame:
    """Add ``file_key`` (name without directory and extension) to a ``path`` listing."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    # a leading dot does not start an extension
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    return paths.withColumn("file_key", strip(stem))


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """Recursive listing; only the path column is read, never the contents."""
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    )
    return index_files(found.select("path"))
