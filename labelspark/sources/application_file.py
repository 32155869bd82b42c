"""The single-file JSON form of a store: one object with an array of entries for each bucket."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.sources.commits import missing
from labelspark.sources.store import BUCKETS, STORE_SCHEMA

#: Keys of an entry that have a column of their own; others travel together in `extra`.
KNOWN = ["id", "brand_name", "class_type", "overall_status", "app_data", "image_bytes", "result"]
#: Every entry is a VARIANT by itself, so its size limit is an entry's, not the file's.
_DOCUMENT = ", ".join(f"{b} array<variant>" for b in BUCKETS) + ", unreadable string"
ENTRY_SCHEMA = STORE_SCHEMA + ", extra string"


def _entries(documents: DataFrame, document: str | None) -> DataFrame:
    """One row per entry of the buckets' arrays, in columns of ENTRY_SCHEMA."""
    field = (lambda b: f"{document}.{b}") if document else (lambda b: b)
    lists = ", ".join(
        f"transform(coalesce({field(b)}, array()), e -> named_struct('bucket', '{b}', 'entry', e))" for b in BUCKETS
    )
    rows = documents.select(F.explode(F.expr(f"concat({lists})")).alias("x")).select("x.bucket", "x.entry")
    text = lambda key: F.expr(f"try_variant_get(entry, '$.{key}', 'string')")
    nested = lambda key: F.expr(f"nullif(to_json(try_variant_get(entry, '$.{key}', 'variant')), 'null')")
    known = ", ".join(f"'{k}'" for k in KNOWN)
    others = F.expr(
        f"map_filter(cast(if(schema_of_variant(entry) like 'OBJECT%', entry, null) as map<string,variant>),"
        f" (k, v) -> not array_contains(array({known}), k))"
    )
    return rows.select(
        text("id").alias("id"), text("brand_name").alias("brand_name"), text("class_type").alias("class_type"),
        text("overall_status").alias("overall_status"), nested("app_data").alias("app_data"),
        F.expr("try_to_binary(try_variant_get(entry, '$.image_bytes', 'string'), 'base64')").alias("image_bytes"),
        nested("result").alias("result"), "bucket",
        F.when(F.size(others) > 0, F.to_json(others)).alias("extra"),
    )


def parse_documents(texts: DataFrame, column: str = "value") -> DataFrame:
    """Entries of the documents in a text column; a text that is no such object gives none.

    app_data and result keep all their keys, as JSON text; keys of an entry without a column are
    in `extra`, null if there are none.
    """
    document = F.from_json(F.col(column), _DOCUMENT, {"columnNameOfCorruptRecord": "unreadable"})
    return _entries(texts.select(document.alias("d")), "d")


def _files(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return (
            spark.read.schema(_DOCUMENT).option("multiLine", True)
            .option("columnNameOfCorruptRecord", "unreadable").json(path)
        )
    except AnalysisException as e:
        if missing(e):
            return None
        raise


def read_application_file(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a file, indented or not, or of all files of a folder; none if it is missing."""
    files = _files(spark, path)
    return spark.createDataFrame([], ENTRY_SCHEMA) if files is None else _entries(files, None)


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, unreadable) of the files that hold no such object."""
    files = _files(spark, path)
    if files is None:
        return spark.createDataFrame([], "file string, unreadable string")
    # the reader parses nothing, and finds nothing unreadable, unless a bucket is asked for
    bad = files.where(F.col("unreadable").isNotNull() & F.coalesce(*[F.col(b) for b in BUCKETS]).isNull())
    return bad.select(F.col("_metadata.file_path").alias("file"), "unreadable")


def entry_json(store: DataFrame) -> Column:
    """An entry as a JSON object, with app_data and result as objects and the keys of `extra`."""
    extra = "extra" if "extra" in store.columns else "null"
    own = (
        "named_struct('id', id, 'brand_name', brand_name, 'class_type', class_type, 'overall_status', overall_status,"
        " 'app_data', try_parse_json(app_data), 'image_bytes', coalesce(base64(image_bytes), ''), 'result', try_parse_json(result))"
    )
    others = f"coalesce(cast(try_parse_json({extra}) as map<string,variant>), cast(map() as map<string,variant>))"
    return F.expr(
        f"to_json(map_concat(cast(parse_json(to_json({own}, map('ignoreNullFields', 'false'))) as map<string,variant>), {others}))"
    )


def write_application_file(store: DataFrame, path: str) -> None:
    """Write the store as one JSON object, in a folder with one text file.

    The form is one file, so its lines, one per entry, end in one task, which only passes them
    on; they are made and sorted before.
    """
    text = store.select(
        F.array_position(F.lit(BUCKETS), F.col("bucket")).cast("int").alias("b"), F.lit(1).alias("kind"), "id", entry_json(store).alias("line")
    )
    text = text.withColumn("at", F.struct("id", F.xxhash64("line"), "line"))
    first = text.groupBy("b").agg(F.min("at").alias("first"))
    entries = text.join(F.broadcast(first), "b").select(
        "b", "kind", "id", F.concat(F.when(F.col("at") == F.col("first"), "").otherwise(","), F.col("line")).alias("line"), F.col("at").alias("at")
    )
    spark = store.sparkSession
    frame = []
    for i, bucket in enumerate(BUCKETS, 1):
        frame.append((i, 0, ("{" if i == 1 else "") + f'"{bucket}": ['))
        frame.append((i, 2, "]" + ("," if i < len(BUCKETS) else "}")))
    heads = spark.createDataFrame(frame, "b int, kind int, line string").withColumn("at", F.lit(None).cast(entries.schema["at"].dataType))
    lines = entries.select("b", "kind", "line", "at").unionByName(heads.select("b", "kind", "line", "at"))
    lines.orderBy("b", "kind", "at").select("line").coalesce(1).write.mode("overwrite").text(path)
