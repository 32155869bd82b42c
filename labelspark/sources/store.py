"""Application store, as a log of commits that is merged on read, and batch report sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from labelspark.operators.score import CRITICAL, READY, REVIEW
from labelspark.sources.commits import commit, commits, missing, version

STATUSES = [READY, REVIEW, CRITICAL]
BUCKETS = ["under_review", "approved", "rejected"]
STORE_SCHEMA = (
    "id string, brand_name string, class_type string, overall_status string, "
    "app_data string, image_bytes binary, result string, bucket string"
)

PAYLOAD = ["brand_name", "class_type", "overall_status", "app_data", "image_bytes", "result"]
_PAYLOAD_TYPE = (
    "struct<brand_name:string,class_type:string,overall_status:string,app_data:string,image_bytes:binary,result:string>"
)
_LOG_SCHEMA = f"id string, payload {_PAYLOAD_TYPE}, bucket string, seq long"


def entries(checked: DataFrame, bucket: str = "under_review") -> DataFrame:
    """Store entries of checked labels; application and result travel as JSON."""
    app = [c for c in checked.columns if c.endswith("_app")] + [
        c for c in ("beverage_type", "net_contents_ml", "bottler_name", "bottler_city",
                    "bottler_state", "imported") if c in checked.columns
    ]
    image = F.col("image_bytes") if "image_bytes" in checked.columns else F.lit(None)
    return checked.select(
        F.col("label_id").alias("id"),
        F.col("brand_name_app").alias("brand_name"),
        F.col("class_type_app").alias("class_type"),
        "overall_status",
        F.to_json(F.struct(*[F.col(c).alias(c.removesuffix("_app")) for c in app])).alias(
            "app_data"
        ),
        image.cast("binary").alias("image_bytes"),
        F.to_json(F.struct("results", "pass_count", "review_count", "fail_count")).alias(
            "result"
        ),
        F.lit(bucket).alias("bucket"),
    )


def log_rows(rows: DataFrame, order: str | None = None) -> DataFrame:
    """Entries, or decisions (id, bucket), as rows of the log.

    Columns of an entry that `rows` lacks altogether mean that the entry stays as it is. Rows of
    one commit follow each other by the column `order`, else as they come.
    """
    given = [c for c in PAYLOAD if c in rows.columns]
    payload = F.struct(*[F.col(c) if c in given else F.lit(None).alias(c) for c in PAYLOAD]).cast(_PAYLOAD_TYPE)
    return rows.select(
        F.col("id").cast("string").alias("id"),
        (payload if given else F.lit(None).cast(_PAYLOAD_TYPE)).alias("payload"),
        F.col("bucket").cast("string").alias("bucket"),
        (F.col(order).cast("long") if order else F.monotonically_increasing_id()).alias("seq"),
    )


def merged(log: DataFrame) -> DataFrame:
    """State of a log (id, payload, bucket, number, seq): each id's last bucket and last payload.

    An aggregate without a sort, reduced on the map side, so an id with a very long history is
    no single task's work. Of equal places in the log, the bucket that sorts last counts.
    """
    place = "struct(number, seq, bucket)"
    state = log.groupBy("id").agg(
        F.expr(f"max_by(bucket, {place}) FILTER (WHERE bucket IS NOT NULL)").alias("bucket"),
        F.expr(f"max_by(payload, {place}) FILTER (WHERE payload IS NOT NULL)").alias("payload"),
    )
    return state.select("id", *[F.col(f"payload.{c}").alias(c) for c in PAYLOAD], "bucket")


def append_entries(store: DataFrame, path: str) -> int:
    """Add entries, or new contents of known ones, as one commit; its number."""
    return commit(log_rows(store), path, "log")


def decide(decided: DataFrame, path: str, order: str | None = None) -> int:
    """Add decisions (id, bucket and, if the entries changed, their columns) as one commit.

    Only the decisions are written. Writers need not know of each other: the log holds the
    decisions of both, and the later commit counts for an id that both decided.
    """
    return commit(log_rows(decided, order), path, "log")


def write_store(store: DataFrame, path: str, read_at: int | None = None) -> int:
    """Write whole entries, newer than all before; ids that ``store`` lacks stay.

    ``store`` may be read from the same path. It carries the buckets that its reader saw: with
    ``read_at``, the version it was read at, a store that has changed since is left alone and
    `CommitConflict` raised. Writers of decisions use `decide`, which never conflicts.
    """
    return commit(log_rows(store), path, "log", read_at=read_at)


def compact(spark: SparkSession, path: str) -> int:
    """Write the present state as a snapshot, from which later reads start; the log stays."""
    at = version(spark, path)
    state = read_store(spark, path, at)
    return commit(log_rows(state), path, "snapshot", upto=at)


def read_store(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The state after the last commit, or after commit number ``at``; empty where none is.

    Reads the newest snapshot and the commits after the one it was made of, and merges them.
    """
    known = commits(spark, path, at)
    start = max(((upto, number) for number, kind, _, upto in known if kind == "snapshot"), default=(0, 0))
    read = [
        (folder, start[0] if kind == "snapshot" else number) for number, kind, folder, _ in known
        if (number == start[1] if kind == "snapshot" else number > start[0])
    ]
    if not read:
        return spark.createDataFrame([], STORE_SCHEMA)
    files = spark.read.schema(_LOG_SCHEMA).parquet(*[f"{path}/{folder}" for folder, _ in read])
    named = files.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), "/(data-[0-9a-f]{32})/", 1))
    numbers = spark.createDataFrame(read, "folder string, number long")
    return merged(named.join(F.broadcast(numbers), "folder").drop("folder"))


def to_json_form(store: DataFrame) -> DataFrame:
    """Image bytes as base64 text, null as ''."""
    return store.withColumn(
        "image_bytes", F.coalesce(F.base64("image_bytes"), F.lit(""))
    )


def from_json_form(exported: DataFrame) -> DataFrame:
    return exported.withColumn("image_bytes", F.unbase64("image_bytes"))


def export_json(store: DataFrame, path: str) -> None:
    to_json_form(store).write.mode("overwrite").partitionBy("bucket").json(path)


def _exported(spark: SparkSession, path: str) -> DataFrame | None:
    text_form = STORE_SCHEMA.replace("image_bytes binary", "image_bytes string")
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if missing(e):
            return None
        raise
    entry = F.from_json("value", f"{text_form}, unreadable string", {"columnNameOfCorruptRecord": "unreadable"})
    parsed = lines.where("trim(value) <> ''").withColumn("e", entry)
    if "bucket" in lines.columns:  # the export's folders name it
        parsed = parsed.withColumn("e", F.col("e").withField("bucket", F.col("bucket").cast("string")))
    return parsed.select("e.*")


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """Exported store; a missing path gives no entries. See `import_rejects` for other lines."""
    raw = _exported(spark, path)
    if raw is None:
        return spark.createDataFrame([], STORE_SCHEMA)
    return from_json_form(raw.where("unreadable is null").drop("unreadable"))


def import_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an export that are no entries: bucket and the line."""
    raw = _exported(spark, path)
    if raw is None:
        return spark.createDataFrame([], "bucket string, unreadable string")
    return raw.where("unreadable is not null").select("bucket", "unreadable")


def observed_totals(report: DataFrame, totals: Observation) -> DataFrame:
    """The report, which tells `totals` its rows and failed rules by status as it is written."""
    told = [F.count(F.lit(1)).alias("labels"), F.coalesce(F.sum("fail_count"), F.lit(0)).alias("failed_rules")]
    for status in STATUSES:
        of = F.col("overall_status") == status
        told.append(F.count_if(of).alias(f"{status}: labels"))
        told.append(F.coalesce(F.sum(F.when(of, F.col("fail_count"))), F.lit(0)).alias(f"{status}: failed_rules"))
    return report.observe(totals, *told)


def write_report(report: DataFrame, path: str, form: str = "parquet") -> dict[str, int]:
    """Write the report; its totals, counted in the pass that writes it."""
    totals = Observation()
    writer = observed_totals(report, totals).write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(form).save(path)
    return totals.get


def write_by_label(df: DataFrame, table: str, buckets: int) -> None:
    """Save a table bucketed and sorted by label_id.

    Blocks and applications saved with one number of buckets are verified without an exchange.
    Rows are dealt by label first, so each bucket is one file.
    """
    df.repartition(buckets, "label_id").write.mode("overwrite").bucketBy(buckets, "label_id").sortBy("label_id").saveAsTable(table)
