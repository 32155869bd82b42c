"""Application records: submitted files and typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark import schemas
from labelspark.config import COLUMN_ALIASES
from labelspark.functions.numbers import to_double
from labelspark.functions.text import strip
from labelspark.sources.csv_records import read_csv

KNOWN = (
    {"label_id", "age_years", "youngest_age_years"}
    | set(schemas.APPLICATION_TEXT)
    | set(schemas.APPLICATION_FLAGS)
)


def canonical_name(header: str) -> str:
    """Record field a submitted header stands for; unknown headers are only cleaned."""
    h = header.strip().lower()
    for name in (h, h.replace(" ", "_")):
        if name in KNOWN:
            return name
        if name in COLUMN_ALIASES:
            return COLUMN_ALIASES[name]
    return h


def normalize_columns(df: DataFrame) -> DataFrame:
    """Rename submitted headers; of headers with one meaning, the first that is filled in counts."""
    same: dict[str, list[str]] = {}
    for c in df.columns:
        same.setdefault(canonical_name(c), []).append(c)
    return df.select(*[_first_filled(old).alias(new) for new, old in same.items()])


def _first_filled(names: list[str]) -> Column:
    columns = [F.col(f"`{n}`") for n in names]
    if len(columns) == 1:
        return columns[0]
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns], columns[0])


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    """CSV submission to typed applications. Everything is read as text: numbers keep
    the form they were written in. Quoted fields may hold line breaks, large files are split."""
    return type_applications(normalize_columns(read_csv(spark, path)))


def truthy(c: Column) -> Column:
    return F.lower(strip(c)).isin("1", "true", "yes", "y")


def beverage(c: Column) -> Column:
    b = F.lower(strip(c))
    return (
        F.when(F.contains(b, F.lit("wine")), "wine")
        .when(F.contains(b, F.lit("beer")) | F.contains(b, F.lit("malt")), "beer")
        .otherwise("spirits")
    )


def years(c: Column) -> Column:
    """Whole years as a positive number, otherwise 0."""
    n = F.floor(to_double(strip(c)))
    return F.coalesce(F.when(n > 0, n.try_cast("int")), F.lit(0))


def type_applications(df: DataFrame) -> DataFrame:
    """Text columns to the application schema; '' and false stand for absent."""
    have = set(df.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    age = F.when(strip(col("age_years")) != "", col("age_years")).otherwise(
        col("youngest_age_years")
    )
    # without an id column the first column is the id
    label_id = F.col("label_id" if "label_id" in have else df.columns[0])
    out = [strip(label_id).alias("label_id")]
    for name in schemas.APPLICATION_TEXT:
        value = beverage(col(name)) if name == "beverage_type" else strip(col(name))
        out.append(value.alias(name))
    out += [truthy(col(name)).alias(name) for name in schemas.APPLICATION_FLAGS]
    out.append(years(age).alias("age_years"))
    # flags of the entry form are carried when present
    out += [truthy(col(name)).alias(name) for name in schemas.FORM_FLAGS]
    return df.select(*out)
