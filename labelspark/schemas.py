"""Schemas of the tables that travel between the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

APPLICATION_TEXT = [
    "beverage_type", "brand_name", "class_type", "alcohol_pct", "proof",
    "net_contents_ml", "bottler_name", "bottler_city", "bottler_state",
    "country_of_origin",
]
APPLICATION_FLAGS = [
    "imported", "sulfites_required", "fd_c_yellow_5_required", "carmine_required",
    "wood_treatment_required", "age_statement_required", "neutral_spirits_required",
]
# only on the entry form of the reference workflow, never in a submitted file
FORM_FLAGS = ["aspartame_required", "appellation_required", "varietal_required"]

APPLICATIONS = T.StructType(
    [T.StructField("label_id", T.StringType(), False)]
    + [T.StructField(c, T.StringType()) for c in APPLICATION_TEXT]
    + [T.StructField(c, T.BooleanType()) for c in APPLICATION_FLAGS]
    + [T.StructField("age_years", T.IntegerType())]
    + [T.StructField(c, T.BooleanType()) for c in FORM_FLAGS]
)

OCR_WORDS = T.StructType(
    [
        T.StructField("label_id", T.StringType(), False),
        T.StructField("pass_id", T.IntegerType()),
        T.StructField("word_no", T.IntegerType()),
        T.StructField("block_num", T.IntegerType()),
        T.StructField("par_num", T.IntegerType()),
        T.StructField("line_num", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("conf", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("top", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
    ]
)

LABEL_BLOCKS = T.StructType(
    [
        T.StructField("label_id", T.StringType(), False),
        T.StructField("block_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("x1", T.IntegerType()),
        T.StructField("y1", T.IntegerType()),
        T.StructField("x2", T.IntegerType()),
        T.StructField("y2", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

FIELDS = [
    "brand_name", "class_type", "alcohol_pct", "proof", "net_contents",
    "government_warning", "bottler", "country_of_origin",
]

RULE_RESULT = (
    "struct<rule_id:string,category:string,status:string,message:string,"
    "bbox_ref:array<int>,extracted_value:string,app_value:string,"
    "prefer_app_display:boolean>"
)
