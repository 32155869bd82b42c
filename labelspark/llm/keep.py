"""Keeping some rows of a table by verdicts that an operator gave on its rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.bitset import build_filter, may_hold
from labelspark.llm.stored import stored
from labelspark.llm.tasks import send_code


def raw_sha256(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    verdicts: doc_id, raw_sha256 and kept of each row of `docs`, in any order. Rows that agree
    in doc_id and text are alike to it: as many of them stay as have `kept`.

    A filter of bounded size tells where the rows are read which of them may have to go; only
    these travel to the exact join, the others stay where they are.
    """
    key = F.struct(F.col("doc_id").cast("long"), F.col("raw_sha256"))
    lost = stored(
        verdicts.groupBy(F.xxhash64(key).alias("_h"), F.col("doc_id").alias("_id"), F.col("raw_sha256").alias("_raw"))
        .agg(F.count("*").alias("_n"), F.sum(F.col("kept").cast("long")).alias("_stay")).where("_stay < _n")
    )
    sc = docs.sparkSession.sparkContext
    send_code(sc)
    ids = lost.select(F.xxhash64(F.col("_id").cast("long")).alias("h"))
    bits = sc.broadcast(build_filter(ids, "h", lost.count()))

    @F.pandas_udf("boolean")
    def may_go(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bits.value, h.to_numpy().view(np.uint64)))

    # whole rows travel as one column, so no name of theirs meets one of these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    asked = may_go(F.xxhash64(F.col("_row.doc_id").cast("long")))
    some = rows.where(asked)
    same = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (raw_sha256("_row.text") == F.col("_raw"))
    stay = rows.where(~asked).unionByName(some.join(lost.select("_id", "_raw"), same, "left_anti"))
    if not lost.where("_stay > 0").isEmpty():
        some = some.join(lost.where("_stay > 0").select("_id", "_raw", "_stay"), same)
        place = F.row_number().over(Window.partitionBy("_id", "_raw").orderBy(F.to_json("_row")))
        stay = stay.unionByName(some.withColumn("_place", place).where("_place <= _stay").select("_row"))
    return stay.select("_row.*")
