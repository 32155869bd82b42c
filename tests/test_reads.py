"""A query for some fields gathers the blocks with the tests of those fields only."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from labelspark import schemas
from labelspark.config import DEFAULT
from labelspark.operators import extract as E
from labelspark.operators import rules as R
from labelspark.plans.queries import QUERIES
from labelspark.plans.verify import join_labels, without_unread
from tests.layouts import block_rows

SMALL = "/root/testdata/sf0.001"
BY_ANCHOR = replace(DEFAULT, required_statement="")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def blocks(spark):
    rows = spark.createDataFrame(block_rows(), schemas.LABEL_BLOCKS)
    # a label whose blocks share place and number, in which the text decides
    same = rows.where("label_id = 'two_panel'").withColumns(
        {"label_id": F.lit("same"), "block_id": F.lit(7).cast("bigint"), "x1": F.lit(1), "y1": F.lit(1), "x2": F.lit(90), "y2": F.lit(20)}
    )
    return rows.unionByName(same.select(rows.columns)).localCheckpoint()


@pytest.mark.parametrize("cfg", [DEFAULT, BY_ANCHOR])
def test_a_field_alone_is_the_field_of_all(spark, blocks, cfg):
    whole = {r.label_id: r for r in E.extract_fields(blocks, cfg).collect()}
    assert len(whole) > 20
    for names in [(f,) for f in E.READS] + [()]:
        some = E.extract_fields(blocks, cfg, names).collect()
        assert len(some) == len(whole)
        for r in some:
            assert r.asDict() == {c: whole[r.label_id][c] for c in r.asDict()}


@pytest.mark.parametrize("name, without", [
    ("field_bottler", ["warning_pos", "warning_text", "abv_loose", "suffix"]),
    ("field_brand_name", ["warning_pos", "warning_text", "abv_loose", "bottler_end"]),
    ("field_alcohol_pct", ["warning_pos", "warning_text", "suffix", "bottler_end"]),
    ("field_warning_by_anchor", ["warning_pos", "warning_text", "abv_loose", "suffix"]),
    ("rules_other", ["warning_pos", "warning_text", "abv_loose", "suffix"]),
])
def test_tests_of_other_fields_are_not_gathered(spark, name, without):
    plan = optimized(QUERIES[name](spark, SMALL))
    assert [c for c in without if c in plan] == []


def test_rules_read_what_they_are_said_to(spark, blocks):
    apps = [{"label_id": i, "class_type": "Straight Rye Whiskey", "beverage_type": "Distilled Spirits", "brand_name": "X"} for i in ("one_line", "two_panel", "none")]
    apps = spark.createDataFrame(apps, schemas.APPLICATIONS)
    whole = E.with_brand(join_labels(apps, E.extract_fields(blocks)), F.col("brand_name_app"))
    category = "Other"
    some = without_unread(join_labels(apps, E.extract_fields(blocks, fields=R.READS[category])))
    rows = [R.explode_results(R.run_rules(m, categories=(category,))).orderBy("label_id", "rule_seq").collect() for m in (whole, some)]
    assert rows[0] and rows[0] == rows[1]
    with pytest.raises(Exception, match="was not extracted"):
        R.run_rules(some, categories=("Origin",)).collect()
