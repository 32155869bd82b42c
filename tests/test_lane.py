"""Rows that cannot be read, whole batch rows, totals told while writing, and the bucketed layout."""

import json

import pytest

from labelspark import schemas
from labelspark.plans import fixtures as T
from labelspark.plans.queries import applications, checked, kept_blocks
from labelspark.plans.verify import batch_report, batch_rows, verify_blocks, verify_rows
from labelspark.sources.store import observed_totals, write_by_label, write_report
from labelspark.sources.words import read_raw_words, typed_words, word_errors

DATA = "/root/testdata/sf0.001"


def raw(spark, rows):
    names = schemas.OCR_WORDS.names + ["unreadable"]
    return spark.createDataFrame([{c: r.get(c) for c in names} for r in rows], ", ".join(f"`{c}` string" for c in names))


WORD = dict(label_id="A", pass_id="0", word_no="1", block_num="1", par_num="1", line_num="1", text="GIN", conf="90.5", left="1", top="2", width="30", height="9")


@pytest.mark.parametrize("change, error", [
    ({}, None), ({"conf": None}, None), ({"conf": ""}, None), ({"left": " 7 "}, None), ({"conf": "high"}, "word 1: conf is not a number"),
    ({"left": "1x"}, "word 1: left is not a number"), ({"top": None}, "word 1: top is missing"), ({"width": "-3"}, "word 1: width is negative"),
    ({"unreadable": "{"}, "unreadable line"), ({"word_no": "?!", "left": "1"}, "word ?!: word_no is not a number"), ({"text": None}, None),
    ({"left": "99999999999"}, "word 1: left is not a number"),
])
def test_errors_of_rows(spark, change, error):
    assert typed_words(raw(spark, [{**WORD, **change}])).first().error == error


def test_types_and_first_error_of_a_label(spark):
    typed = typed_words(raw(spark, [WORD, {**WORD, "left": "b"}, {**WORD, "width": ""}, {"unreadable": "x"}, {**WORD, "label_id": "B"}]))
    assert typed.drop("error").schema.simpleString() == schemas.OCR_WORDS.simpleString()
    assert {(r.label_id, r.error, r.bad_words) for r in word_errors(typed).collect()} == {
        ("A", "word 1: left is not a number", 2), (None, "unreadable line", 1)}


def test_lines_that_are_no_objects_stay_as_rows(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({**WORD, "left": 5}) + "\n{broken\n" + json.dumps({"label_id": "B"}) + "\n")
    typed = typed_words(read_raw_words(spark, str(tmp_path))).collect()
    assert sorted((r.label_id or "", r.left or 0, r.error or "") for r in typed) == [
        ("", 0, "unreadable line"), ("A", 5, ""), ("B", 0, "word ?: left is missing")]


def test_a_broken_row_fails_its_label_only(spark):
    words = T.ocr_words(spark, DATA).selectExpr(*[f"cast({c} as string) as {c}" for c in schemas.OCR_WORDS.names])
    apps = applications(spark, DATA).where("cast(substring(label_id, 2) as int) < 40")
    words = words.join(apps.select("label_id"), "label_id")
    broken = words.selectExpr(*[
        "if(label_id = 'L7' and word_no = 1 and line_num = 2, 'wide', width) as width" if c == "width" else c for c in words.columns
    ])
    whole = {r.label_id: r for r in batch_report(verify_rows(apps, words)).collect()}
    got = {r.label_id: r for r in batch_report(verify_rows(apps, broken)).collect()}
    assert (got["L7"].overall_status, got["L7"].fail_count, got["L7"].error) == ("Critical issues", 1, "word 1: width is not a number")
    assert {k: v for k, v in got.items() if k != "L7"} == {k: v for k, v in whole.items() if k != "L7"} and len(got) == 40


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("done"))
    checked(spark, DATA).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_batch_rows_have_all_columns(spark, done):
    from pyspark.sql import functions as F

    rows = batch_rows(done.withColumn("error", F.when(F.col("label_id") == "L1", "unread")))
    assert rows.columns == ["label_id", "overall_status", "fail_count", "brand_name", "class_type", "error", "result", "app_data"]
    by_id = {r.label_id: r for r in rows.collect()}
    assert by_id["L1"].result is None and json.loads(by_id["L1"].app_data)["brand_name"] == by_id["L1"].brand_name
    one = json.loads(by_id["L2"].result)
    assert one["overall_status"] == by_id["L2"].overall_status and one["counts"]["fail_count"] == by_id["L2"].fail_count
    assert len(one["results"]) == sum(one["counts"].values())
    assert {"alcohol_pct", "bottler_city", "imported", "age_years"} <= json.loads(by_id["L2"].app_data).keys()


def test_report_and_totals_are_one_job(spark, done, tmp_path):
    report = batch_report(done)
    sc = spark.sparkContext
    sc.setJobGroup("write-report", "report")
    totals = write_report(report, str(tmp_path / "r"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("write-report")) == 1
    rows = spark.read.parquet(str(tmp_path / "r")).collect()
    assert totals["labels"] == len(rows) == 200 and totals["failed_rules"] == sum(r.fail_count for r in rows)
    for status in ("Ready to approve", "Needs review", "Critical issues"):
        some = [r.fail_count for r in rows if r.overall_status == status]
        assert (totals[f"{status}: labels"], totals[f"{status}: failed_rules"]) == (len(some), sum(some))
    assert write_report(report.limit(0), str(tmp_path / "none"), "csv")["labels"] == 0


def test_bucketed_tables_are_verified_without_an_exchange(spark):
    names = {"blocks_by_label": kept_blocks(spark, DATA), "applications_by_label": applications(spark, DATA)}
    try:
        for name, df in names.items():
            write_by_label(df, name, 4)
        apps, blocks = spark.table("applications_by_label"), spark.table("blocks_by_label")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        result = verify_blocks(apps, blocks).select("label_id", "overall_status", "fail_count")
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = verify_blocks(names["applications_by_label"], names["blocks_by_label"]).select("label_id", "overall_status", "fail_count")
        assert sorted(map(tuple, result.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"drop table if exists {name}")
