import pytest
from pyspark.sql import functions as F

from labelspark.operators import decisions as D
from labelspark.operators import report as P
from labelspark.operators.match import match_files, missing_files
from labelspark.operators.score import score_table
from labelspark.operators.statements import find_passages, unknown_words, word_multiset
from labelspark.plans.queries import checked
from labelspark.plans.verify import batch_report
from labelspark.sources import store
from labelspark.sources.applications import (
    canonical_name, normalize_columns, read_applications, type_applications,
)
from labelspark.sources.files import index_files, list_files
from tests.conftest import DATA

CSV = """Label ID,Brand Name,Class Type,alcohol_pct,proof,Net Contents,bottler_name,bottler_city,bottler_state,imported,country_of_origin,beverage_type,Age Years
 test_1 ,ABC Distillery,Single Barrel Straight Rye Whisky,45,90,750 mL,ABC Distillery,Frederick,MD,false,,Distilled Spirits,4.5
test_2,"Malt & Hop, Brewery",Pale Ale,5,,24 fl oz,Malt & Hop Brewery,Hyattsville,MD,no,,Beer / Malt Beverage,
test_5,Downunder Winery,Red Wine,12,,750 mL,OZ Imports,,,YES,Australia,Wine,-3
"""


def test_submission_file(spark, tmp_path):
    (tmp_path / "batch.csv").write_text(CSV)
    rows = {r["label_id"]: r for r in read_applications(spark, str(tmp_path)).collect()}
    assert set(rows) == {"test_1", "test_2", "test_5"}
    assert [rows[k]["beverage_type"] for k in sorted(rows)] == ["spirits", "beer", "wine"]
    assert rows["test_1"]["proof"] == "90" and rows["test_2"]["proof"] == ""
    assert rows["test_2"]["brand_name"] == "Malt & Hop, Brewery"
    assert rows["test_5"]["imported"] is True and rows["test_1"]["imported"] is False
    assert [rows[k]["age_years"] for k in sorted(rows)] == [4, 0, 0]


def test_headers(spark):
    names = {
        "Label ID": "label_id", " net contents ML": "net_contents_ml",
        "FD&C Yellow 5": "fd_c_yellow_5_required", "Wood Treatment": "wood_treatment_required",
        "sulfites required": "sulfites_required", "Other": "other", "proof": "proof",
    }
    assert {h: canonical_name(h) for h in names} == names
    df = spark.createDataFrame([("x", "Gin")], ["first", "Class Type"])
    assert type_applications(normalize_columns(df)).first()["label_id"] == "x"


def test_file_match(spark, tmp_path):
    for name in ("A1.png", "b2.PNG", "sub.dir/C3.jpg", "c3.png", "D4"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    listed = list_files(spark, str(tmp_path))
    assert {r["file_key"] for r in listed.collect()} == {"A1", "b2", "C3", "c3", "D4"}
    files = index_files(spark.createDataFrame(
        [("z/a1.png", 0), ("z/A1.png", 1), ("z/A1.jpg", 2), ("z/b2.png", 3)],
        "path string, listing_no int"))
    apps = spark.createDataFrame([("A1",), ("B2",), ("C3",), ("A1",)], "label_id string")
    matched = sorted((r["label_id"], r["path"]) for r in match_files(apps, files).collect())
    assert matched == [("A1", "z/A1.png"), ("A1", "z/A1.png"), ("B2", "z/b2.png")]
    assert [r["label_id"] for r in missing_files(apps, files).collect()] == ["C3"]


def test_scoring(spark):
    rules = spark.createDataFrame(
        [("ok", "pass"), ("ok", None), ("bad", "pass"), ("bad", "FAIL"),
         ("look", "Needs_Review"), ("look", "odd")], "label_id string, status string")
    labels = spark.createDataFrame([("ok",), ("bad",), ("look",), ("none",)], "label_id string")
    found = {r["label_id"]: tuple(r)[1:] for r in score_table(labels, rules).collect()}
    assert found == {
        "ok": (2, 0, 0, "Ready to approve"), "bad": (1, 0, 1, "Critical issues"),
        "look": (1, 1, 0, "Needs review"), "none": (0, 0, 0, "Ready to approve"),
    }


def test_decisions(spark):
    log = spark.createDataFrame(
        [("a", 1, 1, "approve"), ("a", 2, 2, "undo"), ("b", 1, 3, "decline"),
         ("b", 1, 4, "approve"), ("c", 5, 5, "decline")],
        "label_id string, ts int, entry_no int, decision string")
    now = D.current_decisions(log)
    assert {(r["label_id"], r["decision"]) for r in now.collect()} == {
        ("b", "approve"), ("c", "decline")}
    report = spark.createDataFrame([("a",), ("b",)], "label_id string")
    assert {tuple(r) for r in D.overlay(report, now).collect()} == {("a", None), ("b", "approve")}
    held = spark.createDataFrame([("b", "under_review"), ("x", "approved")], "id string, bucket string")
    decided = now.select(F.col("label_id").alias("id"), D.bucket_of(F.col("decision")).alias("bucket"))
    moved = D.move_applications(held, decided)
    assert {tuple(r) for r in moved.collect()} == {
        ("b", "approved"), ("c", "rejected"), ("x", "approved")}
    assert {tuple(r) for r in D.bucket_counts(moved).collect()} == {("approved", 2), ("rejected", 1)}


def test_store_round_trip(spark, tmp_path):
    entries = spark.createDataFrame(
        [("1", "A", "Gin", "Needs review", "{}", bytearray(b"\x00\xff"), "{}", "approved"),
         ("2", "B", "Rum", "Ready to approve", "{}", None, "{}", "rejected")], store.STORE_SCHEMA)
    store.write_store(entries, str(tmp_path / "store"))
    back = {r["id"]: r for r in store.read_store(spark, str(tmp_path / "store")).collect()}
    assert back["1"]["image_bytes"] == b"\x00\xff" and back["2"]["bucket"] == "rejected"
    store.export_json(entries, str(tmp_path / "json"))
    again = {r["id"]: r for r in store.import_json(spark, str(tmp_path / "json")).collect()}
    assert again["1"]["image_bytes"] == b"\x00\xff" and again["2"]["image_bytes"] == b""
    assert store.read_store(spark, str(tmp_path / "absent")).count() == 0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.json").write_text("{not json\n")
    assert store.import_json(spark, str(bad)).count() == 0


def test_passages_against_brute_force(spark):
    texts = ["one two three four five six seven", "zone two three four five sixty", "a b",
             "xa bx one", "", "ab c one two  three four five six", "é one two three four five six é"]
    passages = ["one two three four five six", "two three", "a b", "x", "five six seven", "nope", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id int, text string")
    expected = {(d, i) for d, t in enumerate(texts) for i, p in enumerate(passages) if p and p in t}
    assert {tuple(r) for r in find_passages(docs, items).collect()} == expected


def test_unknown_words(spark):
    docs = spark.createDataFrame([(1, "Gin gin 42 x QZ"), (2, "qz rum")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("GIN",), ("RUM",)], "word string")
    found = unknown_words(word_multiset(docs, "doc_id", "text"), lexicon)
    assert {(r["doc_id"], r["word"], r["n"]) for r in found.collect()} == {
        (1, "QZ", 1), (2, "QZ", 1)}


@pytest.fixture(scope="module")
def verified(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("checked"))
    checked(spark, DATA).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_counts_agree_with_results_and_status(verified):
    wrong = verified.filter(
        (F.size("results") != F.col("pass_count") + F.col("review_count") + F.col("fail_count"))
        | (
            F.col("overall_status")
            != F.when(F.col("fail_count") > 0, "Critical issues")
            .when(F.col("review_count") > 0, "Needs review").otherwise("Ready to approve")
        )
    )
    assert verified.count() == 200 and wrong.count() == 0


def test_matrix_order_and_conditions(verified):
    rows = P.result_matrix(verified).join(
        verified.select("label_id", "imported", "beverage_type"), "label_id").collect()
    assert all(r["imported"] for r in rows if r["criterion"] == "Country of Origin")
    assert all(r["beverage_type"] == "spirits" for r in rows if r["criterion"] == "Proof")
    wording = [r for r in rows if r["criterion"] == "Government Warning Wording"]
    assert len(wording) == 200 and all(len(r["application"]) > 80 for r in wording)
    assert all(len(r["label"]) <= 80 for r in rows if r not in wording)


def test_failed_rows_and_filters(verified):
    rows = batch_report(verified.withColumn(
        "error", F.when(F.col("label_id") == "L1", "unreadable")))
    failed = rows.filter("label_id = 'L1'").first()
    assert (failed["overall_status"], failed["fail_count"]) == ("Critical issues", 1)
    assert P.filter_status(rows).count() == 200
    statuses = P.filter_status(rows, "Needs review").select("overall_status").distinct()
    assert [r[0] for r in statuses.collect()] == ["Needs review"]
    assert sum(r["labels"] for r in P.batch_totals(rows).collect()) == 200


def test_unread_labels_are_critical_without_failures(verified):
    rows = batch_report(verified.withColumn("ocr_error", F.when(F.col("label_id") == "L1", "no reader")))
    one = rows.filter("label_id = 'L1'").first()
    assert (one["overall_status"], one["fail_count"], one["error"]) == ("Critical issues", 0, None)
    assert rows.filter("label_id <> 'L1'").exceptAll(batch_report(verified).filter("label_id <> 'L1'")).isEmpty()


def test_store_survives_reading_and_writing_one_path(spark, tmp_path):
    from labelspark.operators.decisions import move_applications
    from labelspark.sources.store import STORE_SCHEMA, read_store, write_store

    path = str(tmp_path / "store")
    rows = [("L1", "Old Tom", "Gin", "ok", "{}", None, "{}", "under_review"), ("L2", "B", "C", "ok", "{}", None, "{}", "under_review")]
    write_store(spark.createDataFrame(rows, STORE_SCHEMA), path)
    for bucket in ("approved", "rejected"):
        decided = spark.createDataFrame([("L1", bucket), ("L3", bucket)], "id string, bucket string")
        write_store(move_applications(read_store(spark, path), decided), path)
    after = {r.id: (r.brand_name, r.bucket) for r in read_store(spark, path).collect()}
    assert after == {"L1": ("Old Tom", "rejected"), "L2": ("B", "under_review"), "L3": (None, "rejected")}


def test_csv_fields_may_hold_line_breaks(spark, tmp_path):
    from labelspark.sources.applications import read_applications

    (tmp_path / "in.csv").write_text('label_id,brand_name,class_type\nA,"Old\nTom",Gin\n')
    rows = read_applications(spark, str(tmp_path / "in.csv")).collect()
    assert [(r.label_id, r.brand_name) for r in rows] == [("A", "Old\nTom")]


def test_unreadable_export_lines_are_rejects(spark, tmp_path):
    from labelspark.sources.store import import_json, import_rejects

    folder = tmp_path / "bucket=approved"
    folder.mkdir()
    (folder / "a.json").write_text('{"id": "L1", "image_bytes": ""}\n{"id": broken\n')
    assert [r.id for r in import_json(spark, str(tmp_path)).collect()] == ["L1"]
    assert [r.unreadable for r in import_rejects(spark, str(tmp_path)).collect()] == ['{"id": broken']


def test_key_filters_pass_below_the_rules(spark):
    from labelspark.plans.queries import QUERIES

    plan = QUERIES["verify_labels"](spark, "/root/testdata/sf0.001").where("label_id = 'L7'")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in text.split("Generate", 1)[1] and "L7" in text.split("Generate", 1)[1]


def lcs_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a and b else 0.0


def test_block_queries_read_every_block(spark):
    from labelspark.plans import fixtures as T
    from labelspark.plans.queries import QUERIES

    blocks = {(r["label_id"], r["pass_id"], r["line_no"]): r["text"] for r in T.label_blocks(spark, DATA).collect()}
    apps = {r["k"]: r for r in T.submitted(spark, DATA).collect()}
    assert {p for _, p, _ in blocks} == {0, 1} and len({n for *_, n in blocks}) == 9

    parsed = {(r["label_id"], r["pass_id"], r["line_no"]): r for r in QUERIES["block_contents"](spark, DATA).collect()}
    assert parsed.keys() == blocks.keys()
    assert all(parsed[i]["digits"] == t.translate(str.maketrans("OoIlSB", "001158")) for i, t in blocks.items())
    assert all((r["label_ml"] is not None) == (n == 4) for (*_, n), r in parsed.items())
    narrow = {r["label_id"]: r for r in QUERIES["parsed_contents"](spark, DATA).collect()}
    names = ("label_ml", "app_ml", "abv", "digits")
    assert all([r[c] for c in names] == [narrow[i][c] for c in names] for (i, _, n), r in parsed.items() if n == 4)

    met = {(r["label_id"], r["pass_id"], r["line_no"]): r for r in QUERIES["block_similarity"](spark, DATA).collect()}
    want = {
        (apps[k]["label_id"], p, n): round(lcs_ratio(apps[k]["brand_name"].lower(), t.lower()), 6)
        for (i, p, n), t in blocks.items() if (k := int(i[1:]) - 1) in apps
    }
    assert {i: r["ratio"] for i, r in met.items()} == pytest.approx(want, abs=2e-6)
    slim = {r["label_id"]: r for r in QUERIES["name_similarity"](spark, DATA).collect()}
    assert all(tuple(met[i, 0, 1][c] for c in ("ratio", "score", "reason")) == tuple(r[c] for c in ("ratio", "score", "reason")) for i, r in slim.items())
