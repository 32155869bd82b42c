import pytest

from labelspark import schemas
from labelspark.plans.verify import verify_blocks
from labelspark.sources.applications import type_applications
from tests.layouts import LAYOUTS, WARNING_LINES, block_rows, lines

APPS = [
    ("one_line", "spirits", "OLD TOM DISTILLERY", "Kentucky Straight Bourbon Whiskey", "45", "90",
     "750", "Old Tom Distillery", "Louisville", "KY"),
    ("two_panel", "spirits", "ABC", "Straight Rye Whisky", "45", "", "750", "ABC Distillery",
     "Frederick", "MD"),
    ("odd_word", "spirits", "ABC DISTILLERY", "Gin", "45", "", "750 mL", "ABC Distillery", "", ""),
    ("no_blocks", "beer", "X", "Ale", "", "", "", "", "", ""),
]
ODD = lines("ABC DISTILLERY", "Gin", "45% ALC/VOL", "750 mL",
            "GOVERNMENT WARNING: " + " ".join(WARNING_LINES).replace("birth", "qzx birth"))


@pytest.fixture(scope="module")
def outcome(spark):
    rows = block_rows() + [("odd_word", i, *b, 90.0 - i) for i, b in enumerate(ODD)]
    blocks = spark.createDataFrame(rows, schemas.LABEL_BLOCKS)
    names = ["label_id", "beverage_type", "brand_name", "class_type", "alcohol_pct", "proof",
             "net_contents_ml", "bottler_name", "bottler_city", "bottler_state"]
    apps = type_applications(spark.createDataFrame(APPS, names))
    lexicon = spark.createDataFrame([("PALE",)], "word string")
    found = verify_blocks(apps, blocks, lexicon=lexicon).collect()
    return {r["label_id"]: (r, {x["rule_id"]: x for x in r["results"]}) for r in found}


def test_every_application_is_checked(outcome):
    assert set(outcome) == {a[0] for a in APPS} and len(LAYOUTS) > 20


def test_matching_label(outcome):
    row, rules = outcome["one_line"]
    assert rules["Brand name matches"]["status"] == "pass"
    assert rules["Class/type matches"]["message"] == "Class/type matches (exact)."
    assert rules["Proof/ABV consistency"]["status"] == "pass"
    assert rules["Bottler address"]["status"] == "pass"
    assert rules["Age statement"]["status"] == "fail"
    assert row["overall_status"] == "Critical issues"


def test_two_panels(outcome):
    _, rules = outcome["two_panel"]
    assert rules["Brand name matches"]["message"] == "Brand name matches (token_containment)."
    assert rules["Class/type matches"]["status"] == "pass"
    assert rules["Exact warning wording"]["status"] == "pass"
    assert rules["Bottler/producer statement"]["status"] == "pass"


def test_suspicious_word_is_dropped(outcome):
    _, rules = outcome["odd_word"]
    wording = rules["Exact warning wording"]
    assert wording["status"] == "pass"
    assert "qzx" not in wording["extracted_value"]


def test_label_without_blocks(outcome):
    row, rules = outcome["no_blocks"]
    assert rules["Brand name present"]["status"] == "fail"
    assert rules["Alcohol content present"]["status"] == "pass"
    assert rules["Government warning present"]["status"] == "fail"
    assert row["overall_status"] == "Critical issues"
