from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from labelspark import schemas
from labelspark.config import DEFAULT
from labelspark.operators.extract import extract_fields, with_brand
from tests.layouts import block_rows


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame(block_rows(), schemas.LABEL_BLOCKS)


@pytest.fixture(scope="module")
def fields(blocks):
    return {r["label_id"]: r for r in with_brand(extract_fields(blocks)).collect()}


@pytest.mark.parametrize(
    "label, field, value",
    [
        ("one_line", "brand_name", "OLD TOM DISTILLERY"),
        ("one_line", "class_type", "Kentucky Straight Bourbon Whiskey"),
        ("one_line", "alcohol_pct", "45"),
        ("one_line", "proof", "90"),
        ("one_line", "net_contents", "750 mL"),
        ("one_line", "government_warning",
         "GOVERNMENT WARNING: According to the Surgeon General..."),
        ("one_line", "bottler", "Bottled by Old Tom Distillery, Louisville, KY"),
        ("one_line", "country_of_origin", ""),
        ("two_panel", "brand_name", "ABC DISTILLERY"),
        ("two_panel", "alcohol_pct", "45"),
        ("two_panel", "net_contents", "750 mL"),
        ("split_abv", "alcohol_pct", "45"),
        ("split_abv", "net_contents", "750 mL"),
        ("split_abv", "brand_name", "BRAND X"),
        ("compound_net", "net_contents", "24 fl oz"),
        ("compound_net", "brand_name", "MALT & HOP BREWERY"),
        ("over_collection", "class_type", "RED WINE"),
        ("over_collection", "bottler", "IMPORTED BY OZ IMPORTS"),
        ("over_collection", "country_of_origin", "Australia"),
        ("barleywine", "class_type", "Barleywine Ale"),
        ("barleywine", "net_contents", "12 fl oz"),
        ("barleywine", "bottler", "BREWED & BOTTLED BY: Tiger Brewing, Portland, OR"),
        ("prominence", "brand_name", "BIG BRAND"),
        ("abv_qualified_wins", "alcohol_pct", "5"),
        ("abv_by_vol", "alcohol_pct", "12"),
        ("abv_loose", "alcohol_pct", "40"),
        ("abv_not_share", "alcohol_pct", "13"),
        ("net_quart", "net_contents", "1 qt"),
        ("net_ounces", "net_contents", "12 fl oz"),
        ("class_before_bottler", "class_type", "PALE ALE"),
        ("brand_winery", "brand_name", "ABC WINERY"),
        ("brand_inc", "brand_name", "ACME"),
        ("brand_bare_suffix", "brand_name", "RIVER BEND"),
        ("brand_trailing", "brand_name", "ABC DISTILLERY"),
        ("brand_brewing_co", "brand_name", "TIGER BREWING"),
        ("country_product", "country_of_origin", "Scotland"),
        ("country_made", "country_of_origin", "France"),
        ("country_imported", "country_of_origin", "Japan"),
        ("country_produce", "country_of_origin", "Italy"),
        ("country_wine", "country_of_origin", "Chile"),
        ("country_alone", "country_of_origin", "Scotland"),
        ("country_long_text", "country_of_origin", ""),
        ("address_fallback", "bottler", "FINE GOODS Blue Hill Winery, Salem, OR"),
        ("seal_fallback", "bottler", "WOODFORD DSP KY-52 SERIES"),
        ("side_panel", "government_warning",
         "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink "
         "alcoholic beverages during pregnancy because of the risk of birth defects. (2) "
         "Consumption of alcoholic beverages impairs your ability to drive a car or operate "
         "machinery, and may cause health problems."),
    ],
)
def test_field(fields, label, field, value):
    assert fields[label][field]["value"] == value


def test_two_panel_spans(fields):
    row = fields["two_panel"]
    assert row["class_type"]["value"].upper().startswith("SINGLE BARREL") or (
        "STRAIGHT RYE" in row["class_type"]["value"]
    )
    assert "Surgeon General" in row["government_warning"]["value"]
    assert row["government_warning"]["bbox"] == [300, 120, 490, 320]
    assert row["bottler"]["value"].startswith("DISTILLED AND BOTTLED BY: ")
    assert row["bottler"]["bbox"][3] > row["bottler"]["bbox"][1]


def test_split_abv_box_is_first_part(fields):
    assert fields["split_abv"]["alcohol_pct"]["bbox"] == [10, 100, 40, 120]


def test_all_text_keeps_input_order(fields):
    assert fields["split_abv"]["all_text"].startswith("BRAND X Vodka 45 % ALC/VOL 750 mL")


def test_brand_closest_to_application(blocks):
    labels = extract_fields(blocks).filter("label_id = 'two_panel'")
    row = with_brand(labels, F.lit("abc distillery")).first()
    assert row["brand_name"]["value"] == "ABC DISTILLERY"


def test_anchor_walk_without_required_wording(blocks):
    rows = extract_fields(blocks, replace(DEFAULT, required_statement="")).collect()
    found = {r["label_id"]: r["government_warning"]["value"] for r in rows}
    assert found["two_panel"].startswith("GOVERNMENT WARNING: (1) According to the Surgeon")
    assert found["two_panel"].endswith("cause health problems.")
    assert found["barleywine"] == "GOVERNMENT WARNING: According to the Surgeon General..."
    assert found["prominence"] == ""
    # the statement keeps to its column and stops at the second serving line
    assert "Serving" not in found["side_panel"]
