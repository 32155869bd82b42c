import json

import pytest
from pyspark.sql import functions as F

from labelspark import schemas
from labelspark.operators.extract import FIELD
from labelspark.operators.rules import as_application_side, explode_results, run_rules

BASE = {
    "brand_name": "TestBrand", "class_type": "Vodka", "alcohol_pct": "40", "proof": "",
    "net_contents": "750 mL", "government_warning": "GOVERNMENT WARNING: (1) test",
    "bottler": "Bottled by TestCo", "country_of_origin": "",
}
TEXT = "TestBrand Vodka 40% 750 mL GOVERNMENT WARNING: (1) test Bottled by TestCo"
FULL = (
    "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink "
    "alcoholic beverages during pregnancy because of the risk of birth defects. (2) "
    "Consumption of alcoholic beverages impairs your ability to drive a car or operate "
    "machinery, and may cause health problems."
)

# name: (application, label fields that differ from BASE, full label text)
CASES = {
    "beer_abv_optional": (
        dict(beverage_type="beer", brand_name="TestBrand", class_type="Beer"),
        dict(alcohol_pct=""), TEXT),
    "spirits_abv_mandatory": (
        dict(brand_name="TestBrand", class_type="Vodka"), dict(alcohol_pct=""), TEXT),
    "beer_proof": (dict(beverage_type="beer", brand_name="TestBrand", proof="80"), {}, TEXT),
    "wine_sulfites_missing": (dict(beverage_type="wine", brand_name="TestBrand"), {}, TEXT),
    "wine_sulfites": (
        dict(beverage_type="wine", brand_name="TestBrand"), {}, "Contains Sulfites"),
    "brand_mismatch": (
        dict(brand_name="CorrectBrand", class_type="Vodka"), dict(brand_name="WrongBrand"),
        "WrongBrand"),
    "brand_nearly": (
        dict(brand_name="CorrectBrand", class_type="Vodka"), dict(brand_name="CorrectBran"),
        "x"),
    "brand_elsewhere": (
        dict(brand_name="Malt & Hop Brewery"), dict(brand_name="BREWERY"),
        "the MALT and HOP kept by the BREWERY"),
    "net_imperial": (
        dict(beverage_type="beer", brand_name="TestBrand", net_contents_ml="710 mL"),
        dict(net_contents="24 fl oz"), TEXT),
    "net_off_and_unusual": (
        dict(brand_name="TestBrand", net_contents_ml="750 mL"),
        dict(net_contents="24 fl oz"), TEXT),
    "class_contained": (
        dict(brand_name="TestBrand", class_type="Rye"), dict(class_type="Straight Rye Whisky"),
        TEXT),
    "class_in_body": (
        dict(beverage_type="wine", brand_name="ABC Winery", class_type="Merlot"),
        dict(class_type="American Red Wine"),
        "ABC WINERY AMERICAN RED WINE This red wine is a blend of 50% MERLOT"),
    "brand_case": (
        dict(brand_name="ABC Distillery", class_type="Vodka"),
        dict(brand_name="ABC DISTILLERY"), TEXT),
    "bottler_contained": (
        dict(brand_name="TestBrand", bottler_name="ABC Distillery"),
        dict(bottler="Bottled by ABC Distillery Frederick MD"), TEXT),
    "brand_misread": (
        dict(brand_name="Tom's", class_type="Vodka"), dict(brand_name="T0m's"),
        "T0m's Vodka 40%"),
    "abv_unreadable": (
        dict(brand_name="TestBrand", alcohol_pct="40"), dict(alcohol_pct="4O"), TEXT),
    "proof_misread": (
        dict(brand_name="TestBrand", proof="80"), dict(proof="8O"), TEXT),
    "abv_equal": (dict(alcohol_pct="40"), {}, TEXT),
    "abv_tolerance": (dict(alcohol_pct="40"), dict(alcohol_pct="40.3"), TEXT),
    "abv_different": (dict(alcohol_pct="40"), dict(alcohol_pct="45"), TEXT),
    "proof_consistent": (
        dict(alcohol_pct="45", proof="90"), dict(alcohol_pct="45", proof="90"), TEXT),
    "proof_inconsistent": (
        dict(alcohol_pct="45", proof="80"), dict(alcohol_pct="45", proof="80"), TEXT),
    "country_equal": (
        dict(beverage_type="wine", imported=True, country_of_origin="Australia"),
        dict(country_of_origin="Product of Australia"), TEXT),
    "country_other": (
        dict(beverage_type="wine", imported=True, country_of_origin="Australia"),
        dict(country_of_origin="Product of France"), TEXT),
    "country_missing": (
        dict(beverage_type="wine", imported=True, country_of_origin="Australia"), {}, TEXT),
    "address_found": (
        dict(bottler_name="TestCo", bottler_city="Springfield", bottler_state="IL"),
        dict(bottler="Bottled by TestCo, Springfield, IL"), TEXT),
    "address_city_missing": (
        dict(bottler_name="TestCo", bottler_city="Springfield", bottler_state="IL"),
        dict(bottler="Bottled by TestCo, IL"), TEXT),
    "address_not_given": (dict(bottler_name="TestCo"), {}, TEXT),
    "vodka": (dict(class_type="Vodka"), {}, TEXT),
    "whisky_age_unknown": (
        dict(class_type="Straight Bourbon Whiskey"),
        dict(class_type="Straight Bourbon Whiskey"), TEXT),
    "whisky_four_years": (
        dict(class_type="Straight Bourbon Whiskey"),
        dict(class_type="Straight Bourbon Whiskey"), "Aged 4 years " + TEXT),
    "whisky_three_years": (
        dict(class_type="Bourbon Whiskey", age_years=3), dict(class_type="Bourbon Whiskey"),
        TEXT),
    "whisky_three_years_stated": (
        dict(class_type="Bourbon Whiskey"), dict(class_type="Bourbon Whiskey"),
        "Aged 3 Years in oak " + TEXT),
    "whisky_four_given": (
        dict(class_type="Bourbon Whiskey", age_years=4), dict(class_type="Bourbon Whiskey"),
        TEXT),
    "ale": (
        dict(beverage_type="beer", class_type="Ale", aspartame_required=True),
        dict(class_type="Ale"), TEXT),
    "wine_form_flags": (
        dict(beverage_type="wine", class_type="Red Wine", appellation_required=True,
             varietal_required=True),
        dict(class_type="Red Wine"), "Napa Valley " + TEXT),
    "flags": (
        dict(class_type="Gin", fd_c_yellow_5_required=True, carmine_required=True,
             wood_treatment_required=True, sulfites_required=True),
        dict(class_type="Gin"), "contains FD&C Yellow No. 5 and sulfites"),
    "warning_full": ({}, dict(government_warning=FULL), TEXT),
    "warning_full_no_commas": ({}, dict(government_warning=FULL.replace(",", "").upper()), TEXT),
    "warning_first_only": ({}, dict(government_warning=FULL.split(" (2)")[0]), TEXT),
    "warning_prefix_short": ({}, dict(government_warning=FULL[:30]), TEXT),
    "warning_extra": (
        {}, dict(government_warning=FULL.replace("birth", "QZ birth")), TEXT),
    "warning_other": (
        {}, dict(government_warning="Drinking alcoholic beverages can be harmful in many ways"),
        TEXT),
    "warning_missing": ({}, dict(government_warning=""), TEXT),
    "nothing": (
        dict(brand_name="A", class_type="Gin", alcohol_pct="40", net_contents_ml="1 L",
             bottler_name="B"),
        {k: "" for k in BASE}, ""),
}


@pytest.fixture(scope="module")
def outcome(spark):
    rows = []
    for name, (app, label, text) in CASES.items():
        row = {"label_id": name, "beverage_type": "spirits", "brand_name": "TestBrand", **app}
        values = {**BASE, **label}
        row["fields"] = {f: {"value": v, "bbox": [0, 0, 9, 9]} for f, v in values.items()}
        row["all_text"] = text
        rows.append(json.dumps(row))
    apps = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.APPLICATIONS)
    fields = ",".join(f"{f}:{FIELD}" for f in schemas.FIELDS)
    df = (
        spark.createDataFrame([(r,) for r in rows], "j string")
        .select(F.from_json("j", f"{apps}, all_text string, fields struct<{fields}>").alias("r"))
        .select("r.*")
    )
    matched = as_application_side(df).select("*", "fields.*")
    out = {}
    for r in explode_results(run_rules(matched)).collect():
        out.setdefault(r["label_id"], {})[r["rule_id"]] = r
    return out


@pytest.mark.parametrize(
    "case, rule, status",
    [
        ("beer_abv_optional", "Alcohol content present", "pass"),
        ("spirits_abv_mandatory", "Alcohol content present", "fail"),
        ("beer_proof", "Proof", "pass"),
        ("wine_sulfites_missing", "Sulfites statement", "fail"),
        ("wine_sulfites", "Sulfites statement", "pass"),
        ("brand_mismatch", "Brand name matches", "fail"),
        ("brand_nearly", "Brand name matches", "pass"),
        ("brand_elsewhere", "Brand name matches", "pass"),
        ("net_imperial", "Net contents", "pass"),
        ("net_off_and_unusual", "Net contents standard of fill", "needs_review"),
        ("net_off_and_unusual", "Net contents matches", "needs_review"),
        ("class_contained", "Class/type matches", "pass"),
        ("class_in_body", "Class/type matches", "needs_review"),
        ("brand_case", "Brand name matches", "pass"),
        ("bottler_contained", "Bottler/producer statement", "pass"),
        ("brand_misread", "Brand name matches", "pass"),
        ("abv_unreadable", "Alcohol content", "pass"),
        ("proof_misread", "Proof matches", "pass"),
        ("abv_equal", "Alcohol content matches", "pass"),
        ("abv_tolerance", "Alcohol content matches", "pass"),
        ("abv_different", "Alcohol content matches", "needs_review"),
        ("proof_consistent", "Proof/ABV consistency", "pass"),
        ("proof_inconsistent", "Proof/ABV consistency", "needs_review"),
        ("country_equal", "Country of origin", "pass"),
        ("country_other", "Country of origin matches", "needs_review"),
        ("country_missing", "Country of origin", "fail"),
        ("address_found", "Bottler address", "pass"),
        ("address_city_missing", "Bottler address", "needs_review"),
        ("vodka", "Neutral spirits / commodity", "fail"),
        ("whisky_age_unknown", "Age statement", "fail"),
        ("whisky_three_years", "Age statement", "fail"),
        ("whisky_three_years_stated", "Age statement", "pass"),
        ("ale", "Aspartame statement", "fail"),
        ("wine_form_flags", "Appellation of origin", "pass"),
        ("wine_form_flags", "Varietal designation", "pass"),
        ("flags", "FD&C Yellow No. 5", "pass"),
        ("flags", "Cochineal/Carmine statement", "fail"),
        ("flags", "Wood treatment", "fail"),
        ("flags", "Sulfites statement", "pass"),
        ("warning_full", "Exact warning wording", "pass"),
        ("warning_full_no_commas", "Exact warning wording", "pass"),
        ("warning_first_only", "Exact warning wording", "pass"),
        ("warning_prefix_short", "Exact warning wording", "fail"),
        ("warning_extra", "Exact warning wording", "needs_review"),
        ("warning_other", "GOVERNMENT WARNING in caps", "fail"),
        ("warning_other", "Exact warning wording", "needs_review"),
        ("warning_missing", "Government warning present", "fail"),
        ("nothing", "Brand name present", "fail"),
        ("nothing", "Class/type present", "fail"),
        ("nothing", "Net contents present", "fail"),
        ("nothing", "Bottler/producer statement", "fail"),
    ],
)
def test_status(outcome, case, rule, status):
    assert outcome[case][rule]["status"] == status


@pytest.mark.parametrize(
    "case, rule",
    [
        ("abv_equal", "Proof/ABV consistency"),
        ("address_not_given", "Bottler address"),
        ("whisky_four_years", "Age statement"),
        ("whisky_four_given", "Age statement"),
        ("ale", "Neutral spirits / commodity"),
        ("ale", "Age statement"),
        ("ale", "Wood treatment"),
        ("warning_missing", "Exact warning wording"),
        ("abv_equal", "Country of origin"),
    ],
)
def test_rule_does_not_apply(outcome, case, rule):
    assert rule not in outcome[case]


def test_messages(outcome):
    def message(case, rule):
        return outcome[case][rule]["message"]

    assert message("brand_mismatch", "Brand name matches") == "Brand name mismatch (55%)."
    assert message("brand_nearly", "Brand name matches") == "Brand name matches (substring)."
    assert message("net_off_and_unusual", "Net contents matches") == (
        "Net contents on label (24 fl oz ≈ 710 mL) does not match application "
        "(750 mL ≈ 750 mL)."
    )
    assert message("proof_inconsistent", "Proof/ABV consistency") == (
        "Proof (80) does not equal 2× ABV (45%). Expected proof ≈ 90."
    )
    assert message("address_city_missing", "Bottler address") == (
        "Bottler city 'Springfield' not found on label."
    )
    assert message("warning_extra", "Exact warning wording") == (
        "Key phrases present but: extra words: ['QZ']; critical phrases (BIRTH DEFECTS, "
        "HEALTH PROBLEMS) out of order or too far apart."
    )
    assert message("whisky_age_unknown", "Age statement").endswith("aged < 4 years.)")
    assert outcome["brand_elsewhere"]["Brand name matches"]["prefer_app_display"] is True
    assert outcome["whisky_three_years_stated"]["Age statement"]["extracted_value"] == (
        "aged 3 years in oak testbrand vodk"
    )


def test_category_order(outcome):
    order = ["Identity", "Alcohol & contents", "Warning", "Origin", "Other"]
    for rules in outcome.values():
        by_seq = sorted(rules.values(), key=lambda r: r["rule_seq"])
        seen = [order.index(r["category"]) for r in by_seq]
        assert seen == sorted(seen)
