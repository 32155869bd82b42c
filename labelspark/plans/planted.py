"""Extracted fields and applications planted so that every arm of every rule is met.

Each label takes one case by its number; a case names the category it is about and what it
changes in an ordinary spirits label. Expected rows stand in `oracle.PLANTED_RESULTS`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark import schemas
from labelspark.config import REQUIRED_STATEMENT
from labelspark.operators.extract import FIELD
from labelspark.plans.fixtures import spread, table

APPLICATION = {
    "beverage_type": "spirits", "brand_name": "Old Crow", "class_type": "Gin", "alcohol_pct": "40", "proof": "80",
    "net_contents_ml": "750 mL", "bottler_name": "Crow Works", "bottler_city": "Frederick", "bottler_state": "MD",
    "country_of_origin": "",
}
LABEL = {
    "brand_name": "Old Crow", "class_type": "Gin", "alcohol_pct": "40", "proof": "80", "net_contents": "750 mL",
    "government_warning": REQUIRED_STATEMENT, "bottler": "Bottled by Crow Works, Frederick, MD", "country_of_origin": "",
    "all_text": "nothing else",
}
_ONE = REQUIRED_STATEMENT[: REQUIRED_STATEMENT.index(" (2)")]
_TWO = "GOVERNMENT WARNING: " + REQUIRED_STATEMENT[REQUIRED_STATEMENT.index("(2)") :]

#: (category, changed application columns and flags, changed label fields)
CASES: list[tuple[str, dict, dict]] = [
    # brand: absent, not applied for, alike, alike but for misread letters, contained, near, in the text, far, misread
    ("Identity", {}, {"brand_name": ""}),
    ("Identity", {"brand_name": ""}, {}),
    ("Identity", {}, {"brand_name": "0ld Cr0w"}),
    ("Identity", {}, {"brand_name": "Old Crow Reserve"}),
    ("Identity", {"brand_name": "abcdefghijklmnop"}, {"brand_name": "abcdefghijkx"}),
    ("Identity", {"brand_name": "abcdefghij"}, {"brand_name": "abcdefgxyz"}),
    ("Identity", {"brand_name": "abcdefghij"}, {"brand_name": "abcdefgxyz", "all_text": "abcdefghij of old"}),
    ("Identity", {"brand_name": "Stone Bridge"}, {"brand_name": "Qzwv"}),
    ("Identity", {"brand_name": "Stone Bridge"}, {"brand_name": "Qzwv", "all_text": "the bridge of stone"}),
    ("Identity", {"brand_name": "abcdefghi"}, {"brand_name": "abcdefxyz"}),
    # class: the same arms, but a text that holds the class of the application is no pass
    ("Identity", {}, {"class_type": ""}),
    ("Identity", {"class_type": ""}, {}),
    ("Identity", {"class_type": "Straight Rye Whisky"}, {"class_type": "Rye Whisky"}),
    ("Identity", {"class_type": "abcdefghijklmnop"}, {"class_type": "abcdefghijkx"}),
    ("Identity", {"class_type": "abcdefghij"}, {"class_type": "abcdefgxyz", "all_text": "abcdefghij of old"}),
    ("Identity", {"class_type": "Pale Ale"}, {"class_type": "Qzwv"}),
    ("Identity", {"class_type": "Pale Ale"}, {"class_type": "Qzwv", "all_text": "an ale so pale"}),
    ("Identity", {"class_type": "abcdefghi"}, {"class_type": "abcdefxyz"}),
    # alcohol: absent, not required, near, misread, different, unreadable, not applied for
    ("Alcohol & contents", {}, {"alcohol_pct": ""}),
    ("Alcohol & contents", {"beverage_type": "beer"}, {"alcohol_pct": "", "net_contents": "333 mL"}),
    ("Alcohol & contents", {"alcohol_pct": "40.2"}, {}),
    ("Alcohol & contents", {"alcohol_pct": "45"}, {"alcohol_pct": "4S", "proof": "90"}),
    ("Alcohol & contents", {"alcohol_pct": "13", "beverage_type": "wine"}, {"alcohol_pct": "18"}),
    ("Alcohol & contents", {"alcohol_pct": "forty"}, {}),
    ("Alcohol & contents", {"alcohol_pct": ""}, {}),
    ("Alcohol & contents", {"alcohol_pct": "123.4"}, {"alcohol_pct": "23.41", "proof": ""}),
    # proof: absent, misread, different, not twice the alcohol
    ("Alcohol & contents", {}, {"proof": ""}),
    ("Alcohol & contents", {}, {"proof": "8O"}),
    ("Alcohol & contents", {"proof": "90"}, {"proof": "80"}),
    ("Alcohol & contents", {"proof": ""}, {"proof": "86"}),
    ("Alcohol & contents", {"proof": "1234"}, {"proof": "234"}),
    # contents: absent, not applied for, odd size, different, both
    ("Alcohol & contents", {}, {"net_contents": ""}),
    ("Alcohol & contents", {"net_contents_ml": ""}, {}),
    ("Alcohol & contents", {"net_contents_ml": "740 mL"}, {"net_contents": "740 mL"}),
    ("Alcohol & contents", {"net_contents_ml": "1 L"}, {}),
    ("Alcohol & contents", {"net_contents_ml": "1 L"}, {"net_contents": "740 mL"}),
    ("Alcohol & contents", {"net_contents_ml": "75 mL"}, {}),
    # statement: absent, not in capitals, short, words missing, one part only, another text, extra words
    ("Warning", {}, {"government_warning": ""}),
    ("Warning", {}, {"government_warning": REQUIRED_STATEMENT.replace("GOVERNMENT WARNING", "Official note")}),
    ("Warning", {}, {"government_warning": "GOVERNMENT WARNING: drink less"}),
    ("Warning", {}, {"government_warning": REQUIRED_STATEMENT.replace("women should", "women zebra should")}),
    ("Warning", {}, {"government_warning": REQUIRED_STATEMENT.replace("drive a car", "drive")}),
    ("Warning", {}, {"government_warning": REQUIRED_STATEMENT.replace("Surgeon General", "surgeon general").replace("drive a", "drive zebra a")}),
    ("Warning", {}, {"government_warning": _ONE.replace("women should", "women would")}),
    ("Warning", {}, {"government_warning": _TWO}),
    ("Warning", {}, {"government_warning": "GOVERNMENT WARNING: this text speaks of something else altogether, at length"}),
    ("Warning", {}, {"government_warning": REQUIRED_STATEMENT.replace("impairs", "imparis")}),
    ("Warning", {}, {"government_warning": REQUIRED_STATEMENT.replace(",", "").replace("PREGNANCY", "PREG- NANCY")}),
    # all words, none too many, and the critical ones within the first: the arm of words alone
    ("Warning", {}, {"government_warning": "Birth health defects problems " + REQUIRED_STATEMENT.replace("women should", "should women")}),
    # bottler: absent in four ways, not applied for, in the text, near, far; city and state
    ("Origin", {"bottler_name": ""}, {"bottler": ""}),
    ("Origin", {"bottler_name": "Stone Bridge"}, {"bottler": ""}),
    ("Origin", {"bottler_name": "Stone Bridge"}, {"bottler": "", "all_text": "the bridge of stone"}),
    ("Origin", {"bottler_name": "Old Crow"}, {"bottler": ""}),
    ("Origin", {"bottler_name": ""}, {}),
    ("Origin", {"bottler_name": "abcdefghijklmnop", "bottler_city": "", "bottler_state": ""}, {"bottler": "abcdefghijkx"}),
    ("Origin", {"bottler_name": "Stone Bridge"}, {"bottler": "Qzwv, Reno, NV", "all_text": "the bridge of stone"}),
    ("Origin", {"bottler_name": "Stone Bridge", "bottler_city": ""}, {"bottler": "Qzwv, MD"}),
    ("Origin", {"bottler_name": "ce", "bottler_city": "", "bottler_state": ""}, {"bottler": "ec"}),
    # country: absent, misread, another, contained, not applied for
    ("Origin", {"imported": True, "country_of_origin": "France"}, {}),
    ("Origin", {"imported": True, "country_of_origin": "Iceland"}, {"country_of_origin": "lceland"}),
    ("Origin", {"imported": True, "country_of_origin": "France"}, {"country_of_origin": "Peru"}),
    ("Origin", {"imported": True, "country_of_origin": "Scotland"}, {"country_of_origin": "SCOTLAND, UK"}),
    ("Origin", {"imported": True, "country_of_origin": "Isboso"}, {"country_of_origin": "15b050"}),
    ("Origin", {"imported": True}, {"country_of_origin": "Peru"}),
    # other: every required text found and not found, ages given and read
    ("Other", {"sulfites_required": True}, {"all_text": "CONTAINS SULFITES"}),
    ("Other", {"sulfites_required": True}, {}),
    ("Other", {"beverage_type": "wine"}, {}),
    ("Other", {"fd_c_yellow_5_required": True}, {"all_text": "FD&C Yellow No. 5"}),
    ("Other", {"fd_c_yellow_5_required": True}, {"all_text": "yellow"}),
    ("Other", {"carmine_required": True}, {"all_text": "cochineal extract"}),
    ("Other", {"carmine_required": True}, {}),
    ("Other", {"wood_treatment_required": True}, {"all_text": "Treated with oak"}),
    ("Other", {"wood_treatment_required": True}, {}),
    ("Other", {"wood_treatment_required": True, "beverage_type": "beer"}, {}),
    ("Other", {"class_type": "Rye Whisky"}, {}),
    ("Other", {"class_type": "Rye Whisky", "age_years": 3}, {"all_text": "aged 3 years in oak"}),
    ("Other", {"class_type": "Rye Whisky", "age_years": 3}, {}),
    ("Other", {"class_type": "Rye Whisky", "age_years": 6}, {}),
    ("Other", {"class_type": "Rye Whisky"}, {"all_text": "12 years old"}),
    ("Other", {"class_type": "Rye Whisky"}, {"all_text": "matured 2 years"}),
    ("Other", {"class_type": "Rye Whisky"}, {"all_text": "age statement: none"}),
    ("Other", {"age_statement_required": True}, {"all_text": "see age  statement on the back"}),
    ("Other", {"age_statement_required": True}, {"all_text": "cooperage"}),
    ("Other", {"class_type": "Vodka"}, {"all_text": "distilled from grain spirits"}),
    ("Other", {"neutral_spirits_required": True}, {}),
    ("Other", {"beverage_type": "beer", "aspartame_required": True}, {"all_text": "PHENYLKETONURICS: contains"}),
    ("Other", {"beverage_type": "beer", "aspartame_required": True}, {}),
    ("Other", {"aspartame_required": True}, {}),
    ("Other", {"beverage_type": "wine", "appellation_required": True}, {"all_text": "Napa, contains sulfites"}),
    ("Other", {"beverage_type": "wine", "appellation_required": True}, {"all_text": "sulfites"}),
    ("Other", {"beverage_type": "wine", "varietal_required": True}, {"class_type": "Red Wine", "all_text": "sulfites"}),
    ("Other", {"beverage_type": "wine", "varietal_required": True}, {"class_type": "", "all_text": "sulfites"}),
]


def planted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label per part: application columns, extracted fields, `case_no` and its `category`."""
    flags = schemas.APPLICATION_FLAGS + schemas.FORM_FLAGS
    rows = [
        (i, category, *({**APPLICATION, **app}.get(c, "") for c in schemas.APPLICATION_TEXT), *(bool(app.get(f)) for f in flags),
         app.get("age_years", 0), *({**LABEL, **label}[c] for c in [*schemas.FIELDS, "all_text"]))
        for i, (category, app, label) in enumerate(CASES)
    ]
    kind = ["case_no int", "category string", *(f"app_{c} string" for c in schemas.APPLICATION_TEXT), *(f"{f} boolean" for f in flags),
            "age_years int", *(f"{c} string" for c in [*schemas.FIELDS, "all_text"])]
    cases = spark.createDataFrame(rows, ", ".join(kind))
    labels = table(spark, sf_dir, "part").select(
        F.concat(F.lit("L"), F.col("p_partkey")).alias("label_id"), (F.col("p_partkey") % len(CASES)).cast("int").alias("case_no")
    )
    # the rules are costly, and a part file may be a single row group, which one task would read
    labels = spread(spark, labels, "label_id")
    box = F.array(*[F.lit(x) for x in (1, 2, 30, 40)])
    field = lambda c: F.struct(F.col(c).alias("value"), F.when(F.col(c) != "", box).alias("bbox")).cast(FIELD).alias(c)
    found = labels.join(F.broadcast(cases), "case_no").select(
        "label_id", "case_no", "category", *flags, "age_years", *[F.col(f"app_{c}") for c in schemas.APPLICATION_TEXT],
        *[field(c) for c in schemas.FIELDS], "all_text",
    )
    clash = {"brand_name", "class_type", "alcohol_pct", "proof", "country_of_origin"}
    return found.withColumnsRenamed({f"app_{c}": f"{c}_app" if c in clash else c for c in schemas.APPLICATION_TEXT})
