import random

import pytest
from pyspark.sql import functions as F

from labelspark.config import DEFAULT
from labelspark.functions import numbers as N
from labelspark.functions import similarity as S
from labelspark.functions import text as X

L = F.lit


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(600):
        letters = "ab cdé"[: rng.randint(2, 6)]
        a = "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 20, 61, 62, 63, 125])))
        b = "".join(c for c in a if rng.random() < 0.9) if rng.random() < 0.5 else "".join(
            rng.choice(letters) for _ in range(rng.choice([0, 1, 10, 62, 70, 130]))
        )
        rows.append((a, b, lcs(a, b)))
    a, b = F.col("a"), F.col("b")
    return spark.createDataFrame(rows, "a string, b string, n int").select(
        "a", "b", "n", S.lcs_length(a, b).alias("found"),
        S.ratio_reaches(a, b, 80).alias("reaches"),
        S.ratio_reaches(a, b, 85, strict=True).alias("above"),
        S.ratio_from(a, b, 70).alias("value"),
    ).collect()


def test_similarity_against_brute_force(pairs):
    for r in pairs:
        total = len(r["a"]) + len(r["b"])
        assert r["found"] == r["n"]
        assert r["reaches"] == (200 * r["n"] >= 80 * total)
        assert r["above"] == (200 * r["n"] > 85 * total)
        assert r["value"] == pytest.approx(
            2 * r["n"] / total if 200 * r["n"] >= 70 * total else 0
        )


def test_smart_match(evaluate):
    cases = {
        ("ABC Distillery", "ABC Distillery"): (1.0, "exact"),
        ("ABC DISTILLERY", "abc distillery"): (1.0, "exact"),
        ("Bacardi", "Bacard1"): (1.0, "exact_ocr_normalized"),
        ("Rye", "Straight Rye Whisky"): (0.95, "token_containment"),
        ("Ale", "Pale Ale"): (0.95, "token_containment"),
        ("Tom Gin", "the T0m Gin"): (0.95, "token_containment_ocr_normalized"),
        ("Single Barrel Straight Rye Whisky", "Straight Rye Whisky"):
            (0.88, "reverse_containment_partial"),
        ("ale ale", "ale"): (0.95, "token_containment"),
        ("Rye, Straight", "straight rye straight"): (0.95, "token_containment"),
        ("Wood", "Woodford Reserve"): (0.92, "substring"),
        ("ABC Distillery", "ABC DISTILERY"): (0.9, "fuzzy_token"),
        ("Merlot", "American Red Wine"): (6 / 23, "fuzzy_ratio"),
        ("", "something"): (0.0, "empty"),
        ("something", ""): (0.0, "empty"),
        ("...", "abc"): (0.0, "empty_tokens"),
        ("STONE'S THROW", "Stone's Throw"): (1.0, "exact"),
    }
    found = evaluate(F.array(*[S.smart_match(L(a), L(b)) for a, b in cases]))
    for got, (pair, (score, reason)) in zip(found, cases.items()):
        assert got["reason"] == reason, pair
        assert got["score"] == pytest.approx(score), pair


def test_confusable(evaluate):
    cases = [
        ("hello", "hello", True), ("label", "1abel", True), ("Tom", "T0m", True),
        ("45,0", "45.0", True), ("St", "5t", True), ("hello", "world", False),
        ("", "hello", False), ("hello", "", False), ("ABC", "A8C", True),
        ("IO", "10", True), ("ABCD", "1234", False), ("bam", "barn", True),
        ("45", "40", False), ("Wooprorp", "Woodford", False),
        ("abcdefghij", "abcxyzghij", True), ("Woodfrd", "Woodford", False),
    ]
    found = evaluate(F.array(*[S.confusable(L(a), L(b)) for a, b, _ in cases]))
    assert list(found) == [c[2] for c in cases]


def test_net_ml(evaluate):
    cases = {
        "750 mL": 750, "1 L": 1000, "12 fl oz": 355, "1 qt": 946, "1 pt": 473,
        "1 gal": 3785, "": None, "unknown": None, "75O mL": 750, "7S0 mL": 750,
        "I2 fl oz": 355, "750": 750, "1l": 11, "0.5 mL": 0, "1.5 mL": 2,
    }
    assert list(evaluate(F.array(*[N.net_ml(L(c)) for c in cases]))) == list(cases.values())


def test_abv(evaluate):
    cases = {"45": 45.0, "5.5": 5.5, "12.0%": 12.0, "": None, "abc": None, "45d": None}
    assert list(evaluate(F.array(*[N.abv_float(L(c)) for c in cases]))) == list(cases.values())


def test_normalising(evaluate):
    got = evaluate(
        X.norm(L("  foo   bar  ")), X.norm(L(None).cast("string")),
        X.tokenize(L(" (Hello) 'World'... - ")), X.ocr_text(L("T0m 158")),
        X.leading_one(L("I5%")), X.leading_one(L("[2")), X.ocr_numeric(L("8O")),
        X.numeric_sequences(L("I2 fl oz 7S0")),
    )
    assert got == ("foo bar", "", ["hello", "world", "-"], "tom isb", "15%", "12", "80",
                   "12 fl oz 750")


def test_statement_repairs(evaluate):
    words = ["GOVERNMENT", "WARNING", "CONSUMPTION", "OF", "PREGNANCY"]
    got = evaluate(
        X.casing(L("GOVERNMENT WARNING of")), X.casing(L("Abc Def")), X.casing(L("1 2")),
        X.correct_words(L("GOVERMENT WARNNG: of PREGNANC"), words),
        X.fix_hyphenation(L("during preg- nancy, machin-ery")),
        X.collapse_warning(L("Government Warning: WARNING: x")),
        X.drop_tokens(L("a QZ b qz, c"), F.array(L("QZ"))),
        X.collapse_repeats(L("a b a b c | ---- the THE end")),
        X.statement_norm(L("Surgeon OM, women should preg- nancy ab")),
        X.trim_overlap(L("abc def"), L("xx ABC")), X.trim_overlap(L("abc"), L("xyz")),
        X.surgeon_general_case(L(" the SURGEON  general says ")),
        X.unmatched_words(L("Foo bar BAZ"), L("bar")),
        X.statement_position(L("WOMEN  should"), "the women should not"),
        X.statement_position(L("zzz should"), "the women should not"),
        X.statement_position(L("zzz"), "the women should not"),
        X.strip_nutrition(L("and Serving Size 12 ml more Protein"),
                          ["SERVING SIZE", "PROTEIN"], ["PROTEIN"]),
    )
    assert got == (
        "upper", "mixed", "mixed", "GOVERNMENT WARNING: of PREGNANCY",
        "during pregnancy, machinery", "Government Warning: x", "a b , c", "a b c the end",
        "SURGEON GENERAL WOMEN SHOULD PREGNANCY", "def", "abc",
        "the Surgeon General says", ["Foo", "BAZ"], 4, 10, 999999, "and  more",
    )


def test_tokens(evaluate):
    text = L("This red wine is a blend of 50% MERLOT and 50% CABERNET")
    low = F.lower(text)
    words = S.clean_words(text)
    got = evaluate(
        S.tokens_in_text(L("Merlot"), text), S.tokens_in_text(L("Syrah"), text),
        S.tokens_in_words(L("Merl0t & Cabernett"), low, words),
        S.tokens_in_words(L("Syrah"), low, words), S.tokens_in_words(L("."), low, words),
        S.similarity(L("STONES THROW"), L("Stones  Throw")), S.similarity(L(""), L("x")),
    )
    assert got == (True, False, True, False, False, 1.0, 0.0)


def test_configured_wording_is_read_like_the_label(evaluate):
    wordings = [
        DEFAULT.required_statement, "Drink it at home, if you are OK", "surgeon OM, preg- nancy", "7 ] machin-\nery, ab", "",
    ]
    got = evaluate(*[X.statement_norm(L(w)) for w in wordings])
    assert list(got) == [X.statement_norm_of(w) for w in wordings]
    assert got[1] == "DRINK IT AT HOME IF YOU ARE"
