"""Steps that grow with the tables: each row is read once, work is dealt, cheap tests go first."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from labelspark import config as C
from labelspark.functions import similarity as S
from labelspark.functions import text as X
from labelspark.operators import extract as E
from labelspark.plans import fixtures as T
from labelspark.plans import planted as PL
from labelspark.plans.queries import QUERIES
from labelspark.sources.words import typed_words

SMALL = "/root/testdata/sf0.001"
WORD = "label_id string, text string, pass_id string, word_no string, block_num string, par_num string, line_num string, conf string, " \
       "left string, top string, width string, height string"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_errors_takes_no_copy_of_the_casts_along(spark):
    raw = spark.createDataFrame([("A", "x", " 1", " 2", "1", "1", "1", " 9.5 ", "3", "4", "5", "6")], WORD)
    typed = typed_words(raw)
    words = typed.where("error is null")
    assert words.count() == 1 and words.first().word_no == 2 and words.first().conf == 9.5
    filters = [line for line in optimized(words).splitlines() if line.strip(" +-:").startswith("Filter")]
    assert len(filters) == 1 and "try_cast" not in filters[0].lower() and "regexp" not in filters[0]


def test_words_lie_where_the_line_has_them(spark):
    words = T.ocr_words(spark, SMALL)
    assert "slice(" not in optimized(words)
    lines = T.label_blocks(spark, SMALL).select("label_id", "pass_id", F.col("line_no").alias("line_num"), F.col("text").alias("line"), "x1")
    both = words.where("word_no < 1000").join(lines, ["label_id", "pass_id", "line_num"]).collect()
    assert both
    for r in both:
        before = r.line.split(" ")[: r.word_no - 1]
        assert r.left == r.x1 + 8 * (len(" ".join(before)) + (1 if before else 0))


@pytest.mark.parametrize("build", [PL.planted_fields, QUERIES["document_repeats"]])
def test_costly_work_is_dealt_by_key(spark, build):
    assert "RepartitionByExpression" in optimized(build(spark, SMALL))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def test_short_texts_take_one_limb(spark):
    rnd = random.Random(5)
    pick = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    pairs = [(pick(n, "ab01 é"), pick(m, "ab10 ß")) for n in (0, 1, 2, 30, 61, 62, 63, 80) for m in (0, 1, 62, 63, 130)]
    pairs += [("abc", "xyz"), ("01", "10"), ("a" * 62, "a" * 62), ("a" * 62, "b" + "a" * 61)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    for r in rows.select("a", "b", S.lcs_length(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == lcs(r.a, r.b), (r.a, r.b)
    limb = rows.where("length(a) between 1 and 62").select("a", "b", S._lcs_of_limb(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == lcs(r.a, r.b) for r in limb.collect())


def test_tokens_of_unlike_length_are_left_out_first(spark):
    tokens = ["a", "ab", "bottled", "bottle", "battled", "frederick", "fredericks", "x" * 20]
    rows = spark.createDataFrame([(tokens, tokens[::-1] + ["bottIed"])], "a array<string>, b array<string>")
    got = rows.select(S.best_token_scores(F.col("a"), F.col("b"), 85).alias("s"))
    assert "(100 - 85)" in got._jdf.queryExecution().analyzed().toString() or "* 15" in optimized(got)
    want = [max([2 * lcs(t, w) / (len(t) + len(w)) for w in (*tokens, "bottIed")]) for t in tokens]
    assert got.first().s == pytest.approx(want)


TEXTS = [
    "", "750 mL", "I2 fl oz", "[2 pt.", "one pint", "40% ALC/VOL", "ALC. 40 % by vol", "%", "80 proof", "PROOF", "Product of Scotland",
    "produce  DE Peru", "made in France", "imported from Chile", "Origin : Spain", "origin", "Frederick, MD", "Wine of Italy", "bottled BY x",
    "Brand Label", "back labels", "Contains: 5 L", "GOVERNMENT WARNING: 5 L", "Pale Ale", "palest", "İmported from Oz", "ımported by", "made in Oz",
    "Straight Rye Whisky", "wine,ale", "ginger", "a port in Portugal", "CARBOHYDRATE 5 g", "5% of 7 gal", "5% abv, 80.5 PROOF",
]


def test_cheap_tests_change_no_answer(spark):
    rows = spark.createDataFrame([("L", i, t, 0, 0, 9, 9, 1.0) for i, t in enumerate(TEXTS)],
                                 "label_id string, block_id bigint, text string, x1 int, y1 int, x2 int, y2 int, confidence double")
    t, up = F.col("t"), F.col("up")

    def plain(values, whole_word=False):
        body = "|".join(sorted({v.upper() for v in values}))
        return up.rlike(rf"(?U)\b(?:{body})\b" if whole_word else f"(?:{body})")

    tested = E.block_tests(rows)
    pairs = {
        "class_any": plain(C.CLASS_KEYWORDS), "class_word": plain(C.CLASS_KEYWORDS, True), "abv": E.abv_qualified(t), "net": E.net_value(t),
        "country": E.country_value(t), "bottler_header": t.rlike(C.BOTTLER_HEADER), "proof_no": F.regexp_extract("t", C.PROOF, 1),
        "abv_any": F.get(F.regexp_extract_all("text", F.lit(C.ABV_LOOSE), F.lit(1)), F.lit(0)),
        "country_name": (F.length("t") < 40) & plain(C.KNOWN_COUNTRIES),
        "stop": t.rlike(C.ABV_QUALIFIED) | t.rlike(C.BOTTLER_HEADER) | F.contains(up, F.lit("IMPORTED BY")) | t.rlike(C.NET_CONTENTS)
        | t.rlike(C.COUNTRY_PHRASE) | F.startswith(up, F.lit("CONTAINS")) | (t.rlike(C.CITY_STATE) & ~plain(C.CLASS_KEYWORDS))
        | t.rlike(C.PANEL_MARKER),
    }
    found = tested.select("text", *[F.col(c).eqNullSafe(p).alias(c) for c, p in pairs.items()]).collect()
    assert [(r.text, c) for r in found for c in pairs if not r[c]] == []
    assert E.CLASS_ANYWHERE.startswith("(?=[") and E.has_net_contents(t) is not None


def test_repeats_read_alike_with_and_without_other_letters(spark):
    texts = ["a A b", "the cat the  cat the cat sat", "x_1 X_1\ty", "no\x0bno", "a\x1ca", "one two. two", "word words"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    # a letter of another alphabet at the end sends the text through the other patterns
    both = rows.select(X.collapse_repeats(F.col("t")).alias("a"), X.collapse_repeats(F.concat("t", F.lit(" ß"))).alias("u"))
    assert "octet_length" in optimized(both)
    assert [r.u for r in both.collect()] == [r.a + " ß" for r in both.collect()]


def test_an_address_is_sought_from_the_start_of_a_name_only(spark):
    texts = [
        "Old Tom Distillery Frederick, MD", "by Old Tom & Sons' Winery, New York, NY 1", "x. Stone Brewing Company Escondido, CA", "Winery Napa, CA",
        "Brewing Company Napa, CA", "Company Company Napa, CA", "\U00010400a b Cellars \u0130zmir, TR", "\u00e9 Brewery\u00a0B\u00e9ziers , FR", "Imports Napa",
        "(a) b Vineyards, Napa, CA, c Cellars, Napa, CA", "", "Distillery Vodka 40% ALC/VOL General, women",
    ]
    plain = C.BOTTLER_ADDRESS.replace(r"(?<![\w\s&'])", "")
    assert plain != C.BOTTLER_ADDRESS
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    groups = lambda p: F.array(*[F.regexp_extract("t", p, g) for g in (0, 1, 2, 3)])
    got = rows.select("t", groups(C.BOTTLER_ADDRESS).alias("a"), groups(plain).alias("b")).collect()
    assert [r.t for r in got if r.a != r.b] == [] and sum(r.a[0] != "" for r in got) >= 6
    long = spark.createDataFrame([("word " * 12000,)], "t string")
    long.select(F.col("t").rlike(C.BOTTLER_ADDRESS)).collect()
    start = time.perf_counter()
    assert not long.select(F.col("t").rlike(C.BOTTLER_ADDRESS)).first()[0]
    assert time.perf_counter() - start < 3


def test_fixed_words_take_no_pattern(spark):
    rows = spark.createDataFrame([("L", i, t, 0, 0, 9, 9, 1.0) for i, t in enumerate([*TEXTS, "a | b", "SERVINGS", "Old Co", "according", "FAT"])],
                                 "label_id string, block_id bigint, text string, x1 int, y1 int, x2 int, y2 int, confidence double")
    up = F.col("up")
    either = lambda words: up.rlike("|".join(words))
    tested = E.block_tests(rows).select(
        "text", "in_warning", E.has_warning_keyword(up).alias("keyword"), either(C.WARNING_KEYWORDS).alias("keyword_0"),
        E.has_serving_marker(up).alias("marker"), either(C.SERVING_MARKERS).alias("marker_0"),
        E.has_serving_trace(up).alias("trace"), either([r"\|", *C.SERVING_MARKERS, *C.ORPHAN_SERVING_WORDS]).alias("trace_0"),
        "suffix", F.regexp_extract(up, E.SUFFIX_WORD, 1).alias("word"),
    )
    for r in tested.collect():
        assert (r.keyword, r.marker, r.trace) == (r.keyword_0, r.marker_0, r.trace_0), r.text
        assert (r.suffix is None) == (r.word == ""), r.text
    plan = optimized(E.block_tests(rows))
    assert "RLIKE GOVERNMENT|WARNING" not in plan and "RLIKE ALC|VOL|PROOF" not in plan


def test_trimming_knows_the_spaces_of_the_pattern(spark):
    texts = spark.createDataFrame([(chr(i) + "a" + chr(i) + "b" + chr(i) * 2,) for i in range(0x3100)] + [(" \n",), (None,), ("a\r\n",)], "t string")
    both = texts.select("t", X.strip(F.col("t")).alias("a"), F.regexp_replace(X.text_or_empty(F.col("t")), rf"(?U)^{X.SPACE}+|{X.SPACE}+$", "").alias("b"))
    assert [r.t for r in both.collect() if r.a != r.b] == []
    assert "regexp" not in optimized(texts.select(X.strip(F.col("t")).alias("a"))).lower()


def test_repeats_are_dropped_as_by_all_patterns(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["a", "A", "b", "of", "of.", "c", "\u00c9", "\u00e9"]) for _ in range(rnd.randrange(24))) for _ in range(400)]
    texts += ["a b c d e A B C D E", "a b c d a b c d x", "a b  a b", "a b\ta b", "of the risk of birth", "x a b c a b c a b c"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")

    def one_round(c):
        for n in (5, 4, 3, 2, 1):
            c = F.regexp_replace(c, r"(?iU)(\b\w++(?:\s++\w++){%d})\s++\1\b" % (n - 1), "$1")
        return c

    # three rounds, of which a text without change is the same after any further one
    both = rows.select("t", X.collapse_repeats(F.col("t")).alias("a"), X.norm(one_round(one_round(one_round(F.col("t"))))).alias("b")).collect()
    assert [r.t for r in both if r.a != r.b] == []
    plan = optimized(rows.select(X.collapse_repeats(F.col("t"))))
    assert "{0,3}?" in plan
