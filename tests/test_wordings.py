"""Statement words corrected by a join, against the expression that tries every reference word."""

import random

from pyspark.sql import functions as F

from labelspark.config import REQUIRED_STATEMENT
from labelspark.functions.text import correct_words, upper_words
from labelspark.operators.wordings import corrected, corrections, shortened, wordings


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def misread(rng, word):
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(word) + 1)
        word = rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("ABCXYZ01") + word[i:], word[:i] + rng.choice("EIOQ") + word[i + 1 :]])
    return word or "X"


def test_shortened_forms(evaluate):
    assert set(evaluate(shortened(F.lit("abcd")))) == {"abcd", "abc", "abd", "acd", "bcd", "ab", "ac", "ad", "bc", "bd", "cd"}
    # words at most two edits apart have a form in common
    rng = random.Random(2)
    for _ in range(12):
        word = "".join(rng.choices("abcde", k=6))
        other = misread(rng, word).lower()
        if edits(word, other) <= 2 and len(other) >= 4:
            assert set(evaluate(shortened(F.lit(word)))) & set(evaluate(shortened(F.lit(other))))


def test_corrections_equal_trying_every_reference_word(spark):
    rng = random.Random(7)
    texts = {"one": REQUIRED_STATEMENT, "two": "CONTAINS SULFITES and sulphur, barley barleys bar"}
    refs = {w: sorted({x for x in "".join(c if c.isalnum() else " " for c in t.upper()).split()}) for w, t in texts.items()}
    words = {(w, misread(rng, rng.choice(refs[w]))) for w in refs for _ in range(400)} | {("one", "X" * 500), ("none", "HEALTH")}
    table = spark.createDataFrame(sorted(words), "wording string, word string")
    got = {(r.wording, r.word): r.replacement for r in corrections(table, wordings(spark, texts)).collect()}
    want = {}
    for w, word in words:
        near = sorted((edits(word, r), r) for r in refs.get(w, []) if len(r) >= 5 and abs(len(r) - len(word)) <= 2)
        if len(word) >= 4 and word not in refs.get(w, []) and near and near[0][0] <= 2:
            want[w, word] = near[0][1]
    assert got == want and len(want) > 200


def test_corrected_texts_equal_the_expression(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = [misread(rng, w) if rng.random() < 0.3 else w for w in REQUIRED_STATEMENT.split()]
        text = " ".join(words)
        rows.append((f"L{i}", "w", [text, text.upper(), text.lower()][i % 3]))
    rows += [("none", None, "Surge0n"), ("null", "w", None), ("empty", "w", ""), ("other", "unknown", "Surge0n")]
    texts = spark.createDataFrame(rows, "label_id string, wording string, text string")
    statements = wordings(spark, {"w": REQUIRED_STATEMENT})
    got = {r.label_id: r.corrected for r in corrected(texts, statements).collect()}
    reference = sorted({r[0] for r in statements.select(F.explode(upper_words(F.col("text")))).collect()})
    want = {r.label_id: r.t for r in texts.where("wording = 'w' and text <> ''").select("label_id", correct_words(F.col("text"), reference).alias("t")).collect()}
    assert {k: v for k, v in got.items() if k in want} == want
    assert (got["none"], got["null"], got["empty"], got["other"]) == ("Surge0n", None, "", "Surge0n")
    assert any(got[f"L{i}"] != rows[i][2] for i in range(60))
