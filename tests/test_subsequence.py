"""Longest common subsequences of batches, and the comparisons that take them from there."""

from __future__ import annotations

import itertools
import random
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from labelspark.functions import similarity as S
from labelspark.functions import subsequence as Q
from labelspark.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
REASONS = {
    "empty", "exact", "exact_ocr_normalized", "empty_tokens", "token_containment", "token_containment_ocr_normalized",
    "reverse_containment", "reverse_containment_partial", "reverse_containment_ocr_normalized", "reverse_containment_generic",
    "reverse_containment_partial_ocr", "reverse_containment_generic_ocr", "substring", "fuzzy_token", "fuzzy_ratio",
}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def text(rng):
    letters = "abc é一😀\x00"[: rng.randint(1, 8)]
    return "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 20, 62, 63, 64, 65, 130])))


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(5)
    return [("", ""), (None, "x"), ("a", None), (None, None), ("a" * 63, "a" * 64), ("ab" * 60, "ba" * 63)] + [
        (text(rng), text(rng)) for _ in range(400)
    ]


@pytest.mark.parametrize("masks, octets", [(Q.MASKS, Q.OCTETS), (8, Q.OCTETS), (Q.MASKS, 64)])
def test_batches_against_brute_force(pairs, masks, octets, monkeypatch):
    monkeypatch.setattr(Q, "MASKS", masks)
    monkeypatch.setattr(Q, "OCTETS", octets)
    a, b = (pa.array(c, pa.string()) for c in zip(*pairs))
    want = [lcs(x or "", y or "") for x, y in pairs]
    assert Q.common_lengths(a, b).tolist() == want
    assert Q.common_lengths(a[3:200], b[3:200]).tolist() == want[3:200]
    assert Q.common_lengths(a[:0], b[:0]).tolist() == []
    plain = [(x, y) for x, y in pairs if x and y and (x + y).isascii()]
    assert Q.common_lengths(*(pa.array(c) for c in zip(*plain))).tolist() == [lcs(x, y) for x, y in plain]


def test_executors_need_no_copy_of_the_package(tmp_path):
    with open(tmp_path / "f", "wb") as f:
        cloudpickle.dump(Q.common_lengths, f)
    code = "import pickle, sys, pyarrow as pa; f = pickle.load(open('f', 'rb')); print(f(pa.array(['abc']), pa.array(['xaxc']))); assert 'labelspark' not in sys.modules"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin"}, capture_output=True, text=True)
    assert done.stdout == "[2]\n", done.stderr


def test_known_readings_change_nothing(spark):
    texts = [
        None, "", "  ", "...", "Rye", "Rye.", "RYE, Straight", "Straight  Rye Whisky", "straight rye whiskey", "Ale", "a1e", "ale a1e pa1e", "ale pa1e", "Pale Ale",
        "ALE ALE", "Wood", "Woodford Reserve", "ABC DISTILERY", "ABC Distillery", "Merlot", "American Red Wine", "B0urb0n 158", "bourbon isb", "bourbon",
        "Bourbon Isb Dist", "wine red american", "x" * 70, "x y " * 40, "«é» İıſ ß", "É", "1O5", "ios ios", "rye  \x1crye", "😀 rye", "co", "c0 inc", "1nc",
    ]
    rows = spark.createDataFrame([*itertools.product(texts, texts)], "a string, b string")
    rows = rows.select("a", "b", S.text_form(F.col("a")).alias("x"), S.text_form(F.col("b")).alias("y"))
    rows = rows.withColumn("common", S.common_lengths(F.col("x"), F.col("y")))
    pair, known = (F.col("a"), F.col("b")), S.Reading(F.col("x"), F.col("y"), F.col("common"))
    found = rows.select(
        *pair, S.similarity(*pair).alias("s"), S.similarity(*pair, known=known).alias("s2"),
        S.smart_match(*pair).alias("m"), S.smart_match(*pair, known=known).alias("m2"),
    ).collect()
    assert len(found) == len(texts) ** 2
    assert [(r.a, r.b) for r in found if r.s != r.s2 or r.m != r.m2] == []
    assert {r.m.reason for r in found} <= REASONS and len({r.m.reason for r in found}) > 9


def test_block_similarity_takes_its_lengths_from_batches(spark):
    ratios = QUERIES["block_similarity"](spark, SMALL).select("label_id", "ratio")
    plan = ratios._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "bit_count" not in plan and "Broadcast" not in plan
