"""Bounded samples and memory, names that clash, and plain recomputation of predictions."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from labelspark.llm import tokens
from labelspark.llm.exact import exact_duplicates
from labelspark.llm.keep import keep_rows
from labelspark.llm.langid import LanguageSettings, fit_languages, gram_counts, identify
from labelspark.llm.maglev import assign_shards, lookup_table
from labelspark.llm.toxicity import ToxicitySettings, _examples


def test_keep_rows_whatever_the_columns_are_called(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (3, "c"), (None, None)], "doc_id long, text string")
    docs = docs.select(
        "*", F.lit(7).alias("_place"), F.lit(8).alias("_stay"), F.lit(9).alias("_id"), F.lit("r").alias("_raw"), F.lit(5).alias("_row"),
        F.lit(1).alias("a.b"), F.create_map(F.lit("k"), F.lit(1)).alias("m"),
    )
    kept = keep_rows(docs, exact_duplicates(docs))
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r._place, r._stay, r._id, r._raw, r._row, r["a.b"], r.m["k"]) for r in kept.collect()), key=str)
    assert got == [(1, "a b", 7, 8, 9, "r", 5, 1, 1), (3, "c", 7, 8, 9, "r", 5, 1, 1), (None, None, 7, 8, 9, "r", 5, 1, 1)]


def test_encoder_stays_right_beyond_its_memory(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 3000)
    monkeypatch.setattr(tokens, "SLICE", 40)
    import pyarrow as pa

    texts = ["some plain words, again and again " * 3, None, "", "ünïcode 12:34 words!! " * 4, "x" * 90]
    plain = tokens.load_tokenizer(tokens.WORD_BPE)
    tool = tokens.Encoder()
    for _ in range(3):
        ids, ends = tool.encode(pa.array(texts))
        assert len(tool.memo) < 3000 // 200 + 1
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = list(tokens.encoded(pa.array(texts)))
    assert [x.tolist() for x in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def labelled(spark):
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rng = np.random.default_rng(3)
    rows = [
        (i, " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(12)), lang)
        for i in range(240) for lang in [("aa", "bb", "cc")[i % 3]]
    ]
    return spark.createDataFrame(rows + [(0, f"repeated {i}", "aa") for i in range(500)], "doc_id long, text string, lang string")


def test_language_sample_has_one_row_an_id_and_all_languages(labelled, spark):
    model = fit_languages(labelled, LanguageSettings(sample=20, centroids=2))
    assert model.languages == ["aa", "bb", "cc"]
    many = spark.createDataFrame([(i, f"word{i} {chr(97 + i % 26) * 4}", f"l{i:03}") for i in range(600)], "doc_id long, text string, lang string")
    known = {f"l{r.doc_id:03}" for r in many.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1").collect()}
    assert set(fit_languages(many, LanguageSettings(sample=2, places=64, rounds=1)).languages) == known


def test_languages_are_those_of_the_nearest_centroid(labelled):
    model = fit_languages(labelled, LanguageSettings(sample=20, centroids=2))
    for r, text in ((r, r.text) for r in identify(labelled, model).join(labelled, "doc_id").where("doc_id > 0").limit(40).collect()):
        tfidf = np.log1p(gram_counts(text, model.settings)) * model.idf
        cosines = [float(tfidf @ c / np.linalg.norm(tfidf)) for c in model.centroids]
        best = int(np.argmax(cosines))
        assert r.lang_pred == model.languages[model.owner[best]] and abs(r.score - cosines[best]) < 1e-4


def test_texts_without_a_letter_are_undetermined(labelled, spark):
    model = fit_languages(labelled, LanguageSettings(sample=20, centroids=2))
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ²", "١٢ 34", "_ -", "Ⅷ", "", None, "ª", "abc"])], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred == "und" for r in identify(odd, model).collect()}
    assert [got[i] for i in range(8)] == [True] * 6 + [False] * 2


def test_toxicity_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(700)] + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, toxic int")
    assert _examples(docs, labels, ToxicitySettings()).num_rows <= 7


def test_shards_follow_the_filled_table(spark):
    names, size = tuple(f"s{i}" for i in range(5)), 101
    # turns, one claim each, over every shard's own permutation of the slots
    permutations = [
        [(xxhash.xxh3_64_intdigest(n.encode(), seed=1) + k * (xxhash.xxh3_64_intdigest(n.encode(), seed=2) % (size - 1) + 1)) % size for k in range(size)]
        for n in names
    ]
    owner, turn = {}, 0
    while len(owner) < size:
        slot = next(x for x in permutations[turn % 5] if x not in owner)
        owner[slot], turn = turn % 5, turn + 1
    assert [owner[i] for i in range(size)] == lookup_table(names, size).tolist()
    docs = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long")
    got = assign_shards(docs, names, size).withColumn("want", F.expr(f"pmod(xxhash64(doc_id), {size})")).collect()
    assert len(got) == 201 and all(r.slot == r.want and r.shard == names[owner[r.slot]] for r in got)
