"""Language identification by nearest of several centroids per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.tasks import batch as batch_of
from labelspark.llm.tasks import map_batches

_OTHER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageSettings:
    """sample: labelled rows of each language that centroids are fitted on, at most.

    The sample is taken by the order of a hash of doc_id, one row an id; its bound does not
    depend on the table. places: hashed n-gram features. centroids: clusters of each language. Texts whose
    best cosine is under the `reject` quantile of their language's training cosines, less a
    tenth, are marked as rejected.
    """

    sample: int = 400
    places: int = 1 << 13
    grams: int = 3
    centroids: int = 4
    rounds: int = 12
    reject: float = 0.005


def gram_counts(text: str, s: LanguageSettings) -> np.ndarray:
    """Counts of hashed letter n-grams, word ends included; case is folded, other signs drop."""
    codes = np.frombuffer(f" {_OTHER.sub(' ', text.lower())} ".encode("utf-32-le"), dtype=np.uint32)
    out = np.zeros(s.places, dtype=np.int64)
    run = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, s.grams + 1):
        run = run[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :] + np.uint32(n)
        if not len(run):
            break
        mixed = run * np.uint32(0x85EBCA6B)
        out += np.bincount((mixed ^ (mixed >> np.uint32(15))) % np.uint32(s.places), minlength=s.places)
    return out


def normalised(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length one; a row without features stays zero."""
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


@dataclass
class LanguageModel:
    settings: LanguageSettings
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and rejection of each text; `und` if it has no letter."""
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rejected = np.ones(len(texts), dtype=bool)
        real = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        for at in range(0, len(real), 256):
            some = real[at : at + 256]
            x = normalised(np.stack([gram_counts(texts[i], self.settings) for i in some]), self.idf)
            cosine = x @ self.centroids.T
            best = cosine.argmax(axis=1)
            for i, b, c in zip(some, best, cosine[np.arange(len(some)), best]):
                names[i] = self.languages[self.owner[b]]
                score[i] = min(max(float(c), 0.0), 1.0)
                rejected[i] = c < self.least[self.owner[b]]
        return names, score, rejected


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from; a null doc_id is held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(3)) == 1, F.lit(True))


def _clusters(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means; starts from rows that are far from those chosen before."""
    chosen = [0]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centre = x[chosen]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        sums = np.stack([x[near == j].sum(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre


_COUNTS = pa.schema([("lang", pa.string()), ("place", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])


def fit_languages(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Fit on rows of `docs` (doc_id, text, lang) that are not held out and have text and lang.

    Without such rows the model knows no language and answers `und`.
    """
    s, spark = settings, docs.sparkSession
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out()
    ).select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    order = [F.xxhash64(F.col("doc_id"), F.lit(5)), F.col("doc_id")]
    few = known.distinct()
    # first in parts of a language, then over what those leave: no task gets a whole language
    for by in (["lang", F.pmod(F.hash("doc_id"), F.lit(64))], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        few = few.withColumn("place", place).where(F.col("place") <= s.sample).select("doc_id", "lang")
    names = spark.createDataFrame([tuple(r) for r in few.collect()], "doc_id long, lang string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places, counts = [], []
            for text in b.column("text").to_pylist():
                c = gram_counts(text, s)
                at = np.flatnonzero(c)
                places.append(at.astype(np.int32))
                counts.append(c[at].astype(np.int32))
            yield batch_of(_COUNTS, b.column("lang"), places, counts)

    read = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    first = F.min_by("text", F.xxhash64("text"))  # of rows with one id and language
    once = read.join(F.broadcast(names), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(first.alias("text"))
    table = map_batches(once.select("lang", "text"), run, "lang string, place array<int>, n array<int>").toArrow()
    labels = np.array(table.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(labels.tolist()))
    df = np.zeros(s.places)
    rows = list(zip(table.column("place").to_pylist(), table.column("n").to_pylist()))
    for place, _ in rows:
        df[place] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 0.1
    parts, owner, least = [], [], []
    for i, lang in enumerate(languages):
        dense = np.zeros((int((labels == lang).sum()), s.places), dtype=np.float32)
        for r, j in enumerate(np.flatnonzero(labels == lang)):
            dense[r, rows[j][0]] = rows[j][1]
        x = normalised(dense, idf)
        centre = _clusters(x, s.centroids, s.rounds)
        parts.append(centre)
        owner += [i] * len(centre)
        least.append(float(np.quantile((x @ centre.T).max(axis=1), s.reject)) * 0.9)
    centroids = np.concatenate(parts) if parts else np.zeros((0, s.places), np.float32)
    return LanguageModel(s, languages, idf, centroids, np.array(owner, dtype=int), np.array(least))


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, lang_pred, score, rejected.

    lang_pred is the nearest centroid's language, also where the distance rejects it; texts
    that are null or have no letter are `und` with score 0. Repeated rows and null doc_ids are
    predicted like any other; further columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(_PREDICTED, b.column("doc_id"), *sent.value.predict(b.column("text").to_pylist()))

    told = map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
        "doc_id long, lang_pred string, score double, rejected boolean",
    )
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
