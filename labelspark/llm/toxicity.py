"""Toxicity: a linear classifier that is penalised where swapped identity terms move its score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.tasks import batch as batch_of
from labelspark.llm.tasks import map_batches

#: Terms that a sentence may swap for one another without its toxicity changing.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "lesbian", "straight", "transgender"),
    ("immigrants", "natives", "refugees"), ("old", "young"), ("blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwule", "lesben"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_WORD = re.compile(r"[^\W\d_]+")
_PLACES = 1 << 18


@dataclass(frozen=True)
class ToxicitySettings:
    """sample: labelled rows of each class that the model is fitted on, at most.

    The sample is taken by the order of a hash of doc_id, and its bound does not depend on the
    table. features: features kept by document frequency difference. counterfactual: weight of
    the squared score change under a swap of identity terms.
    """

    sample: int = 3000
    features: int = 20_000
    counterfactual: float = 5.0
    sparsity: float = 2e-4
    rounds: int = 300
    identity: tuple[tuple[str, ...], ...] = IDENTITY_TERMS


@dataclass
class ToxicityModel:
    """Weights of hashed features that are not zero; the score of no feature is the bias alone."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        memo: dict[str, tuple[int, ...]] = {}
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            found: set[int] = set()
            for w in set(_WORD.findall((text or "").lower())):
                own = memo.get(w)
                if own is None:
                    own = tuple(f for f in word_features(w) if f in self.weights)
                    if len(memo) < 500_000:
                        memo[w] = own
                found.update(own)
            out[i] = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def word_features(word: str) -> list[int]:
    """Places of a word and of its first four, five and six letters."""
    parts = [f"={word}"] + [f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n]
    return [xxhash.xxh3_64_intdigest(p.encode()) % _PLACES for p in parts]


def features_of(words: set[str]) -> set[int]:
    return {f for w in words for f in word_features(w)}


def swapped(words: set[str], identity: tuple[tuple[str, ...], ...]) -> set[str]:
    """The words with each identity term replaced by the next one of its group."""
    following = {t: group[(i + 1) % len(group)] for group in identity for i, t in enumerate(group)}
    return {following.get(w, w) for w in words}


def _crc_class(doc_id: str, modulus: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from; a null doc_id is held out."""
    return F.coalesce(_crc_class(doc_id, 5) == 0, F.lit(True))


_EXAMPLES = pa.schema([("toxic", pa.int64()), ("real", pa.list_(pa.int32())), ("swap", pa.list_(pa.int32()))])


def _examples(docs: DataFrame, labels: DataFrame, s: ToxicitySettings) -> list:
    """Bounded sample of labelled rows, as feature places of the text and of its counterfactual."""
    spark = docs.sparkSession
    judged = (
        labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("long").alias("toxic")).where(~held_out())
    )
    present = judged.join(docs.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    chosen = [
        r for kind in (F.col("toxic") > 0, F.col("toxic") <= 0)
        for r in present.where(kind).orderBy(order, "doc_id").limit(s.sample).collect()
    ]
    names = spark.createDataFrame([(r["doc_id"], int(r["toxic"] > 0)) for r in chosen], "doc_id long, toxic long")
    identity = s.identity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            real, swap = [], []
            for text in b.column("text").to_pylist():
                words = set(_WORD.findall((text or "").lower()))
                real.append(sorted(features_of(words)))
                other = swapped(words, identity)
                swap.append(sorted(features_of(other)) if other != words else [])
            yield batch_of(_EXAMPLES, b.column("toxic"), real, swap)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(names), "doc_id")
    first = F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text")))  # of rows with one id
    once = read.groupBy("doc_id", "toxic").agg(first.alias("text"))
    return map_batches(once.select("toxic", "text"), run, "toxic long, real array<int>, swap array<int>").toArrow()


def _sparse(lists: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and kept feature numbers of lists of places."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    cols = place[np.concatenate(lists)] if lists else np.zeros(0, np.int64)
    keep = cols >= 0
    return rows[keep], cols[keep]


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel:
    """Fit on `docs` (doc_id, text) and `labels` (doc_id, toxic), held-out rows left aside.

    Logistic loss with equal weight of both classes, an l1 penalty that leaves few features,
    and `counterfactual` times the mean squared change of the raw score under swapped identity
    terms. Without rows of both classes the model scores every text by their share (0.0 if
    there are none).
    """
    table = _examples(docs, labels, settings)
    y = table.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.0
        return ToxicityModel(bias=20.0 if share > 0.5 else -20.0)
    real = [np.asarray(x, dtype=np.int64) for x in table.column("real").to_pylist()]
    swap = [np.asarray(x, dtype=np.int64) for x in table.column("swap").to_pylist()]
    share = [np.bincount(np.concatenate([x for x, t in zip(real, y) if t == c]), minlength=_PLACES) / (y == c).sum() for c in (0, 1)]
    kept = np.argsort(-np.abs(share[1] - share[0]), kind="stable")[: settings.features]
    place = np.full(_PLACES, -1, dtype=np.int64)
    place[kept] = np.arange(len(kept))
    rows, cols = _sparse(real, place)
    pairs = [i for i, x in enumerate(swap) if len(x)]
    plus, minus = _sparse([real[i] for i in pairs], place), _sparse([swap[i] for i in pairs], place)
    return _descend(y, rows, cols, plus, minus, len(pairs), kept, settings)


def _descend(y, rows, cols, plus, minus, pairs, kept, s: ToxicitySettings) -> ToxicityModel:
    """Accelerated proximal gradient steps over the sparse examples."""
    n, d = len(y), len(kept)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))

    def times(r, c, v, size):
        return np.bincount(r, weights=v[c], minlength=size)

    def change(v):
        return times(*plus, v, pairs) - times(*minus, v, pairs) if pairs else np.zeros(0)

    def gradient(v, b):
        error = weight * (1 / (1 + np.exp(-np.clip(times(rows, cols, v, n) + b, -30, 30))) - y)
        g = np.bincount(cols, weights=error[rows], minlength=d)
        if pairs:
            delta = 2 * s.counterfactual / pairs * change(v)
            g += np.bincount(plus[1], weights=delta[plus[0]], minlength=d) - np.bincount(minus[1], weights=delta[minus[0]], minlength=d)
        return g, error.sum()

    most = np.bincount(rows, minlength=n).max() if len(rows) else 1
    v = np.ones(d) / np.sqrt(max(d, 1))
    size = 0.0
    for _ in range(20):  # largest eigenvalue of the loss's curvature bound
        u = np.bincount(cols, weights=(0.25 * weight * times(rows, cols, v, n))[rows], minlength=d)
        if pairs:
            delta = 2 * s.counterfactual / pairs * change(v)
            u += np.bincount(plus[1], weights=delta[plus[0]], minlength=d) - np.bincount(minus[1], weights=delta[minus[0]], minlength=d)
        size = np.linalg.norm(u)
        v = u / size if size else v
    step = 1 / max(1.2 * size + 0.25, 1e-6 * most)
    w = z = np.zeros(d)
    b = bz = 0.0
    t = 1.0
    for _ in range(s.rounds):
        g, gb = gradient(z, bz)
        new = z - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * s.sparsity, 0)
        nb = bz - step * gb
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, bz = new + (t - 1) / after * (new - w), nb + (t - 1) / after * (nb - b)
        w, b, t = new, nb, after
    return ToxicityModel(float(b), {int(kept[i]): float(w[i]) for i in np.flatnonzero(w)})


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts get the model's bias; repeated rows and null doc_ids are scored like
    any other; further columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of(_SCORES, b.column("doc_id"), sent.value.scores(b.column("text").to_pylist()))

    scored = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs` that score under 0.5, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = sent.value.scores(b.column("text").to_pylist()) < 0.5
            yield b.filter(pa.array(low))

    return map_batches(docs, run, docs.schema)
