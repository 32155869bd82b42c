"""Benchmark decontamination by winnowing: shared spans of words between two text tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.bitset import build_filter, may_hold
from labelspark.llm.hashing import run_hashes, word_hashes
from labelspark.llm.stored import stored
from labelspark.llm.tasks import batch as batch_of
from labelspark.llm.tasks import map_batches

#: ASCII letters are lowered, other ASCII characters but digits part words.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text."""
    return (text or "").encode().translate(_FOLD).split()


@dataclass(frozen=True)
class Winnowing:
    """Shared spans of `span` words hold a run of `k` words that both sides select.

    Of each `span - k + 1` runs in a row the one with the smallest hash is selected, so texts
    that share a span share the selected run within it.
    """

    span: int = 10
    k: int = 5

    def selected(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the selected runs of a text with at least `span` words."""
        runs = run_hashes(hashes, self.k)
        window = self.span - self.k + 1
        least = np.lib.stride_tricks.sliding_window_view(runs, window).argmin(axis=1)
        at = np.unique(least + np.arange(len(least)))
        return at, runs[at]


_PRINTS = pa.schema(
    [("owner", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("at", pa.int32()),
     ("before", pa.list_(pa.binary())), ("run", pa.binary()), ("after", pa.list_(pa.binary()))]
)
_PRINT_KIND = (
    "owner long, n int, fp long, at int, before array<binary>, run binary, after array<binary>"
)


def _print(owner: int, n: int, fp: int, at: int, words: list[bytes], reach: int) -> tuple:
    before = words[max(0, at - reach) : at][::-1]
    return owner, n, fp, at, before, b" ".join(words[at : at + n]), words[at + n : at + n + reach]


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return batch_of(_PRINTS, *(zip(*rows) if rows else [[]] * 7))


def item_prints(items: DataFrame, w: Winnowing) -> DataFrame:
    """Selected runs of the items (owner, text), with the words around them.

    An item of fewer words than a span is one run of all its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for owner, text in zip(b.column("owner").to_pylist(), b.column("text").to_pylist()):
                words = words_of(text)
                hashes = word_hashes(words)
                if len(words) >= w.span:
                    for at, fp in zip(*(x.tolist() for x in w.selected(hashes))):
                        rows.append(_print(owner, w.k, _signed(fp), at, words, w.span - w.k))
                elif words:
                    n = len(words)
                    rows.append((owner, -n, _signed(int(run_hashes(hashes, n)[0])), 0, [], b" ".join(words), []))
            yield _as_batch(rows)

    return map_batches(items, run, _PRINT_KIND)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _document_rows(docs: DataFrame, w: Winnowing, bits, shorter: list[int]) -> DataFrame:
    """Each row of `docs` with its word count and the runs that an item may share.

    shorter: numbers of words of the items that are shorter than a span.
    """
    kind = "doc_id long, n_words long, raw_sha256 string, prints array<struct<n int, fp long, at int, before array<binary>, run binary, after array<binary>>>"
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()),
         ("raw_sha256", pa.string()),
         ("prints", pa.list_(pa.struct(list(_PRINTS)[1:])))]
    )
    names = _PRINTS.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, prints = [], [], []
            for text in b.column("text").to_pylist():
                digests.append(hashlib.sha256((text or "").encode()).hexdigest())
                words = words_of(text)
                counts.append(len(words))
                own = []
                if words:
                    hashes = word_hashes(words)
                    if len(words) >= w.span:
                        at, fps = w.selected(hashes)
                        keep = may_hold(bits.value, fps)
                        for a, fp in zip(at[keep].tolist(), fps[keep].tolist()):
                            own.append(dict(zip(names, _print(0, w.k, _signed(fp), a, words, w.span - w.k)[1:])))
                    for n in shorter:
                        fps = run_hashes(hashes, n)
                        for a in np.flatnonzero(may_hold(bits.value, fps)).tolist():
                            own.append(dict(zip(names, (-n, _signed(int(fps[a])), a, [], b" ".join(words[a : a + n]), []))))
                prints.append(own)
            yield batch_of(schema, b.column("doc_id"), counts, digests, prints)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, kind)


def _agree(a: str, b: str):
    """How many words two lists share from their start."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differ == 0, F.least(F.size(a), F.size(b))).otherwise(differ - 1)


def shared_spans(rows: DataFrame, items: DataFrame, w: Winnowing) -> DataFrame:
    """(row, owner, from, to): spans of a document row that occur in an item, words [from, to)."""
    runs = rows.select("row", F.explode("prints").alias("p")).select("row", "p.*")
    theirs = items.select(
        "owner", "n", "fp", "run", F.col("before").alias("item_before"), F.col("after").alias("item_after")
    ).distinct()
    met = runs.join(theirs, ["n", "fp", "run"])
    left, right = _agree("before", "item_before"), _agree("after", "item_after")
    spans = met.select(
        "row", "owner", "n",
        F.when(F.col("n") < 0, F.col("at")).otherwise(F.col("at") - left).cast("int").alias("from"),
        F.when(F.col("n") < 0, F.col("at") - F.col("n")).otherwise(F.col("at") + F.col("n") + right).cast("int").alias("to"),
    )
    return spans.where((F.col("n") < 0) | (F.col("to") - F.col("from") >= w.span)).select("row", "owner", "from", "to")


def contamination(
    docs: DataFrame, items: DataFrame, span: int = 10, k: int = 5
) -> DataFrame:
    """Words of `docs` (doc_id, text) that lie in a span that occurs in `items` (item_id, text).

    A span is `span` consecutive words of an item, or all words of a shorter item. Returns one
    row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated,
    raw_sha256 (of the text). Null
    and empty texts have no words and hit nothing; repeated rows and null doc_ids each get
    their row; items with a null id count as one item without a name. Further columns are
    ignored. An empty table on either side gives no hits.

    Documents send only runs that pass a bit filter of the items' runs, whose size is bounded;
    the join then compares the runs' words and the words around them.
    """
    w = Winnowing(span, k)
    named = items.select(F.col("item_id").cast("long").alias("owner"), "text")
    prints = stored(item_prints(named, w))
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(build_filter(prints, "fp", prints.count()))
    shorter = sorted(-r["n"] for r in prints.select("n").where("n < 0").distinct().collect())
    rows = stored(_document_rows(docs, w, bits, shorter).withColumn("row", F.monotonically_increasing_id()))
    spans = shared_spans(rows, prints, w)
    hit = (
        spans.groupBy("row")
        .agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"), F.collect_set(F.col("owner").cast("string")).alias("items"))
        .select(
            "row",
            F.aggregate(
                "spans",
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                lambda s, x: F.struct(
                    (s["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["from"], s["end"]))).alias("n"),
                    F.greatest(s["end"], x["to"]).alias("end"),
                ),
            )["n"].cast("long").alias("hit"),
            F.sort_array("items").alias("items"),
        )
    )
    none = F.array().cast("array<string>")
    return rows.drop("prints").join(hit, "row", "left").select(
        "doc_id", "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
        "raw_sha256",
    )
