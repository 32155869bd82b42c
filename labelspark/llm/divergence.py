"""Divergence of sources from their language: exact smoothed term shares, counted by transducers."""

from __future__ import annotations

import io
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.stored import stored
from labelspark.llm.tasks import map_batches, send_code
from labelspark.llm.transducer import SLICE, Transducer, build_transducer, dense_bytes, folded_slices, term_stretches
from labelspark.llm.vectors import frame, groups_of


@dataclass(frozen=True)
class AuditSettings:
    """What is counted (first line of fields) and bounds of memory (the others).

    shard: terms of one transducer; pass_bytes: tables of the transducers that a task holds in
    one pass over the texts; held: distinct counts that a task gathers before it hands them on;
    block and tile: terms and sources that are compared in one task.
    """

    least_docs: int = 30
    added: int = 5
    scale_thousands: int = 3
    top: int = 50

    shard: int = 20_000
    pass_bytes: int = 64 << 20
    held: int = 300_000
    block: int = 2048
    tile: int = 128


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def document_counts(docs: DataFrame, s: AuditSettings) -> DataFrame:
    """(lang, term, docs): how many documents of a language hold a term."""
    kind = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64())])

    def rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            terms = pa.array(list(counter), pa.binary()).cast(pa.string())
            lang_column = pa.array([lang] * len(terms), pa.string())
            yield pa.RecordBatch.from_arrays([lang_column, terms, pa.array(list(counter.values()), pa.int64())], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                terms: set[bytes] = set()
                for part in folded_slices(text):
                    terms.update(part.split())
                held[lang].update(terms)
                if sum(map(len, held.values())) > s.held:
                    yield from rows(held)
                    held.clear()
        yield from rows(held)

    partial = map_batches(docs.select("lang", "text"), run, "lang string, term string, docs long")
    return partial.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def _pack(edges: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **edges)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


def vocabulary(kept: DataFrame, s: AuditSettings) -> DataFrame:
    """(lang, base, n, terms, size, machine): transducers over sorted runs of a language's terms.

    Terms are sorted by a range exchange, so each partition holds runs of them; a run of at
    most `shard` terms becomes one transducer. `base` is the ordinal of its first term among
    all terms of the language, in the order of their UTF-8 bytes.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
        lang, terms = None, []
        for b in batches:
            for now, term in zip(b.column("lang").to_pylist(), b.column("term").to_pylist()):
                if terms and (now != lang or len(terms) == s.shard):
                    yield lang, terms
                    terms = []
                lang = now
                terms.append(term)
        if terms:
            yield lang, terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, terms in runs(batches):
            edges = build_transducer([t.encode() for t in terms])
            row = {"lang": lang, "first": terms[0], "n": len(terms), "terms": terms, "size": dense_bytes(edges), "machine": _pack(edges)}
            yield pa.RecordBatch.from_pylist([row], schema=kind)

    kind = pa.schema([
        ("lang", pa.string()), ("first", pa.string()), ("n", pa.int64()), ("terms", pa.list_(pa.string())),
        ("size", pa.int64()), ("machine", pa.binary()),
    ])
    ranged = kept.repartitionByRange(groups_of(kept.count(), s.shard), "lang", "term").sortWithinPartitions("lang", "term")
    parts = stored(map_batches(ranged, run, "lang string, first string, n long, terms array<string>, size long, machine binary"))
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("lang", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return parts.join(bases, ["lang", "first"]).drop("first")


def _passes(parts: DataFrame, limit: int) -> Iterator[list[tuple[str, int]]]:
    """(lang, base) of the transducers of each pass over the texts; one pass at least."""
    some, held = [], 0
    for r in parts.select("lang", "base", "size").orderBy("lang", "base").collect():
        if some and held + r["size"] > limit:
            yield some
            some, held = [], 0
        some.append((r["lang"], r["base"]))
        held += r["size"]
    yield some


class _Counts:
    """Counts by (group, ordinal) of a task, merged as arrays."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.keys, self.counts, self.size = [], [], 0

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    def merge(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.counts, self.size = [keys[first]], [np.add.reduceat(counts, first)], len(first)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What has been counted, and for each group a row with ordinal -1 and count 0."""
        if self.keys:
            self.merge()
        keys = np.concatenate([np.arange(len(self.groups), dtype=np.int64) << 32 | 0xFFFFFFFF, *self.keys])
        counts = np.concatenate([np.zeros(len(self.groups), dtype=np.int64), *self.counts])
        for at in range(0, len(keys), 50_000):
            some = keys[at : at + 50_000]
            group = pa.array((some >> 32).astype(np.int64))
            names = [pa.array([g[i] for g in self.groups], pa.string()).take(group) for i in (0, 1)]
            ordinal = (some & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*names, pa.array(ordinal), pa.array(counts[at : at + 50_000].astype(np.int64))],
                names=["lang", "source", "ordinal", "n"],
            )
        self.__init__()


def _recounted(docs: DataFrame, machines: dict[str, list[tuple[int, bytes]]], s: AuditSettings) -> DataFrame:
    """(lang, source, ordinal, n) of all texts streamed through the transducers of their language.

    Rows of a task, not summed over tasks; ordinal -1 stands for a group as such.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = {lang: [(base, Transducer(_unpack(m))) for base, m in some] for lang, some in sent.value.items()}
        counts = _Counts()
        waiting: dict[str, tuple[list[bytes], list[int]]] = defaultdict(lambda: ([], []))
        sizes: Counter = Counter()

        def count(lang: str) -> None:
            parts, groups = waiting.pop(lang)
            sizes[lang] = 0
            data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
            begins = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
            starts, ends = term_stretches(data)
            of = np.array(groups, dtype=np.int64)[np.searchsorted(begins, starts, side="right") - 1] << 32
            for base, tool in tools[lang]:
                which, ordinals = tool.ordinals(data, starts, ends)
                counts.add(of[which] | (ordinals + base))

        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                group = counts.group(lang, source)
                if lang not in tools:
                    continue
                for part in folded_slices(text):
                    waiting[lang][0].append(part)
                    waiting[lang][1].append(group)
                    sizes[lang] += len(part)
                    if sizes[lang] >= SLICE:
                        count(lang)
                        if counts.size > s.held:
                            counts.merge()
                if counts.size > s.held or len(counts.groups) > s.held:
                    for waits in list(waiting):
                        count(waits)
                    yield from counts.rows()
        for lang in list(waiting):
            count(lang)
        yield from counts.rows()

    return map_batches(docs, run, "lang string, source string, ordinal int, n long")


def shares(counts: np.ndarray, totals: np.ndarray, added: int, kept: int, thousands: int) -> np.ndarray:
    """1 + floor(1000**thousands * (count + added) / (total + added * kept)), by long division."""
    rest = counts + added
    by = (totals + added * kept)[:, None]
    whole = np.zeros_like(rest)
    for _ in range(thousands):
        rest = rest * 1000
        whole = whole * 1000 + rest // by
        rest %= by
    return whole + 1


def _differences(s: AuditSettings):
    """Function that sums |p - q| over a block of terms for all pairs of two tiles of sources."""
    kind = {"lang": object, "one": np.int64, "other": np.int64, "value": np.int64}

    def compare(key: tuple, counts: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        lang, block, i, j = key
        if sources.empty:
            return frame([], **kind)
        sources = sources.sort_values("number", ignore_index=True)
        kept, numbers = int(sources["kept"][0]), sources["number"].to_numpy()
        width = min(s.block, kept - block * s.block)
        table = np.zeros((len(sources), max(width, 0)), dtype=np.int64)
        if len(counts):
            table[np.searchsorted(numbers, counts["at"].to_numpy()), counts["ordinal"].to_numpy() - block * s.block] = counts["n"]
        p = shares(table, sources["total"].to_numpy(), s.added, kept, s.scale_thousands) if width > 0 else table
        tile = numbers // s.tile
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        found = frame([(lang, numbers[a], numbers[right], np.abs(p[right] - p[a]).sum(axis=1)) for a in left], **kind)
        if i != j:
            found = pd.concat([found, found.rename(columns={"one": "other", "other": "one"})])
        return found[found["one"] != found["other"]][list(kind)]

    return compare


def _pairs(counts: DataFrame, groups: DataFrame, s: AuditSettings) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language."""
    tile = F.floor(F.col("number") / s.tile).cast("int")
    tiles = F.floor((F.col("sources") - 1) / s.tile).cast("int")
    # a source meets the tiles from its own on as the left one, those up to its own as the right one
    meets = F.explode(F.expr("transform(sequence(0, tiles), x -> struct(least(x, tile) as i, greatest(x, tile) as j))"))
    placed = groups.withColumn("tile", tile).withColumn("tiles", tiles)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") / s.block)).cast("int")
    left = (
        counts.join(placed.select("lang", "source", "number", "tile", "tiles"), ["lang", "source"])
        .withColumn("t", meets)
        .select("lang", F.floor(F.col("ordinal") / s.block).cast("int").alias("block"), "t.i", "t.j", F.col("number").alias("at"), "ordinal", "n")
    )
    right = (
        placed.withColumn("t", meets).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("lang", "block", "t.i", "t.j", "number", "total", "kept")
    )
    by = ["lang", "block", "i", "j"]
    sums = (
        left.groupBy(*by).cogroup(right.groupBy(*by))
        .applyInPandas(_differences(s), "lang string, one long, other long, value long")
        .groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    )
    names = groups.select("lang", "number", "source")
    return (
        sums.join(names.withColumnRenamed("number", "one"), ["lang", "one"])
        .join(names.select("lang", F.col("number").alias("other"), F.col("source").alias("item")), ["lang", "other"])
        .select("lang", "source", "item", "value")
    )


def _terms(counts: DataFrame, groups: DataFrame, parts: DataFrame, s: AuditSettings) -> DataFrame:
    """(lang, source, item, value, rank) of the terms that a source holds more of than its language."""
    share = "1 + (cast({0} as decimal(38,0)) * ({1} + {3})) div ({2} + {3} * kept)"
    ours = share.format(1000**s.scale_thousands, "n", "total", s.added)
    theirs = share.format(1000**s.scale_thousands, "lang_n", "lang_total", s.added)
    in_lang = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    ranked = (
        counts.join(in_lang, ["lang", "ordinal"])
        .join(groups.select("lang", "source", "total", "kept"), ["lang", "source"]).join(totals, "lang")
        .withColumn("value", F.expr(f"({ours}) - ({theirs})")).where("n > 0 and value > 0")
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.top)
    )
    names = parts.select("lang", "base", F.posexplode("terms").alias("at", "item"))
    names = names.select("lang", (F.col("base") + F.col("at")).cast("int").alias("ordinal"), "item")
    return ranked.join(names, ["lang", "ordinal"]).select("lang", "source", "item", "value", "rank")


def source_divergence(docs: DataFrame, s: AuditSettings = AuditSettings()) -> DataFrame:
    """How far the sources of each language are from each other, and which terms mark them.

    Reads lang, source and text of `docs`; nulls count as empty, other columns are ignored.
    Terms are runs of ASCII letters and of characters beyond ASCII, only A-Z lower-cased. Each
    language keeps the V terms that at least `least_docs` of its documents hold. A (lang, source)
    group gives a kept term the share p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being all its
    occurrences of kept terms; a language does likewise. Returns lang, source, part, item, value
    (long), rank (int, from 1 per group and part; larger values first, then smaller items):

    * part `pair`: the other sources of the language, value the sum of |p - q| over kept terms
      (0 if there is none), all of them;
    * part `term`: the terms that occur in the group and have p > q, q being the language's share,
      value p - q, the first `top`.

    A source alone in its language has no pair; an empty table gives no rows; repeated rows are
    documents of their own. All arithmetic is in integers.

    Texts are read twice: once for the documents of each term, once streamed through the minimal
    transducers of the kept terms. If their tables pass `pass_bytes`, the second reading is
    repeated with the next of them; no task or broadcast holds more.
    """
    spark = docs.sparkSession
    send_code(spark.sparkContext)
    texts = _texts(docs)
    kept = stored(document_counts(texts, s).where(F.col("docs") >= s.least_docs).select("lang", "term"))
    parts = stored(vocabulary(kept, s))
    partial = []
    for some in _passes(parts, s.pass_bytes):
        chosen = parts.join(F.broadcast(spark.createDataFrame(some, "lang string, base long")), ["lang", "base"])
        machines: dict[str, list[tuple[int, bytes]]] = defaultdict(list)
        for r in chosen.select("lang", "base", "machine").collect():
            machines[r["lang"]].append((r["base"], bytes(r["machine"])))
        partial.append(stored(_recounted(texts, dict(machines), s)))
    counts = partial[0]
    for more in partial[1:]:
        counts = counts.unionByName(more)
    counts = stored(counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))
    vocabularies = parts.groupBy("lang").agg(F.sum("n").alias("kept"))
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = stored(
        counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        .join(vocabularies, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
        .withColumn("number", (F.row_number().over(numbered) - 1).cast("long"))
        .withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    )
    found = counts.where("ordinal >= 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(found, groups, s).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = _terms(found, groups, parts, s).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return pairs.select(*columns).unionByName(terms.select(*columns))
