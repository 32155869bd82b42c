"""Packing of documents into fixed-length token sequences, by length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.stored import stored
from labelspark.llm.tasks import batch as batch_of
from labelspark.llm.tasks import map_batches
from labelspark.llm.tokens import WORD_BPE, encoded

#: Id that ends each document.
END_ID = 2
#: About as many pieces are numbered in one window group.
RANK_GROUP = 50_000

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
)


def document_ids(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """Each text's ids and the end id, as little-endian uint32; a null text has only the end."""
    end = np.array([END_ID], dtype="<u4")
    for ids in encoded(texts, path):
        yield np.concatenate((ids, end))


def token_pieces(docs: DataFrame, length: int, path: str = WORD_BPE) -> DataFrame:
    """Pieces of at most `length` tokens: doc_id, start, length, ids_crc32, doc_tokens.

    Every row of `docs` (doc_id, text) has pieces, repeated rows included; null and empty
    texts are one piece, the end id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), document_ids(batch.column("text"), path)):
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            yield batch_of(_PIECES, *(zip(*rows) if rows else [[]] * 5))

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return map_batches(docs.select("doc_id", "text"), cut, kind)


def shortest_pack_first(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int]]:
    """Slots (piece length, first rank, first sequence, offset) of a histogram of lengths.

    Lengths are placed longest first; a piece goes to the pack with the most space left. Packs
    with the same pattern are kept as one range of sequence numbers, so the work depends on
    the number of different lengths, not on the number of pieces. The pieces of a length with
    ranks from `first rank` up to the next slot's go to consecutive sequences.
    """
    by_space: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
    slots, sequences = [], 0
    for size in sorted(counts, reverse=True):
        todo, rank, space, moved = counts[size], 0, length, []
        while todo and space >= size:
            if not by_space[space]:
                space -= 1
                continue
            first, packs = by_space[space].pop()
            take = min(packs, todo)
            slots.append((size, rank, first, length - space))
            moved.append((space - size, first, take))
            if packs > take:
                by_space[space].append((first + take, packs - take))
            rank, todo = rank + take, todo - take
            if not todo or space < size:
                break
        if todo:
            slots.append((size, rank, sequences, 0))
            moved.append((length - size, sequences, todo))
            sequences += todo
        for left, first, packs in moved:
            by_space[left].append((first, packs))
    return slots


def ranked(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0, in `rank`.

    Numbers are given inside groups of about RANK_GROUP pieces and shifted by the groups'
    running counts, so a length that a third of all pieces have is no single task's work.
    """
    total = pieces.count()
    groups = max(1, -(-total // RANK_GROUP))
    grouped = pieces.withColumn("g", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    counts = grouped.groupBy("length", "g").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "g").orderBy("piece")) - 1
    return grouped.withColumn("inside", inside).join(base, ["length", "g"]).withColumn(
        "rank", F.col("base") + F.col("inside")
    ).drop("g", "base", "inside")


def pack(docs: DataFrame, length: int = 4096, path: str = WORD_BPE) -> DataFrame:
    """Pack documents (doc_id, text; further columns are ignored) into sequences.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Documents longer than a sequence are cut at its multiples; pieces are placed by
    `shortest_pack_first` over the histogram of their lengths (at most `length` rows reach the
    driver) and joined back by length and rank. Null and empty texts are one end id; null
    doc_ids and repeated rows are packed like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, length, path).withColumn("piece", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = sorted(shortest_pack_first(counts, length))
    table = spark.sparkContext.broadcast(np.array(slots, dtype=np.int64).reshape(-1, 4))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first_rank, sequence, offset = table.value.T
        keys = (size << 44) + first_rank
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (lengths << 44) + ranks, side="right") - 1
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            places = [sequence[at] + ranks - first_rank[at], offset[at]]
            yield pa.RecordBatch.from_arrays(
                [*kept, *map(pa.array, places)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return map_batches(ranked(pieces), place, kind)
