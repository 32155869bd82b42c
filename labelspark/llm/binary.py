"""Packed token-id matrices: best-fit-decreasing packing of blocks of documents, in tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.pack import document_ids
from labelspark.llm.tasks import batch as batch_of
from labelspark.llm.tasks import map_batches
from labelspark.llm.tokens import WORD_BPE

#: Tokens of documents that are packed together; a task holds about this many at a time.
BLOCK_TOKENS = 2_000_000
#: Sequences of one matrix.
MATRIX_ROWS = 256
PAD_ID = 0


class CapacityTree:
    """Bins by free space, with a segment tree that finds the fullest bin a piece fits in."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def _change(self, space: int, by: int) -> None:
        at = space + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, space: int, bin_: int) -> None:
        self.bins[space].append(bin_)
        self._change(space, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (space, bin) of the least space that is at least `need`."""
        at = need + self.leaves
        while not self.count[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        space = at - self.leaves
        self._change(space, -1)
        return space, self.bins[space].pop()


def best_fit_decreasing(lengths: list[int], length: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; longest pieces first, each to the fullest bin it fits in."""
    tree, bins = CapacityTree(length), 0
    places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        space, bin_ = found or (length, bins)
        bins += found is None
        places[i] = bin_, length - space
        if space > lengths[i]:
            tree.add(space - lengths[i], bin_)
    return places


_MATRICES = pa.schema(
    [("shard", pa.int64()), ("rows", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
     ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))]
)
_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset")])
_MATRIX_KIND = (
    "shard long, rows int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>"
)


def cumulative_lengths(starts: list[int], lengths: list[int], total: int) -> list[int]:
    """Where segments end in the flattened matrix, from 0 on; gaps of padding are segments."""
    out = [0]
    for start, n in zip(starts, lengths):
        if start > out[-1]:
            out.append(start)
        out.append(start + n)
    return out if out[-1] == total else [*out, total]


def segments(ids: bytes, cu_seqlens: list[int], position_ids: bytes, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, offset, ids) of the document segments of a matrix, padding left out.

    Positions count up in a document's segment and stay 0 in padding; a segment of one id is
    told from padding of one by the row it fills: padding only ends rows.
    """
    flat, positions = np.frombuffer(ids, dtype="<u4"), np.frombuffer(position_ids, dtype="<u4")
    for a, b in zip(cu_seqlens, cu_seqlens[1:]):
        padding = flat[b - 1] == PAD_ID and positions[b - 1] == 0
        if not padding:
            yield a // length, a % length, flat[a:b]


def packed_pieces(matrices: DataFrame, length: int) -> DataFrame:
    """One row per document piece, read back from the matrices.

    doc_id, start, length, ids_crc32, sequence_id, offset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for m in b.to_pylist():
                found = segments(m["ids"], m["cu_seqlens"], m["position_ids"], length)
                for doc, start, (row, offset, ids) in zip(m["doc_ids"], m["starts"], found, strict=True):
                    out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), m["shard"] * MATRIX_ROWS + row, offset))
            yield batch_of(_PIECES, *(zip(*out) if out else [[]] * 6))

    kind = "doc_id long, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return map_batches(matrices, run, kind)


def _matrices(pieces: list[tuple], length: int, first_shard: int) -> Iterator[tuple]:
    """Matrices of one block of pieces (doc_id, start, ids)."""
    places = best_fit_decreasing([len(p[2]) for p in pieces], length)
    order = sorted(range(len(pieces)), key=lambda i: places[i])
    for shard, low in enumerate(range(0, max((b for b, _ in places), default=-1) + 1, MATRIX_ROWS)):
        here = [i for i in order if low <= places[i][0] < low + MATRIX_ROWS]
        rows = places[here[-1]][0] - low + 1
        ids = np.full((rows, length), PAD_ID, dtype="<u4")
        positions = np.zeros((rows, length), dtype="<u4")
        bounds = []
        for i in here:
            (bin_, offset), n = places[i], len(pieces[i][2])
            row = bin_ - low
            ids[row, offset : offset + n] = pieces[i][2]
            positions[row, offset : offset + n] = np.arange(n)
            bounds.append(row * length + offset)
        ends = cumulative_lengths(bounds, [len(pieces[i][2]) for i in here], rows * length)
        yield (
            first_shard + shard, rows, ids.tobytes(), ends, positions.tobytes(),
            [pieces[i][0] for i in here], [pieces[i][1] for i in here],
        )


def packed_matrices(docs: DataFrame, length: int = 4096, path: str = WORD_BPE) -> DataFrame:
    """Pack `docs` (doc_id, text; more columns are ignored) into matrices of token ids.

    One row per matrix: shard, rows, ids (little-endian uint32, rows x length, padded with
    PAD_ID), cu_seqlens (cumulative segment lengths over the flattened matrix; what is left of
    a row is a segment of padding), position_ids (uint32, from 0 in each segment), and
    doc_ids and starts of the segments in order. Documents over `length` tokens are split at
    its multiples; nothing is lost. Null and empty texts are one end id; repeated rows and null
    doc_ids are packed like any other; an empty table gives no rows.

    Blocks of about BLOCK_TOKENS tokens are packed where they are read, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        pieces, held = [], 0
        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), document_ids(b.column("text"), path)):
                pieces += [(doc, at, ids[at : at + length]) for at in range(0, len(ids), length)]
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    for m in _matrices(pieces, length, shard):
                        shard = m[0] + 1
                        yield batch_of(_MATRICES, *([x] for x in m))
                    pieces, held = [], 0
        for m in _matrices(pieces, length, shard):
            yield batch_of(_MATRICES, *([x] for x in m))

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _MATRIX_KIND)


def write_packed(matrices: DataFrame, path: str) -> None:
    """Write matrices as Parquet, where any reader finds ids, segments and positions."""
    matrices.write.parquet(path)
