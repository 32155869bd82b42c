"""Exact duplicates: compressed fingerprints go to owners, bitmaps come back, bytes decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.bitset import build_filter, may_hold
from labelspark.llm.hashing import mix
from labelspark.llm.stored import stored
from labelspark.llm.tasks import batch as batch_of
from labelspark.llm.tasks import map_batches, send_code

SPACES = b" \t\n\x0b\x0c\r"
#: Bits of a fingerprint; equal ones are only suspects, so more bits just mean fewer of them.
FINGERPRINT_BITS = 48
#: About as many fingerprints belong to one owner.
OWNED = 200_000

_ROWS = pa.schema([("doc_id", pa.int64()), ("points", pa.int64()), ("text_sha256", pa.string()), ("fp", pa.int64()), ("raw_sha256", pa.string())])
_TEXTS = pa.schema([("norm", pa.binary()), ("text_sha256", pa.string())])


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 values as Golomb-Rice coded gaps.

    Layout: count and remainder width (8 bytes each), then all quotients in unary, then all
    remainders. Keeping the two apart lets both sides work on whole arrays.
    """
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(0))
    width = max(0, int(gaps.mean()).bit_length() - 1) if n else 0
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, dtype=np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    places = np.arange(width, dtype=np.uint64)
    remainders = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel()
    head = np.array([n, width, len(unary)], dtype="<i8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(remainders).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    n, width, length = np.frombuffer(data, dtype="<i8", count=3).tolist()
    body = np.frombuffer(data, dtype=np.uint8, offset=24)
    cut = -(-length // 8)
    ends = np.flatnonzero(np.unpackbits(body[:cut], count=length))
    gaps = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps <<= np.uint64(width)
    bits = np.unpackbits(body[cut:], count=n * width).reshape(n, width).astype(np.uint64)
    return np.cumsum(gaps + (bits << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64), dtype=np.uint64)


def _normal(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACES)


def _fingerprint(norm: bytes) -> int:
    return xxhash.xxh3_64_intdigest(norm) >> (64 - FINGERPRINT_BITS)


def _fingerprinted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            norms = [_normal(t) for t in texts]
            yield batch_of(
                _ROWS, b.column("doc_id"), [len(t or "") for t in texts],
                [hashlib.sha256(x).hexdigest() for x in norms], [_fingerprint(x) for x in norms],
                [hashlib.sha256((t or "").encode()).hexdigest() for t in texts],
            )

    kind = "doc_id long, points long, text_sha256 string, fp long, raw_sha256 string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, kind)


def _owned_lists(rows: DataFrame, owners: int) -> DataFrame:
    """(owner, sender, list): each sender's distinct fingerprints of an owner, compressed."""
    shift = np.uint64(FINGERPRINT_BITS - (owners - 1).bit_length())

    def send(sender: tuple, part: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(part["fp"].to_numpy().astype(np.uint64))
        owner = fps >> shift
        names, at = np.unique(owner, return_index=True)
        lists = [golomb_encode(x) for x in np.split(fps, at[1:])] if len(names) else []
        return pd.DataFrame({"owner": names.astype(np.int64), "sender": sender[0], "list": lists})

    return rows.select("sender", "fp").groupBy("sender").applyInPandas(send, "owner long, sender long, list binary")


def _bitmaps(lists: DataFrame) -> DataFrame:
    """(sender, owner, bitmap): which of a sender's fingerprints other senders hold, too."""

    def answer(owner: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sent = [golomb_decode(x) for x in part["list"]]
        values, counts = np.unique(np.concatenate(sent), return_counts=True)
        shared = values[counts > 1]
        maps = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in sent]
        return pd.DataFrame({"sender": part["sender"], "owner": owner[0], "bitmap": maps})

    return lists.groupBy("owner").applyInPandas(answer, "sender long, owner long, bitmap binary")


def _suspects(rows: DataFrame, bitmaps: DataFrame, owners: int) -> DataFrame:
    """Hashes (h) of the fingerprints that occur on several rows; a row for each sender of one."""
    shift = np.uint64(FINGERPRINT_BITS - (owners - 1).bit_length())

    def receive(part: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        fps, counts = np.unique(part["fp"].to_numpy().astype(np.uint64), return_counts=True)
        twice = counts > 1
        owner = fps >> shift
        for name, bitmap in zip(maps["owner"], maps["bitmap"]):
            here = np.flatnonzero(owner == np.uint64(name))
            twice[here] |= np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), count=len(here)).astype(bool)
        return pd.DataFrame({"h": mix(fps[twice]).view(np.int64)})

    ours, theirs = rows.select("sender", "fp").groupBy("sender"), bitmaps.groupBy("sender")
    return ours.cogroup(theirs).applyInPandas(receive, "h long")


def _same_bytes(docs: DataFrame, suspects: DataFrame) -> DataFrame:
    """text_sha256 of the normalised texts that several rows of `docs` hold, byte by byte."""
    bits = docs.sparkSession.sparkContext.broadcast(build_filter(suspects, "h", suspects.count()))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norms = [_normal(t) for t in b.column("text").to_pylist()]
            fps = np.fromiter(map(_fingerprint, norms), dtype=np.uint64, count=len(norms))
            hit = may_hold(bits.value, mix(fps))
            norms = [x for x, h in zip(norms, hit) if h]
            yield batch_of(_TEXTS, norms, [hashlib.sha256(x).hexdigest() for x in norms])

    texts = map_batches(docs.select("text"), keep, "norm binary, text_sha256 string")
    same = texts.groupBy("norm").agg(F.count("*").alias("n"), F.first("text_sha256").alias("text_sha256"))
    return same.where("n > 1").select("text_sha256")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Group rows of `docs` (doc_id, text; more columns are ignored) by text without white space.

    Returns one row per row: doc_id, keep_id, group_size, kept, text_sha256
    (of the text without white space), raw_sha256 (of the whole text). Of a group, the
    row with the most code points stays, then the one with the smallest doc_id (null last),
    then one of the repeated rows. Null texts count as empty, so all empty texts are a group.
    An empty table gives an empty result.

    Each partition of the fingerprint table sends the owner of a fingerprint range one sorted,
    Golomb-coded list and gets a bitmap back. Texts of suspects are shuffled and grouped by
    their bytes; a map-side aggregate first folds the copies of a text within a partition.
    """
    send_code(docs.sparkSession.sparkContext)
    rows = stored(
        _fingerprinted(docs)
        .withColumn("sender", F.spark_partition_id().cast("long"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    owners = 1 << max(2, (rows.count() // OWNED).bit_length())
    bitmaps = _bitmaps(_owned_lists(rows, owners))
    suspects = stored(_suspects(rows, bitmaps, owners))
    verified = _same_bytes(docs, suspects)
    first = F.min(F.struct((-F.col("points")).alias("longest"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = (
        rows.groupBy("text_sha256").agg(F.count("*").alias("n"), first.alias("first"))
        .join(verified, "text_sha256")
        .select("text_sha256", "n", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"))
    )
    alone = F.col("first_row").isNull()
    return rows.join(stored(groups), "text_sha256", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first_row"))).alias("kept"),
        "text_sha256",
        "raw_sha256",
    )
