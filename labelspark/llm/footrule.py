"""Nearest vectors by a permutation index: pivot inverted files, footrule ranking, reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.stored import stored
from labelspark.llm.tasks import map_batches, send_code
from labelspark.llm.vectors import frame, groups_of, matrix, packed, whole_vectors


@dataclass(frozen=True)
class PermutationSettings:
    """Bounds and choices of the index; no count depends on the data's size.

    pivots: vectors that others are ordered by; sample: distinct vectors, drawn by hash, that
    they are chosen from.
    posted: how many of its nearest pivots a vector is posted under.
    block: rows that one inverted file covers; queries: queries that meet it at a time.
    share, least: part of a block's distinct vectors that is reranked, and its smallest number.
    """

    pivots: int = 128
    sample: int = 1024
    posted: int = 64
    block: int = 8192
    queries: int = 1024
    share: float = 0.2
    least: int = 512
    seed: int = 11


def apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """The first `count` vectors that keep half the root mean square distance from those before.

    A crowd of near copies so gives one pivot. If there are too few, the others follow.
    """
    norms = (vectors**2).sum(axis=1)
    squares = np.maximum(norms[:, None] + norms - 2 * (vectors @ vectors.T), 0)
    least = squares.mean() / 4
    kept: list[int] = []
    for i in range(len(vectors)):
        if len(kept) < count and (not kept or squares[i, kept].min() > least):
            kept.append(i)
    kept += [i for i in range(len(vectors)) if i not in set(kept)][: max(0, count - len(kept))]
    return vectors[kept]


def draw_pivots(rows: DataFrame, s: PermutationSettings) -> np.ndarray:
    """Pivots among the distinct vectors with the smallest hashes; `sample` reach the driver."""
    h = F.xxhash64(F.lit(s.seed), "v")
    chosen = [r["h"] for r in rows.select(h.alias("h")).distinct().orderBy("h").limit(s.sample).collect()]
    vectors = rows.where(h.isin(chosen)).groupBy(h.alias("h")).agg(F.min("v").alias("v")).orderBy("h")
    drawn = np.array([r["v"] for r in vectors.collect()] if chosen else [], dtype=np.float64)
    return apart(drawn, s.pivots) if chosen else drawn


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """Numbers of each vector's nearest pivots, nearest first; ties go to the smaller number."""
    far = (pivots**2).sum(axis=1) - 2 * (vectors @ pivots.T)
    return np.argsort(far, axis=1, kind="stable")[:, :posted].astype(np.int16)


class InvertedFiles:
    """Posting lists of a block: for each pivot, the vectors that have it, and its place there."""

    def __init__(self, orders: np.ndarray, pivots: int):
        n, self.posted = orders.shape
        self.count = n
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows = (by_pivot // self.posted).astype(np.int32)
        self.places = (by_pivot % self.posted).astype(np.int32)
        self.starts = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))

    def closeness(self, order: np.ndarray) -> np.ndarray:
        """For each vector, (posted * (posted + 1) - footrule distance) / 2 to a query's order.

        A pivot outside a list counts as standing just behind its end, so only shared pivots
        add to it, each what is left behind the later of its two places.
        """
        out = np.zeros(self.count, dtype=np.int32)
        for place, pivot in enumerate(order.tolist()):
            a, b = self.starts[pivot], self.starts[pivot + 1]
            out[self.rows[a:b]] += self.posted - np.maximum(self.places[a:b], place)
        return out


def _ordered(rows: DataFrame, pivots: np.ndarray, s: PermutationSettings) -> DataFrame:
    table = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                orders = nearest_pivots(matrix(b.column("v")), table.value, s.posted)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("v"), pa.array([x.tobytes() for x in orders], pa.binary())],
                    names=["vec_id", "v", "near"],
                )

    return map_batches(packed(rows), run, "vec_id long, v binary, near binary")


def _searched(s: PermutationSettings, k: int, pivots: int):
    """Function that searches one block for one group of queries."""
    kind = {"query_row": np.int64, "query_id": np.int64, "vec_id": np.int64, "score": np.float64}

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if block.empty or queries.empty:
            return frame([], **kind)
        block = block.sort_values(["v", "vec_id", "row"], kind="stable", ignore_index=True)
        first = np.flatnonzero((block["v"] != block["v"].shift()).to_numpy())
        ends = np.append(first[1:], len(block))
        vectors = matrix(block["v"].iloc[first])
        ids, rows = block["vec_id"].to_numpy(), block["row"].to_numpy()
        orders = np.frombuffer(b"".join(block["near"].iloc[first]), dtype=np.int16).reshape(len(first), -1)
        files = InvertedFiles(orders, pivots)
        take = min(len(first), max(s.least, int(np.ceil(s.share * len(first)))))
        out = []
        asked = zip(queries["query_row"], queries["query_id"], queries["query_near"], matrix(queries["query"]))
        for row, id_, near, q in asked:
            close = files.closeness(np.frombuffer(near, dtype=np.int16))
            cut = np.partition(close, len(close) - take)[len(close) - take]
            found = np.flatnonzero(close >= cut)
            score = np.sqrt(((vectors[found] - q) ** 2).sum(axis=1))
            if len(found) > k + 1:
                keep = score <= np.partition(score, k)[k]
                found, score = found[keep], score[keep]
            # equal vectors: only the k + 1 smallest ids can be among the k nearest
            spans = [np.arange(first[i], min(ends[i], first[i] + k + 1)) for i in found]
            at, score = np.concatenate(spans), np.repeat(score, [len(x) for x in spans])
            other = rows[at] != row
            at, score = at[other], score[other]
            best = np.lexsort((rows[at], ids[at], score))[:k]
            out.append((row, id_, ids[at[best]], score[best]))
        return frame(out, **kind)

    return search


def nearest_vectors(
    df: DataFrame, k: int = 10, every: int = 100, vector: str = "embedding", id_: str = "vec_id",
    s: PermutationSettings = PermutationSettings(),
) -> DataFrame:
    """The k nearest rows, by Euclidean distance, of each row whose id is divisible by `every`.

    Returns query_id, rank (int, from 1), vec_id, score (the exact distance, in doubles);
    nearest first, ties to the smaller id. A row is no neighbour of itself, but repeated rows
    are neighbours of each other, and each repeated query row has its own result. Null and zero
    vectors, vectors with a null or non-finite component, rows without an id and rows with an
    unusual number of components take no part; an empty table gives no rows. With fewer than k
    other rows, all are returned.

    Every row is indexed; only the pivots are drawn from a bounded number of rows. The table is
    dealt in blocks, each with its own inverted files, and every group of queries meets every
    block. In a block, equal vectors are ranked as one, so a crowd of copies takes one place;
    all vectors that tie at the cut of the footrule ranking are reranked.
    """
    spark = df.sparkSession
    send_code(spark.sparkContext)
    rows = whole_vectors(df, vector, id_).where("exists(v, x -> x <> 0)")
    pivots = draw_pivots(rows, s)
    if not len(pivots):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = stored(_ordered(rows, pivots, s).withColumn("row", F.monotonically_increasing_id()))
    query = F.col("vec_id") % every == 0
    counts = index.select(F.count("*").alias("n"), F.count_if(query).alias("q")).first()
    blocks, groups = groups_of(counts["n"], s.block), groups_of(counts["q"], s.queries)
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = index.withColumn("block", dealt(blocks)).withColumn("group", every_one(groups))
    asked = index.where(query).select(
        F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("near").alias("query_near"),
        F.col("v").alias("query"), dealt(groups).alias("group"), every_one(blocks).alias("block"),
    )
    found = (
        data.groupBy("block", "group").cogroup(asked.groupBy("block", "group"))
        .applyInPandas(_searched(s, k, len(pivots)), "query_row long, query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_row").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
