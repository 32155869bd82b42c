"""Hard negatives by an inverted multi-index: cells of two half-space codebooks, best bound first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.stored import stored
from labelspark.llm.tasks import map_batches, send_code
from labelspark.llm.vectors import frame, groups_of, matrix, packed, whole_vectors


@dataclass(frozen=True)
class MultiIndexSettings:
    """Sizes of the index; results are exact whatever they are.

    words: centroids of each half's codebook; sample: rows they are fitted on; rounds: of
    fitting. block: rows a task holds at a time; anchors: anchors that meet a block at a time;
    batch: rows that are scored together while cells are visited.
    """

    words: int = 16
    sample: int = 4096
    rounds: int = 12
    block: int = 8192
    anchors: int = 1024
    batch: int = 512
    seed: int = 12


@dataclass(frozen=True)
class Codebooks:
    """Centroids of both halves and, for each, the largest distance of a row assigned to it."""

    centroids: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]

    def half_bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """No row of a centroid has a larger half score with the anchor than its bound."""
        cut = self.centroids[0].shape[1]
        halves = (anchor[:cut], anchor[cut:])
        return tuple(c @ a + np.sqrt(a @ a) * r + 0.01 for c, r, a in zip(self.centroids, self.radii, halves))


def fit_centroids(points: np.ndarray, words: int, rounds: int) -> np.ndarray:
    """k-means from spread starts (each the point farthest from those before), on given points."""
    points = np.unique(points, axis=0)
    starts, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(starts) < min(words, len(points)):
        starts.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[starts[-1]]) ** 2).sum(axis=1))
    centroids = points[starts]
    for _ in range(rounds):
        nearest = nearest_word(points, centroids)[0]
        for w in np.unique(nearest):
            centroids[w] = points[nearest == w].mean(axis=0)
    return centroids


def nearest_word(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of, and distance to, the nearest centroid of each point."""
    squares = (points**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1) - 2 * (points @ centroids.T)
    word = squares.argmin(axis=1)
    return word, np.sqrt(((points - centroids[word]) ** 2).sum(axis=1))


def _assigned(rows: DataFrame, centroids: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    books = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = books.value
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"))
                a, ra = nearest_word(v[:, : first.shape[1]], first)
                c, rc = nearest_word(v[:, first.shape[1] :], second)
                extra = [pa.array(x.astype(np.int32)) for x in (a, c)] + [pa.array(x) for x in (ra, rc)]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "a", "c", "ra", "rc"])

    return map_batches(rows, run, "row long, vec_id long, label long, v binary, a int, c int, ra double, rc double")


def lay_out(cells: list[tuple[int, int, int]], size: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(first block, blocks) of each cell (a, c, rows): neighbours share one, a full cell has several."""
    out, block, held = {}, 0, 0
    for a, c, n in sorted(cells):
        if held and held + n > size:
            block, held = block + 1, 0
        parts = groups_of(n, size)
        out[a, c] = block, parts
        block, held = (block + parts, 0) if parts > 1 else (block, held + n)
    return out


def _placed(cells: DataFrame, layout: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """`cells` with the block of each row; a cell that takes several is dealt by row number."""
    table = [(a, c, first, parts) for (a, c), (first, parts) in layout.items()]
    where = cells.sparkSession.createDataFrame(table, "a int, c int, first int, parts int")
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    return cells.join(F.broadcast(where), ["a", "c"]).withColumn("block", F.col("first") + part).drop("first", "parts")


class Cells:
    """Rows of a block by cell, visited in the order of a summed bound."""

    def __init__(self, block: pd.DataFrame, books: Codebooks, batch: int):
        block = block.sort_values(["a", "c"], kind="stable", ignore_index=True)
        self.rows, self.ids, self.labels = (block[c].to_numpy() for c in ("row", "vec_id", "label"))
        self.vectors, self.books, self.batch = matrix(block["v"]), books, batch
        a, c = block["a"].to_numpy(), block["c"].to_numpy()
        self.first, self.second = np.unique(a), np.unique(c)
        key = a.astype(np.int64) << 32 | c
        grid = (self.first[:, None].astype(np.int64) << 32 | self.second).ravel()
        shape = len(self.first), len(self.second)
        self.starts = np.searchsorted(key, grid).reshape(shape).tolist()
        self.ends = np.searchsorted(key, grid, side="right").reshape(shape).tolist()

    def _sequence(self, anchor: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, start, end) of the cells, largest bound first, by a heap over two sorted lists."""
        first, second = (b[w] for b, w in zip(self.books.half_bounds(anchor), (self.first, self.second)))
        by_a, by_c = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        top_a, top_c = first[by_a].tolist(), second[by_c].tolist()
        by_a, by_c = by_a.tolist(), by_c.tolist()
        heap = [(-(top_a[0] + top_c[0]), 0, 0)]
        while heap:
            less, i, j = heapq.heappop(heap)
            yield -less, self.starts[by_a[i]][by_c[j]], self.ends[by_a[i]][by_c[j]]
            if j + 1 < len(top_c):
                heapq.heappush(heap, (-(top_a[i] + top_c[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(top_a):
                heapq.heappush(heap, (-(top_a[i + 1] + top_c[0]), i + 1, 0))

    def visit(self, anchor: np.ndarray, need: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows, scores, bound of all that is left) in steps of about `batch` rows.

        It ends where no row left can reach `need`; the caller ends it sooner.
        """
        spans, held = [], 0
        for bound, start, end in self._sequence(anchor):
            if bound < need:
                break
            if held >= self.batch:
                at = np.concatenate([np.arange(*x) for x in spans])
                yield at, (self.vectors[at] @ anchor).astype(np.int64), int(np.floor(bound))
                spans, held = [], 0
            if end > start:
                spans.append((start, end))
                held += end - start
        if spans:
            at = np.concatenate([np.arange(*x) for x in spans])
            yield at, (self.vectors[at] @ anchor).astype(np.int64), -(1 << 62)


def _same_label(cells: Cells, row: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and scores of the first k others of the anchor's label in a block."""
    found, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for at, score, bound in cells.visit(anchor, -np.inf):
        fit = (cells.labels[at] == label) & (cells.rows[at] != row)
        found, scores = np.append(found, at[fit]), np.append(scores, score[fit])
        best = np.lexsort((cells.rows[found], cells.ids[found], -scores))[:k]
        found, scores = found[best], scores[best]
        if len(found) == k and scores[-1] > bound:
            break
    return found, scores


def _in_windows(
    cells: Cells, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (least, most): the first k rows of other labels with a score in it."""
    found, scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    least, out = min(w[0] for w in windows), []
    for at, score, bound in cells.visit(anchor, least):
        fit = (cells.labels[at] != label) & (score >= least)
        found, scores = np.append(found, at[fit]), np.append(scores, score[fit])
        order = np.lexsort((cells.rows[found], cells.ids[found], -scores))
        found, scores = found[order], scores[order]
        starts = np.searchsorted(-scores, [-w[1] for w in windows])
        # certified: k rows of the window outscore all that is left, or nothing left reaches it
        open_ = [
            bound >= (scores[s + k - 1] if s + k <= len(scores) and scores[s + k - 1] >= low else low)
            for s, (low, _) in zip(starts, windows)
        ]
        if not any(open_):
            break
    for low, high in windows:
        s = int(np.searchsorted(-scores, -high))
        e = min(s + k, int(np.searchsorted(-scores, -low, side="right")))
        out.append((found[s:e], scores[s:e]))
    return out


def _routed(anchors: DataFrame, books: Codebooks, layout: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """Each anchor once for every block with a cell whose bound reaches its column `need`."""
    cells, spans = np.array(list(layout)), np.array(list(layout.values()))
    blocks = np.concatenate([np.arange(f, f + p) for f, p in spans])
    owner = np.repeat(np.arange(len(spans)), spans[:, 1])
    sent = anchors.sparkSession.sparkContext.broadcast((books, cells, blocks, owner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, cells, blocks, owner = sent.value
        for b in batches:
            take, to = [], []
            for i, (v, need) in enumerate(zip(matrix(b.column("v")), b.column("need").to_pylist())):
                first, second = books.half_bounds(v)
                bound = first[cells[:, 0]] + second[cells[:, 1]]
                hit = np.unique(blocks[bound[owner] >= need])
                take += [i] * len(hit)
                to += hit.tolist()
            picked = b.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(to, pa.int32())], names=[*b.schema.names, "block"])

    kind = ", ".join(f"{c} {t}" for c, t in anchors.dtypes) + ", block int"
    return map_batches(anchors, run, kind)


def _fit(rows: DataFrame, s: MultiIndexSettings) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both halves from the `sample` rows with the smallest hashes."""
    drawn = rows.orderBy(F.xxhash64(F.lit(s.seed), "row"), "row").limit(s.sample)
    points = matrix(drawn.select("v").toArrow().column("v").combine_chunks())
    cut = points.shape[1] - points.shape[1] // 2
    return fit_centroids(points[:, :cut], s.words, s.rounds), fit_centroids(points[:, cut:], s.words, s.rounds)


def _first(found: DataFrame, by: list[str], score: str, id_: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_, "other_row")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def hard_negatives(
    df: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, every: int = 100,
    vector: str = "embedding", id_: str = "vec_id", label: str = "label", s: MultiIndexSettings = MultiIndexSettings(),
) -> DataFrame:
    """For each anchor and positive, the best rows of other labels that score nearly as high.

    Anchors are the rows whose id is divisible by `every`. Vectors hold whole numbers and a score
    is an inner product; higher scores come first, ties by the smaller id. An anchor's positives
    are its first other rows of the same label; of a positive with score p, negatives are the
    first rows of other labels with percent * p <= 100 * score <= 100 * p. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score (longs, rank int).

    Rows without an id or label, with a null vector or component or one that is not finite, or
    with an unusual number of components, take no part; an anchor or positive without a
    negative gives no row; an empty table gives none. Repeated rows are rows of their own.

    The codebooks are fitted on a bounded sample, every row is indexed. Radii cover all rows, so
    no bound is too small and the result is exact. Cells are laid out in blocks of bounded size;
    an anchor goes to the blocks that can hold an answer.
    """
    spark = df.sparkSession
    send_code(spark.sparkContext)
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = whole_vectors(df, vector, id_, label).where("label is not null")
    rows = stored(packed(rows).withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "label", "v"))
    if rows.isEmpty():
        return spark.createDataFrame([], kind)
    centroids = _fit(rows, s)
    cells = stored(_assigned(rows, centroids))
    grouped = cells.groupBy("a", "c").agg(F.count("*").alias("n"), F.max("ra").alias("ra"), F.max("rc").alias("rc")).collect()
    radii = tuple(np.zeros(len(x)) for x in centroids)
    for r in grouped:
        radii[0][r["a"]], radii[1][r["c"]] = max(radii[0][r["a"]], r["ra"]), max(radii[1][r["c"]], r["rc"])
    books = Codebooks(centroids, radii)
    layout = lay_out([(r["a"], r["c"], r["n"]) for r in grouped], s.block)
    sent = spark.sparkContext.broadcast(books)

    def own_label(block: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(anchors):
            here = Cells(block, sent.value, s.batch)
            for row, own, v in zip(anchors["row"], anchors["label"], matrix(anchors["v"])):
                at, score = _same_label(here, row, own, v, positives)
                out.append((row, here.ids[at], score, here.rows[at]))
        return frame(out, row=np.int64, id=np.int64, score=np.int64, other_row=np.int64)

    def other_labels(block: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(anchors):
            here = Cells(block, sent.value, s.batch)
            for row, own, v, scores in zip(anchors["row"], anchors["label"], matrix(anchors["v"]), anchors["scores"]):
                windows = [(-(-percent * int(p) // 100), int(p)) for p in scores]
                for p, (at, score) in zip(scores, _in_windows(here, own, v, windows, negatives)):
                    out.append((row, int(p), here.ids[at], score, here.rows[at]))
        return frame(out, row=np.int64, p=np.int64, id=np.int64, score=np.int64, other_row=np.int64)

    anchors = cells.where(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "v")
    groups = groups_of(anchors.count(), s.anchors)
    group = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group")
    data = _placed(cells, layout).select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "row", "vec_id", "label", "v", "a", "c"
    ).groupBy("block", "group")

    def meet(asked: DataFrame, function, kind: str) -> DataFrame:
        routed = _routed(asked, books, layout).select("*", group)
        return data.cogroup(routed.groupBy("block", "group")).applyInPandas(function, kind)

    same = meet(anchors.withColumn("need", F.lit(float("-inf"))), own_label, "row long, id long, score long, other_row long")
    best = stored(_first(same, ["row"], "score", "id", positives).drop("other_row"))
    scores = best.where("score >= 0").groupBy("row").agg(F.array_sort(F.collect_set("score")).alias("scores"))
    need = F.array_min(F.transform("scores", lambda p: F.floor(p * percent / 100))).cast("double")
    others = meet(
        anchors.join(scores, "row").withColumn("need", need), other_labels,
        "row long, p long, id long, score long, other_row long",
    )
    windowed = _first(others, ["row", "p"], "score", "id", negatives)
    return (
        best.select("row", F.col("id").alias("positive_id"), F.col("score").alias("p"))
        .join(windowed.select("row", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "p"])
        .join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", "rank", "negative_id", F.col("p").alias("positive_score"), "negative_score")
    )
