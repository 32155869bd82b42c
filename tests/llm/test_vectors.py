"""Permutation index and multi-index against brute force, and rows that take no part."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelspark.llm.footrule import InvertedFiles, PermutationSettings, apart, nearest_pivots, nearest_vectors
from labelspark.llm.negatives import (
    Cells, Codebooks, MultiIndexSettings, fit_centroids, hard_negatives, lay_out, nearest_word, quantised,
)

KIND = "vec_id long, embedding array<float>, label int"


def clean(rows):
    usable = [r for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = Counter(len(r[1]) for r in usable)
    size = min(sizes, key=lambda n: (-sizes[n], n), default=0)
    return [(r[0], np.array(r[1], dtype=np.float32).astype(np.float64), r[2]) for r in usable if len(r[1]) == size]


def brute_nearest(rows, k, every):
    rows = [r for r in clean(rows) if r[1].any()]
    out = []
    for i, (id_, q, _) in enumerate(rows):
        if id_ % every == 0:
            far = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, (_, v, _) in enumerate(rows) if j != i)
            far = sorted((d, rows[j][0]) for d, j in far)[:k]
            out += [(id_, n + 1, x, round(d, 9)) for n, (d, x) in enumerate(far)]
    return sorted(out)


def brute_negatives(rows, every=100, k=5, percent=80):
    rows = [(i, v, l) for i, v, l in clean(rows) if l is not None]
    out = []
    for n, (a, va, la) in enumerate(rows):
        if a % every:
            continue
        scored = sorted((-int(va @ v), i, l == la) for m, (i, v, l) in enumerate(rows) if m != n)
        for p, pid, _ in [x for x in scored if x[2]][:k]:
            fit = [(s, i) for s, i, same in scored if not same and percent * -p <= 100 * -s <= 100 * -p][:k]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i) in enumerate(fit)]
    return sorted(out)


def odd_rows():
    return [
        (None, [1.0, 1.0], 1), (100, None, 1), (200, [float("nan"), 1.0], 1), (300, [None, 1.0], 1), (400, [float("inf"), 0.0], 1),
        (500, [1.0], 1), (600, [], 1),
    ]


def vectors(seed, n, dim, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-9, 10, dim)], int(rng.integers(0, 4))) for i in range(n)]
    return rows + [(n + i, rows[3][1], rows[3][2]) for i in range(copies)]


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame(rows, KIND).selectExpr("*", "1 as row", "'x' as v", "2 as block", "3 as `group`", "4 as score")

    return make


def test_inverted_files_rank_by_footrule_distance():
    rng = np.random.default_rng(5)
    points, pivots = rng.normal(size=(40, 6)), rng.normal(size=(12, 6))
    posted = 5
    orders = nearest_pivots(points, pivots, posted)
    files = InvertedFiles(orders, len(pivots))

    def place(order, pivot):
        return order.index(pivot) if pivot in order else posted

    for q in range(5):
        close = files.closeness(orders[q])
        for i in range(40):
            a, b = orders[q].tolist(), orders[i].tolist()
            footrule = sum(abs(place(a, p) - place(b, p)) for p in range(len(pivots)))
            assert posted * (posted + 1) - 2 * close[i] == footrule


def test_pivots_keep_apart():
    crowd = np.concatenate([np.full((50, 3), 1.0) + np.arange(50)[:, None] * 1e-6, np.eye(3) * 40, -np.eye(3) * 40])
    assert (np.abs(apart(crowd, 4) - 1) < 1e-3).all(axis=1).sum() == 1
    assert len(apart(crowd, 60)) == len(crowd)


def test_nearest_vectors_match_brute_force_where_all_are_reranked(table):
    rows = vectors(1, 120, 5, copies=30) + odd_rows() + [(7, [0.0] * 5, 1)] + vectors(1, 5, 5)
    settings = PermutationSettings(pivots=8, posted=4, block=40, queries=3, share=1.0)
    got = nearest_vectors(table(rows), k=4, every=10, s=settings).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == brute_nearest(rows, 4, 10)


def test_nearest_vectors_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    got = {(r["query_id"], r["vec_id"]) for r in nearest_vectors(df).collect()}
    want = {(q, x) for q, _, x, _ in brute_nearest(rows, 10, 100)}
    assert len(got & want) >= 0.93 * len(want)


def test_crowd_of_copies_takes_one_place(table):
    rows = [(i, [5.0, 5.0], 0) for i in range(300)] + [(1000 + i, [float(i), 1.0], 0) for i in range(20)]
    settings = PermutationSettings(pivots=6, posted=3, share=0.1, least=8)
    got = nearest_vectors(table(rows), k=10, every=1000, s=settings).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == list(range(1, 11))


@pytest.mark.parametrize("rows", [[], odd_rows()[:4], [(0, [0.0, 0.0], 1)], [(0, [1.0, 0.0], 1)]])
def test_searches_without_answers(table, rows):
    assert nearest_vectors(table(rows)).count() == 0
    assert hard_negatives(table(rows)).count() == 0


def test_fewer_rows_than_neighbours(table):
    got = nearest_vectors(table([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1)])).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("seed, settings", [
    (2, MultiIndexSettings(words=3, sample=50, block=30, anchors=3, batch=7)),
    (3, MultiIndexSettings(words=1, sample=5, block=1000)),
    (4, MultiIndexSettings(words=40, block=20, anchors=2, batch=1)),
])
def test_hard_negatives_match_brute_force(table, seed, settings):
    rows = vectors(seed, 150, 6, copies=40) + odd_rows() + [(20, [1.0] * 6, None), (30, [0.0] * 6, 2)] + vectors(seed, 11, 6)
    got = hard_negatives(table(rows), every=10, s=settings).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, 10)


def test_cells_come_in_the_order_of_bounds_that_hold():
    rng = np.random.default_rng(6)
    points = np.floor(rng.normal(size=(300, 8)) * 20)
    halves = points[:, :4], points[:, 4:]
    centroids = tuple(fit_centroids(h[:60], 5, 4) for h in halves)
    words = [nearest_word(h, c) for h, c in zip(halves, centroids)]
    radii = tuple(np.array([d[w == i].max(initial=0) for i in range(5)]) for w, d in words)
    block = pd.DataFrame({
        "row": range(300), "vec_id": range(300), "label": 0, "v": [p.astype("<f8").tobytes() for p in points],
        "a": words[0][0], "c": words[1][0],
    })
    cells = Cells(block, Codebooks(centroids, radii), batch=10)
    anchor = points[7]
    seen, bounds = [], []
    for bound, start, end in cells._sequence(anchor):
        bounds.append(bound)
        assert all(cells.vectors[start:end] @ anchor <= bound)
        seen += range(start, end)
    assert sorted(seen) == list(range(300)) and bounds == sorted(bounds, reverse=True)


def test_layout_bounds_blocks():
    cells = [(0, 0, 5), (0, 1, 90), (1, 0, 10), (1, 1, 9), (2, 0, 1)]
    layout = lay_out(cells, 20)
    assert layout == {(0, 0): (0, 1), (0, 1): (1, 5), (1, 0): (6, 1), (1, 1): (6, 1), (2, 0): (6, 1)}


def test_quantised_floors_in_doubles(spark):
    row = spark.createDataFrame([([0.1, -0.1, 1.0],)], "e array<float>").select(quantised(F.col("e")).alias("q")).first()
    assert row["q"] == [25.0, -26.0, 256.0]
