import random
from itertools import groupby

import pytest

from labelspark import schemas
from labelspark.operators.blocks import line_blocks
from labelspark.operators.dedup import deduplicate, overlap_pairs
from labelspark.sources.words import union_passes, usable_words

WORDS = [
    # label, block, par, line, text, conf, left, top, width, height
    ("close", 1, 1, 1, "STRAIGHT", 90, 10, 100, 70, 20),
    ("close", 1, 1, 1, "RYE", 91, 90, 100, 30, 20),
    ("close", 1, 1, 1, "WHISKY", 92, 130, 100, 50, 20),
    ("wide", 1, 1, 1, "FREDERICK,MD", 90, 10, 100, 100, 20),
    ("wide", 1, 1, 1, "STRAIGHT", 91, 300, 100, 70, 20),
    ("wide", 1, 1, 1, "RYE", 92, 380, 100, 30, 20),
    ("wide", 1, 1, 1, "WHISKY", 93, 420, 100, 50, 20),
    ("single", 1, 1, 1, "HELLO", 95, 10, 10, 80, 20),
    ("panels", 1, 1, 1, "LEFT", 90, 10, 100, 40, 20),
    ("panels", 1, 1, 1, "PANEL", 91, 60, 100, 50, 20),
    ("panels", 1, 1, 1, "RIGHT", 92, 400, 100, 50, 20),
    ("panels", 1, 1, 1, "PANEL", 93, 460, 100, 50, 20),
    ("lines", 1, 1, 1, "GOVERNMENT", 91, 10, 100, 100, 20),
    ("lines", 1, 1, 1, "WARNING:", 90, 120, 100, 80, 20),
    ("lines", 1, 1, 1, "", -1, 0, 0, 0, 0),
    ("lines", 1, 1, 2, "(1)", 88, 10, 130, 30, 20),
    ("lines", 1, 1, 2, "According", 87, 50, 130, 80, 20),
    ("lines", 2, 1, 1, "Brand", 92, 300, 20, 40, 25),
    ("lines", 2, 1, 1, "Label", 93, 350, 20, 50, 25),
    ("lines", 2, 1, 1, "", -1, 0, 0, 0, 0),
    # out of x order; the word before a nutrition gap decides the split
    ("nutrition", 1, 1, 1, "12g", 90, 220, 10, 30, 20),
    ("nutrition", 1, 1, 1, "to", 90, 60, 10, 20, 20),
    ("nutrition", 1, 1, 1, "ability", 90, 10, 10, 45, 20),
    ("nutrition", 1, 1, 1, "Protein", 90, 90, 10, 120, 20),
]


@pytest.fixture(scope="module")
def words(spark):
    cols = "label_id block_num par_num line_num text conf left top width height".split()
    rows = [(*w[:5], float(w[5]), *w[6:], i) for i, w in enumerate(WORDS)]
    df = spark.createDataFrame(rows, cols + ["word_no"])
    return union_passes(df)


@pytest.fixture(scope="module")
def blocks(words):
    out = {}
    order = ["label_id", "block_num", "par_num", "line_num", "sub_line"]
    for r in line_blocks(usable_words(words)).orderBy(*order).collect():
        out.setdefault(r["label_id"], []).append(r)
    return out


@pytest.mark.parametrize(
    "label, texts",
    [
        ("close", ["STRAIGHT RYE WHISKY"]),
        ("wide", ["FREDERICK,MD", "STRAIGHT RYE WHISKY"]),
        ("single", ["HELLO"]),
        ("panels", ["LEFT PANEL", "RIGHT PANEL"]),
        ("lines", ["GOVERNMENT WARNING:", "(1) According", "Brand Label"]),
        ("nutrition", ["ability to Protein", "12g"]),
    ],
)
def test_lines(blocks, label, texts):
    assert [b["text"] for b in blocks[label]] == texts


def test_box_and_confidence(blocks):
    first = blocks["lines"][0]
    assert (first["x1"], first["y1"], first["x2"], first["y2"]) == (10, 100, 200, 120)
    assert first["confidence"] == pytest.approx(90.5)


def test_words_without_layout_stand_alone(words):
    plain = words.filter("label_id = 'close'").drop("block_num", "par_num", "line_num")
    texts = {r["text"] for r in line_blocks(usable_words(plain)).collect()}
    assert texts == {"STRAIGHT", "RYE", "WHISKY"}


BLOCKS = {
    "copies": [("Hello", 0, 0, 100, 50, 90), ("Hello", 2, 2, 98, 48, 80),
               ("World", 0, 60, 100, 110, 85)],
    "confidence": [("Test", 0, 0, 100, 50, 70), ("Test", 0, 0, 100, 50, 95)],
    "similar": [("RED WINE VICTORIA 12% ALC.VOL.", 10, 10, 300, 40, 90),
                ("RED WINE VICTORIA 12% ALC./VOL.", 12, 11, 298, 39, 85)],
    "apart": [("RED WINE", 10, 10, 100, 40, 90), ("PALE ALE", 10, 50, 100, 80, 88)],
    "longer_other": [("ALE", 10, 10, 100, 40, 90), ("PALE ALE 5% BY VOL", 10, 10, 100, 40, 80)],
    "flat": [("A", 0, 0, 0, 0, 90), ("A", 0, 0, 0, 0, 80)],
    # the middle block is dropped, so it cannot drop the last one
    "chain": [("one two three four", 0, 0, 100, 10, 90), ("one two", 50, 0, 150, 10, 80),
              ("one", 100, 0, 200, 10, 70)],
}


def block_frame(spark):
    rows = [
        (name, i, t, *box, float(conf))
        for name, items in BLOCKS.items()
        for i, (t, *box, conf) in enumerate(items)
    ]
    return spark.createDataFrame(rows, schemas.LABEL_BLOCKS)


EXPECTED = {
    "copies": ["Hello", "World"],
    "confidence": ["Test"],
    "similar": ["RED WINE VICTORIA 12% ALC.VOL."],
    "apart": ["RED WINE", "PALE ALE"],
    "longer_other": ["ALE", "PALE ALE 5% BY VOL"],
    "flat": ["A", "A"],
    "chain": ["one two three four", "one"],
}


def survivors(blocks):
    rows = deduplicate(blocks).orderBy("label_id", "block_id").collect()
    return {k: list(v) for k, v in groupby(rows, key=lambda r: r["label_id"])}


def test_deduplicate(spark):
    kept = survivors(block_frame(spark))
    assert {k: [b["text"] for b in v] for k, v in kept.items()} == EXPECTED
    assert kept["confidence"][0]["confidence"] == 95
    assert [b["block_id"] for b in kept["apart"]] == [0, 1]


def overlaps(a, b):
    """Shared share of the smaller of two (x1, y1, x2, y2)."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0
    return w * h / min((r[2] - r[0]) * (r[3] - r[1]) for r in (a, b))


@pytest.mark.parametrize("high, side", [(4000, 500), (0, 60)])
def test_deduplicate_equals_a_greedy_walk(spark, high, side):
    """Texts of one length, so only overlap and order decide; 1,000 blocks in one label,
    over many bands or in one."""
    rng, rows = random.Random(3), []
    for i in range(1000):
        x, y, w = rng.randint(0, side), rng.randint(0, high), rng.choice([0, 20, 60, 90])
        rows.append(("L", i, rng.choice(["pale", "rums"]), x, y, x + w, y + 12, float(rng.randint(50, 60))))
    kept = []
    for row in sorted(rows, key=lambda r: (-r[7], r[1])):
        if not any(overlaps(k[3:7], row[3:7]) > 0.4 for k in kept):
            kept.append(row)
    found = survivors(spark.createDataFrame(rows, schemas.LABEL_BLOCKS))["L"]
    assert [tuple(b)[2:] for b in found] == [r[2:] for r in kept]


def greedy(rows):
    kept = []
    for row in sorted(rows, key=lambda r: (-r[7], r[1])):
        if not any(overlaps(k[3:7], row[3:7]) > 0.4 and (len(row[2]) <= len(k[2])) for k in kept):
            kept.append(row)
    return kept


@pytest.mark.parametrize("conf, boxes", [(99, 5000), (10, 1000)])
def test_a_frame_round_thousands_of_boxes(spark, conf, boxes):
    """No line cuts through a frame; its text is shorter than theirs, so it suppresses none."""
    rows = [("L", 0, "f", 0, 0, 10_000, 10_000, float(conf))]
    rng = random.Random(4)
    for i in range(1, boxes + 1):
        x, y = (i % 70) * 100, (i // 70) * 100
        shift = rng.choice([0, 40])
        rows.append(("L", i, "ab" if conf == 99 else "cd", 10 + x + shift, 10 + y, 70 + x + shift, 50 + y, float(rng.randint(50, 60))))
    found = survivors(spark.createDataFrame(rows, schemas.LABEL_BLOCKS))["L"]
    want = greedy(rows)
    assert [tuple(b)[2:] for b in found] == [r[2:] for r in want] and len(want) == boxes + (conf == 99)


def test_cuts_part_columns_inside_rows_inside_columns(spark):
    """A table beside a tall block: no cut down the page parts it, cuts across and down again do."""
    from labelspark.operators.dedup import cut_apart, without_copies

    rows = [("L", 0, "tall", 0, 0, 50, 1000, 90.0)]
    for i in range(1, 201):
        x, y = 60 + (i % 4) * 50, (i // 4) * 20
        rows.append(("L", i, f"t{i}", x, y, x + 49, y + 19, 80.0))
    parts = cut_apart(without_copies(spark.createDataFrame(rows, schemas.LABEL_BLOCKS)))
    sizes = [r["count"] for r in parts.groupBy("cut0", "cut1", "cut2").count().collect()]
    assert len(sizes) == 201 and set(sizes) == {1}


def test_parts_never_overlap(spark):
    from labelspark.operators.dedup import cut_apart, without_copies

    rng = random.Random(9)
    rows = []
    for i in range(400):
        x, y = rng.randint(0, 2000), rng.randint(0, 2000)
        rows.append(("L", i, "t", x, y, x + rng.randint(0, 120), y + rng.randint(0, 90), 80.0))
    parts = cut_apart(without_copies(spark.createDataFrame(rows, schemas.LABEL_BLOCKS))).collect()
    for i, a in enumerate(parts):
        for b in parts[:i]:
            if (a.cut0, a.cut1, a.cut2) != (b.cut0, b.cut1, b.cut2):
                assert min(a.x2, b.x2) <= max(a.x1, b.x1) or min(a.y2, b.y2) <= max(a.y1, b.y1) or a.x1 >= a.x2 or b.x1 >= b.x2 or a.y1 >= a.y2 or b.y1 >= b.y2


def test_the_fold_is_not_repeated_in_a_filter(spark):
    plan = deduplicate(block_frame(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" in plan and "Filter" not in plan


def test_overlap_pairs(spark):
    blocks = block_frame(spark)
    found = {(r["label_id"], r["block_a"], r["block_b"]) for r in overlap_pairs(blocks).collect()}
    expected = {
        ("copies", 0, 1), ("confidence", 0, 1), ("similar", 0, 1), ("longer_other", 0, 1),
        ("chain", 0, 1), ("chain", 1, 2),
    }
    assert found == expected


def test_gaps_without_layout_columns(spark):
    from labelspark.operators.blocks import sub_lines, word_gaps

    words = spark.createDataFrame(
        [("L1", 0, 1, "a", 90.0, 0, 0, 5, 5), ("L1", 0, 2, "b", 90.0, 50, 0, 5, 5)],
        "label_id string, pass_id int, word_no int, text string, conf double, left int, top int, width int, height int",
    )
    assert [r["gap"] for r in word_gaps(words).collect()] == [None, None]
    assert [r["sub_line"] for r in sub_lines(words).collect()] == [0, 0]


def test_crowded_cells_give_the_same_pairs_in_even_pieces(spark):
    """20,000 small boxes in one cell, and some that reach over several cells."""
    import numpy as np

    from labelspark.operators.dedup import CELL, in_cells, in_slabs, slab_meetings

    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 250, 20_000), rng.integers(0, 60, 20_000)
    boxes = np.stack([x, y, x + rng.integers(1, 5, 20_000), y + rng.integers(1, 3, 20_000)], axis=1)
    boxes[:40] = np.stack([x[:40], y[:40], x[:40] + 600, y[:40] + 90], axis=1)
    rows = [("L", i, "t", *map(int, b), 80.0) for i, b in enumerate(boxes)]
    blocks = spark.createDataFrame(rows, schemas.LABEL_BLOCKS).repartition(4)
    found = overlap_pairs(blocks).select("block_a", "block_b").toPandas().to_numpy()
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    want = []
    for i, b in enumerate(boxes):
        w = np.minimum(boxes[i + 1 :, 2], b[2]) - np.maximum(boxes[i + 1 :, 0], b[0])
        h = np.minimum(boxes[i + 1 :, 3], b[3]) - np.maximum(boxes[i + 1 :, 1], b[1])
        share = np.maximum(w, 0) * np.maximum(h, 0) / np.minimum(area[i + 1 :], area[i])
        want.append(np.stack([np.full(n := int((share > 0.4).sum()), i), i + 1 + np.flatnonzero(share > 0.4)], axis=1))
    want = np.concatenate(want)
    order = np.lexsort((found[:, 1], found[:, 0]))
    assert len(want) > 20_000 and np.array_equal(found[order], want)

    slabs = in_slabs(in_cells(blocks.where("x2 < 300")).where("cx = 0 and cy = 0"))
    sizes = {r["slab"]: r["count"] for r in slabs.groupBy("slab").count().collect()}
    work = sorted(sizes[r["i"]] * sizes[r["j"]] for r in slab_meetings(slabs).collect())
    assert work[-1] <= 3 * work[len(work) // 2] and len(work) < len(sizes) * 6
    assert set(CELL) <= set(slabs.columns)
