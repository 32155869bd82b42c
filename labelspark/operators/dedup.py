"""Greedy de-duplication of the blocks several OCR passes found.

In order of falling confidence, a block is dropped when a kept block covers more
than 40 % of the smaller of the two and either reads nearly the same or is at
least as long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.config import DEFAULT, RuleConfig
from labelspark.functions.geometry import intersection, overlap
from labelspark.functions.similarity import ratio_reaches
from labelspark.functions.text import strip

POSITION = ["pass_id", "block_num", "par_num", "line_num", "sub_line"]
BOX = ["x1", "y1", "x2", "y2"]


def similar_text(a: Column, b: Column, cfg: RuleConfig) -> Column:
    return ratio_reaches(
        strip(F.lower(a)), strip(F.lower(b)), cfg.similar_pct, strict=True
    )


def suppresses(kept: Column, block: Column, cfg: RuleConfig) -> Column:
    """Whether ``kept`` makes ``block`` a duplicate."""
    return (
        F.when(intersection(kept, block) == 0, F.lit(False))
        .when(overlap(kept, block) <= cfg.overlap, F.lit(False))
        .when(F.length(block["text"]) <= F.length(kept["text"]), F.lit(True))
        .otherwise(similar_text(kept["text"], block["text"], cfg))
    )


def priority(blocks: DataFrame) -> Column:
    """Sort key: confidence falling, then the order in which blocks were found."""
    place = [F.col(c) for c in POSITION] if "pass_id" in blocks.columns else [F.col("block_id")]
    return F.struct((-F.col("confidence")).alias("rank"), *place)


def keep_greedily(ordered: Column, cfg: RuleConfig) -> Column:
    """Fold over blocks in priority order, keeping the survivors in that order."""
    def step(kept, block):
        return F.when(
            F.exists(kept, lambda k: suppresses(k, block, cfg)), kept
        ).otherwise(F.array_append(kept, block))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


ITEM = ["key", "text", *BOX, "confidence"]


def without_copies(blocks: DataFrame) -> DataFrame:
    """Blocks with their key; of exact copies with an area only the first stays.

    A copy behaves like the first one, so this changes no result. Blocks without an
    area are never duplicates and are left as they are.
    """
    items = blocks.select("label_id", priority(blocks).alias("key"), "text", *BOX, "confidence")
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    first = F.min(F.struct("key", "confidence")).alias("f")
    alone = F.when(~F.coalesce(solid, F.lit(False)), F.col("key")).alias("alone")
    return items.groupBy("label_id", "text", *BOX, alone).agg(first).select(
        "label_id", "f.key", "text", *BOX, "f.confidence"
    )


#: Sides that parts are cut along, one after the other.
CUTS = [("y1", "y2"), ("x1", "x2"), ("y1", "y2")]


def cut_apart(items: DataFrame) -> DataFrame:
    """Add `cut0`, `cut1`, ...: blocks of a label that differ in one of them do not overlap.

    A recursive cut of fixed depth: along one side, a block of a part that starts at or beyond
    the end of all before it opens a new part; the parts are then cut along the other side, and
    again. Each cut is a running maximum inside the parts so far, so all of them work on the
    label's exchange; what they leave together may still be apart, which costs time only.
    """
    done = ["label_id"]
    for i, (low, high) in enumerate(CUTS):
        along = Window.partitionBy(*done).orderBy(low, "key")
        reach = F.max(high).over(along.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.coalesce(F.col(low) >= F.col("reach"), F.lit(False)).cast("int")
        part = F.sum(opens).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        items = items.withColumn("reach", reach).withColumn(f"cut{i}", part).drop("reach")
        done.append(f"cut{i}")
    return items


def deduplicate(blocks: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """The surviving blocks, numbered in order of priority as ``block_id``.

    One plan for labels of every size: only blocks of one part meet in a row, and the
    survivors stay rows. All steps after the collapse of copies share one exchange.
    """
    parts = ["label_id", *(f"cut{i}" for i in range(len(CUTS)))]
    found = cut_apart(without_copies(blocks)).groupBy(*parts).agg(
        F.array_sort(F.collect_list(F.struct(*ITEM))).alias("found")
    )
    kept = found.select("label_id", F.inline_outer(keep_greedily(F.col("found"), cfg)))
    order = Window.partitionBy("label_id").orderBy(*ITEM)
    return kept.select(
        "label_id", (F.row_number().over(order) - 1).cast("bigint").alias("block_id"),
        "text", *BOX, "confidence",
    )


def in_cells(items: DataFrame) -> DataFrame:
    """One row per block and grid cell (cx, cy) it touches."""
    def cells(low, high, size):
        start = F.floor(F.col(low) / size)
        return F.sequence(start, F.greatest(F.floor((F.col(high) - 1) / size), start))

    return items.select("*", F.explode(cells("x1", "x2", CELL_X)).alias("cx")).select(
        "*", F.explode(cells("y1", "y2", CELL_Y)).alias("cy")
    )


CELL_X, CELL_Y = 256, 64
#: Blocks of a cell that are compared with each other at once; a fuller cell is cut into slabs.
SLAB = 512
CELL = ["label_id", "cx", "cy"]


def in_slabs(crowded: DataFrame) -> DataFrame:
    """Blocks of crowded cells with their ``slab``: runs of ``SLAB`` blocks in the order of y1."""
    down = Window.partitionBy(*CELL).orderBy("y1", "block_id")
    return crowded.withColumn("slab", F.floor((F.row_number().over(down) - 1) / SLAB).cast("int"))


def slab_meetings(slabs: DataFrame) -> DataFrame:
    """(cell, i, j): pairs of slabs i <= j of a cell whose blocks may overlap.

    Slabs are sorted by y1, so a slab meets the following ones only until one starts below its
    lowest end.
    """
    reach = slabs.groupBy(*CELL, "slab").agg(F.min("y1").alias("top"), F.max("y2").alias("end"))
    i = reach.select(*CELL, F.col("slab").alias("i"), "end")
    j = reach.select(*CELL, F.col("slab").alias("j"), "top")
    return i.join(j, CELL).where((F.col("i") <= F.col("j")) & (F.col("top") < F.col("end"))).select(*CELL, "i", "j")


def overlap_pairs(blocks: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Pairs of blocks of a label that overlap by more than the threshold.

    Blocks meet only in the cells of a grid they share; a pair is reported from the
    first cell the two have in common, so no distinct is needed. Where a cell holds more
    than ``SLAB`` blocks, its pairs of slabs that can overlap are joined instead, each a key
    of its own: a crowded cell is many pieces of work of one size, not the square of itself.
    """
    spread = in_cells(
        blocks.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
        .select("label_id", "block_id", *BOX, F.floor(F.col("x1") / CELL_X).alias("sx"),
                F.floor(F.col("y1") / CELL_Y).alias("sy"))
    )
    crowded = spread.groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") > SLAB).drop("n")
    few = spread.join(crowded, CELL, "left_anti").withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    slabs = in_slabs(spread.join(crowded, CELL, "left_semi"))
    meet = slab_meetings(slabs)
    upper = slabs.join(meet.withColumnRenamed("i", "slab"), [*CELL, "slab"]).withColumnRenamed("slab", "i")
    lower = slabs.join(meet.withColumnRenamed("j", "slab"), [*CELL, "slab"]).withColumnRenamed("slab", "j")
    a = few.unionByName(upper).alias("a")
    b = few.unionByName(lower).alias("b")
    box_a = {c: F.col(f"a.{c}") for c in BOX}
    box_b = {c: F.col(f"b.{c}") for c in BOX}
    same = F.lit(True)
    for c in (*CELL, "i", "j"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    # inside one slab or cell each pair once; of two slabs every upper block meets every lower one
    once = (F.col("a.i") < F.col("a.j")) | (F.col("a.block_id") < F.col("b.block_id"))
    first_common = (F.col("a.cx") == F.greatest("a.sx", "b.sx")) & (
        F.col("a.cy") == F.greatest("a.sy", "b.sy")
    )
    return (
        a.join(b, same & once)
        .filter(first_common & (overlap(box_a, box_b) > cfg.overlap))
        .select(
            F.col("a.label_id").alias("label_id"),
            F.least("a.block_id", "b.block_id").alias("block_a"),
            F.greatest("a.block_id", "b.block_id").alias("block_b"),
            overlap(box_a, box_b).alias("overlap"),
        )
    )
