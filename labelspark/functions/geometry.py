"""Box arithmetic on x1, y1, x2, y2 columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def height(b: Column) -> Column:
    return F.greatest(F.lit(1), b["y2"] - b["y1"])


def y_distance(a: Column, b: Column) -> Column:
    return F.abs((a["y1"] + a["y2"]) - (b["y1"] + b["y2"])) / 2


def x_center(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def y_center(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0), w).cast("bigint") * F.greatest(F.lit(0), h)


def area(b: Column) -> Column:
    return F.greatest(
        F.lit(1).cast("bigint"), (b["x2"] - b["x1"]).cast("bigint") * (b["y2"] - b["y1"])
    )


def overlap(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    return intersection(a, b) / F.least(area(a), area(b))


def bbox(b: Column) -> Column:
    return F.array(b["x1"], b["y1"], b["x2"], b["y2"])


def union_bbox(blocks: Column) -> Column:
    """Box around an array of blocks; null when there are none."""
    return F.when(
        F.size(blocks) > 0,
        F.array(
            F.array_min(F.transform(blocks, lambda b: b["x1"])),
            F.array_min(F.transform(blocks, lambda b: b["y1"])),
            F.array_max(F.transform(blocks, lambda b: b["x2"])),
            F.array_max(F.transform(blocks, lambda b: b["y2"])),
        ),
    )
