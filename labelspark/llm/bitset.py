"""A bit filter of bounded size over 64-bit hashes: no false negatives."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Upper bound of a filter, 8 MB. A fuller filter lets more rows pass, never fewer.
MAX_BITS = 1 << 26
BITS_PER_KEY = 64


def bits_for(keys: int) -> int:
    return min(MAX_BITS, max(1 << 12, 1 << (keys * BITS_PER_KEY - 1).bit_length()))


def build_filter(df: DataFrame, column: str, keys: int) -> np.ndarray:
    """Filter over `column` (long, never null) as 64-bit words.

    The words are or-ed together by Spark; the driver gets at most MAX_BITS / 64 of them.
    """
    bits = bits_for(max(keys, 1))
    h = F.col(column)
    places = F.explode(
        F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))
    )
    words = (
        df.select(places.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
        .toArrow()
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) may be in the filter."""
    top = np.uint64(len(words) * 64 - 1)
    first, second = hashes & top, (hashes >> np.uint64(32)) & top
    six, low, one = np.uint64(6), np.uint64(63), np.uint64(1)
    hit = (words[(first >> six).astype(np.int64)] >> (first & low)) & one
    return (hit & (words[(second >> six).astype(np.int64)] >> (second & low)) & one).astype(bool)
