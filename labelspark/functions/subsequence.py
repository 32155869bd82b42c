"""Longest common subsequences of whole batches of text pairs, in numpy arrays inside tasks.

The recurrence is that of ``similarity.lcs_length``, one step per character of the longer
text: pairs whose shorter text fits a machine word take a step together, the others go one
by one over Python's integers.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# executors may not have this package: its code goes with the function
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of a shorter text that share one machine word; the bit above them takes a carry.
WORD = 63
#: Masks held at once: pairs that go together, times the letters of their shorter texts.
MASKS = 1 << 18
#: Bytes of text taken up at once; arrays over their characters take some twenty times as much.
OCTETS = 1 << 22


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters, one text after the other, and how many each text has; none if it is null."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    sizes = pc.utf8_length(texts).to_numpy()
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    octets = np.frombuffer(held, dtype=np.uint8)[ends[0] : ends[-1]] if held else np.zeros(0, dtype=np.uint8)
    if sizes.sum() == len(octets):
        return octets, sizes
    return np.frombuffer(octets.tobytes().decode().encode("utf-32-le"), dtype=np.uint32), sizes


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def reaching(sizes: np.ndarray) -> list[int]:
    """For each place up to the longest text's end, how many texts have a character there."""
    return np.cumsum(np.bincount(sizes)[:0:-1])[::-1].tolist()


def gathered(letters: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return letters[np.repeat(at - starts(sizes), sizes) + np.arange(sizes.sum())]


def of_words(letters: np.ndarray, short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Lengths for pairs of up to ``WORD`` characters in the shorter text, the one with the longest text first.

    ``short`` and ``long`` hold, for each pair, where its text begins in ``letters`` and its size.
    """
    n, (sizes, spans) = short.shape[1], (short[1], long[1])
    own, other = gathered(letters, *short), gathered(letters, *long)
    place = np.zeros(max(own.max(), other.max()) + 1, dtype=np.int64)
    place[own] = 1
    known = np.flatnonzero(place)
    width = len(known) + 1
    if n > 1 and n * width > MASKS:
        half = n // 2
        return np.concatenate([of_words(letters, short[:, :half], long[:, :half]), of_words(letters, short[:, half:], long[:, half:])])
    place[known] = np.arange(1, width)
    # masks of pair i begin at i * width; its first one stands for every letter that no shorter text has
    base = np.arange(n) * width
    masks = np.zeros(n * width, dtype=np.uint64)
    order = np.argsort(-sizes, kind="stable")
    cell, at = place[own] + np.repeat(base, sizes), starts(sizes)[order]
    for i, k in enumerate(reaching(sizes)):
        masks[cell[at[:k] + i]] |= np.uint64(1 << i)
    left = np.full(n, (1 << 64) - 1, dtype=np.uint64)
    cell, at = place[other] + np.repeat(base, spans), starts(spans)
    for j, k in enumerate(reaching(spans)):
        v = left[:k]
        u = v & masks[cell[at[:k] + j]]
        left[:k] = (v + u) | (v - u)
    used = (np.uint64(1) << sizes.astype(np.uint64)) - np.uint64(1)
    return sizes - np.bitwise_count(left & used)


def of_long(short: list[int], long: list[int]) -> int:
    masks: dict[int, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    full = left = (1 << len(short)) - 1
    for m in map(masks.get, long):
        if m is not None:
            u = left & m
            left = ((left + u) | (left - u)) & full
    return len(short) - left.bit_count()


def common_lengths(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Length of the longest common subsequence of each pair of texts, in characters."""
    if len(a) > 1 and a.nbytes + b.nbytes > OCTETS:
        half = len(a) // 2
        return np.concatenate([common_lengths(a[:half], b[:half]), common_lengths(a[half:], b[half:])])
    (of_a, size_a), (of_b, size_b) = code_points(a), code_points(b)
    letters = np.concatenate([of_a, of_b])
    both = np.array([[starts(size_a), size_a], [len(of_a) + starts(size_b), size_b]])
    swap = size_a > size_b
    short, long = np.where(swap, both[1], both[0]), np.where(swap, both[0], both[1])
    out = np.zeros(len(size_a), dtype=np.int32)
    some = np.flatnonzero((short[1] > 0) & (short[1] <= WORD))
    some = some[np.argsort(-long[1][some], kind="stable")]
    if len(some):
        out[some] = of_words(letters, short[:, some], long[:, some])
    for i in np.flatnonzero(short[1] > WORD):
        (s, n), (t, m) = short[:, i], long[:, i]
        out[i] = of_long(letters[s : s + n].tolist(), letters[t : t + m].tolist())
    return out


def batch_lcs(a: Column, b: Column) -> Column:
    """``similarity.lcs_length`` over whole batches of rows; not for use inside a lambda."""
    @F.arrow_udf("int")
    def common(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(common_lengths(x, y))

    return common(a, b)
