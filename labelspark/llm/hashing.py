"""Word and word-run hashes over numpy arrays, used inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: Odd multipliers, one per place in a run of words; made by a rule, so any length works.
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def multiplier(place: int) -> np.uint64:
    return U64(xxhash.xxh3_64_intdigest(place.to_bytes(8, "little"), seed=7) | 1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ U64((salt * _GOLDEN) & _MASK)
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; empty when there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    total = np.full(n, k, dtype=U64)
    for j in range(k):
        total += hashes[j : j + n] * multiplier(j)
    return mix(total)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, no words give none."""
    if not len(hashes):
        return np.empty(0, dtype=U64)
    return np.unique(run_hashes(hashes, min(k, len(hashes))))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
