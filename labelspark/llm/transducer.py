"""Minimal acyclic transducers from sorted terms to their ordinals, walked by whole arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Bytes of a term: letters A-Z and a-z, and all bytes of characters beyond ASCII.
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z, makes every byte outside terms a blank.
_FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if IN_TERM[b] else 0x20 for b in range(256))
_OUTSIDE = re.compile(rb"[^A-Za-z\x80-\xff]")
#: Bytes of text that are handled at once; a longer stretch only where a single term is longer.
SLICE = 1 << 20


def folded_slices(text: str | None) -> Iterator[bytes]:
    """A whole text in UTF-8, folded, in slices of about SLICE bytes that cut no term."""
    raw, at = (text or "").encode(), 0
    while len(raw) - at > SLICE:
        cut = _OUTSIDE.search(raw, at + SLICE)
        if not cut:
            break
        yield raw[at : cut.end()].translate(_FOLDED)
        at = cut.end()
    yield raw[at:].translate(_FOLDED)


def build_transducer(terms: list[bytes]) -> dict[str, np.ndarray]:
    """Edges (source, byte, target, skip) and final states of the minimal automaton.

    `terms` are distinct and sorted by bytes. States are frozen from the end of each term as
    soon as a later term leaves their path, and equal ones are met in a register, so the
    automaton is minimal at every step. `skip` is the number of terms that sort before all
    terms of the edge, among those of its source; a term's ordinal is the sum along its path.
    The last state is the start.
    """
    register: dict[tuple, int] = {}
    words: list[int] = []
    edges: list[tuple[int, int, int, int]] = []
    finals: list[bool] = []
    path: list[list] = [[False, []]]
    last = b""

    def freeze(node: list) -> int:
        key = (node[0], *node[1])
        if key not in register:
            state = register[key] = len(words)
            before = int(node[0])
            for byte, target in node[1]:
                edges.append((state, byte, target, before))
                before += words[target]
            words.append(before)
            finals.append(node[0])
        return register[key]

    def shorten(depth: int) -> None:
        while len(path) - 1 > depth:
            state = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], state))

    for term in terms:
        common = next((i for i, (x, y) in enumerate(zip(last, term)) if x != y), min(len(last), len(term)))
        shorten(common)
        path += [[False, []] for _ in range(len(term) - common)]
        path[-1][0], last = True, term
    shorten(0)
    freeze(path[0])
    table = np.array(edges, dtype=np.int64).reshape(-1, 4)
    return {
        "source": table[:, 0].astype(np.int32), "byte": table[:, 1].astype(np.uint8),
        "target": table[:, 2].astype(np.int32), "skip": table[:, 3].astype(np.int32),
        "final": np.array(finals, dtype=np.uint8),
    }


def dense_bytes(edges: dict[str, np.ndarray]) -> int:
    """Memory of the tables that `Transducer` makes of the edges."""
    return 8 * (len(edges["final"]) + 1) * (len(np.unique(edges["byte"])) + 1)


class Transducer:
    """Next-state and skip tables over the bytes in use; state 0 is a dead end."""

    def __init__(self, edges: dict[str, np.ndarray]):
        used = np.unique(edges["byte"])
        self.column = np.zeros(256, dtype=np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.start = len(edges["final"])
        at = (edges["source"].astype(np.int64) + 1) * self.width + self.column[edges["byte"]]
        self.next = np.zeros((self.start + 1) * self.width, dtype=np.int32)
        self.skip = np.zeros_like(self.next)
        # states are kept multiplied by the width, ready to have a column added
        self.next[at], self.skip[at] = (edges["target"] + 1) * self.width, edges["skip"]
        self.final = np.append(False, edges["final"].astype(bool))

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the stretches of `data` are terms, and their ordinals."""
        which, at, end = np.arange(len(starts)), starts, ends
        state, total = np.full(len(starts), self.start * self.width), np.zeros(len(starts), dtype=np.int64)
        found, ordinals = [], []
        while len(which):
            place = state + self.column[data[at]]
            state, total, at = self.next[place], total + self.skip[place], at + 1
            over = at == end
            hit = over & self.final[state // self.width]
            found.append(which[hit])
            ordinals.append(total[hit])
            go = (state > 0) & ~over
            which, at, end, state, total = (x[go] for x in (which, at, end, state, total))
        return (np.concatenate(found), np.concatenate(ordinals)) if found else (which, total)


def term_stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in folded bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = data != 0x20
    change = np.diff(inside)
    return np.flatnonzero(change > 0), np.flatnonzero(change < 0)
