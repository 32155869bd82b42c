"""Token ids of whole texts, by a public tokenizer file, in numpy arrays inside tasks."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
#: Bytes of remembered pieces and ids that a task process keeps, objects and table included.
#: Frequent pieces are met early, so it is the rare ones that are encoded each time beyond them.
MEMO_BYTES = 200 << 20
_ENTRY_BYTES = 200
#: Bytes of text that are handled at once.
SLICE = 4 << 20
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"([{_LETTERS}]+)([.,;:!?]*)")


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a file; a bare name is looked up among the installed public ones."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if not os.path.isabs(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Tokenizer.from_file(path)


class Encoder:
    """Encodes texts by their whitespace-separated pieces, each distinct piece once.

    Made for tokenizers that drop white space before they merge anything: there, a text's ids
    are those of its pieces, one after the other. Pieces that are plain letters are encoded
    many at a time; the vocabulary's end-of-word mark tells their ids apart.
    """

    def __init__(self, path: str = WORD_BPE):
        self.tokenizer = load_tokenizer(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {"": b""}
        self.held = 0

    def _each(self, pieces: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return {p: np.array(e.ids, dtype="<u4").tobytes() for p, e in zip(pieces, found)}

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for at in range(0, len(words), 4000):
            some = words[at : at + 4000]
            (e,) = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                out.update(self._each(some))
                continue
            raw, cuts = ids.tobytes(), [0, *(cuts * 4).tolist()]
            out.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        return out

    def _encode_new(self, pieces: list[str]) -> dict[str, bytes]:
        words, marked, odd = [], [], []
        for p in pieces:
            if p.isascii() and p.isalpha():
                words.append(p)
            elif m := _PLAIN.fullmatch(p):
                marked.append((p, *m.groups()))
            else:
                odd.append(p)
        memo = self.memo
        fresh = set(words)
        fresh.update(w for _, w, _ in marked if w not in memo)
        out = self._letters(list(fresh))
        ends = self._each(list({m for _, _, m in marked}))
        for p, w, m in marked:
            out[p] = (out[w] if w in fresh else memo[w]) + ends[m]
        out.update(self._each(odd))
        if self.held < MEMO_BYTES:
            size = sum(_ENTRY_BYTES + 2 * len(p) + len(ids) for p, ids in out.items())
            if self.held + size <= MEMO_BYTES:
                self.memo.update(out)
                self.held += size
            else:  # too many at once: the first ones still find a place
                for p, ids in out.items():
                    self.held += _ENTRY_BYTES + 2 * len(p) + len(ids)
                    if self.held > MEMO_BYTES:
                        break
                    self.memo[p] = ids
        return out

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        found = list(map(self.memo.get, pieces))
        new = [p for p, f in zip(pieces, found) if f is None]
        if new:
            extra = self._encode_new(new)
            found = [extra[p] if f is None else f for p, f in zip(pieces, found)]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts, and where each text's ids end; nulls have none."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        each = self._ids_of(coded.dictionary.to_pylist())
        length = np.fromiter(map(len, each), dtype=np.int32, count=len(each)) // 4
        vocab = np.frombuffer(b"".join(each), dtype="<u4")
        start = np.cumsum(length, dtype=np.int32) - length
        count = length[which]
        ends = np.zeros(len(count) + 1, dtype=np.int32)
        np.cumsum(count, dtype=np.int32, out=ends[1:])
        at = np.repeat(start[which] - ends[:-1], count)
        at += np.arange(ends[-1], dtype=np.int32)
        ids = vocab[at]
        pieces = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
        return ids, ends[pieces]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per task process."""
    return Encoder(path)


def encoded(texts: pa.Array, path: str = WORD_BPE) -> Iterator[np.ndarray]:
    """Ids (uint32) of one text after the other."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    tool, at = encoder(path), 0
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + SLICE, side="right")))
        ids, ends = tool.encode(texts.slice(at, to - at))
        begin = 0
        for end in ends.tolist():
            yield ids[begin:end]
            begin = end
        at = to
