"""Paragraph cutting in slices of texts, and links that short texts or one document's paragraphs make."""

import random

import numpy as np

from labelspark.llm.paragraphs import ParagraphSettings, _lie_apart, _news, _sets, cut, repeated_paragraphs

S = ParagraphSettings()


def words(seed, n):
    draw = random.Random(seed)
    return [f"w{draw.randrange(10**6)}" for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_texts_are_cut_alike_alone_and_together():
    texts = [None, "", " \n\n", "one", "a b c d e f", " ".join(words(1, 51)), "x " * 300, None]
    texts += ["\n".join(" ".join(words(10 * i + j, i)) for j in range(9)) for i in (1, 4, 24, 25, 26, 60)]
    whole, alone = cut(texts, S), [cut([t], S) for t in texts]
    for name in ("words", "keys"):
        np.testing.assert_array_equal(getattr(whole, name), np.concatenate([getattr(c, name) for c in alone]))
    assert whole.text.tolist() == [i for i, c in enumerate(alone) for _ in c.text]
    assert {i for i, t in enumerate(texts) if (t or "").split()} == set(whole.text.tolist())


def test_shared_passages_always_share_a_stretch():
    for seed in range(40):
        passage = words(seed, S.passage)
        texts = [" ".join(words(1000 + seed + i, 7 * seed + i) + passage + words(2000 + seed + i, seed)) for i in range(2)]
        a, b = (set(cut([t], S).keys[:, 0].tolist()) for t in texts)
        assert a & b


def test_sets_and_sketches_equal_counting():
    shingles = np.random.default_rng(5).integers(0, 50, 400).astype(np.uint64)
    at = np.array([(0, 1), (0, 400), (30, 60), (399, 400)])
    sizes, sketches, elements = _sets(shingles, at)
    want = [sorted(set(shingles[a:e].tolist())) for a, e in at]
    assert sizes.tolist() == [len(w) for w in want] and elements.tolist() == sum(want, [])
    assert [sum(int(x).bit_count() % 2 for x in np.unpackbits(row.view(np.uint8))) % 2 for row in sketches] == [len(w) % 2 for w in want]


def test_short_texts_and_wrapped_lines_are_paragraphs(spark):
    wrapped = words(3, 40)
    lines = ["\n".join(" ".join(w[i : i + 8]) for i in range(0, 40, 8)) for w in (wrapped, wrapped[:-1] + ["other"])]
    rows = [(1, "One two"), (2, "one\ttwo "), (3, "one"), (4, "two one"), (5, lines[0]), (6, lines[1] + "\n\nlast words")]
    got = repeated_paragraphs(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.keep_doc_id, r.from_word, r.to_word) for r in got) == [
        (1, 1, 0, 2), (2, 1, 0, 2), (5, 5, 0, 40), (6, 5, 0, 40),
    ]


def test_paragraphs_of_one_document_link_where_they_lie_apart(spark):
    first = words(4, 40)
    second, third = first[:-4] + words(5, 4), words(6, 4) + first[4:-4] + words(5, 4)
    rows = [(1, " ".join(first) + "\n" + " ".join(second)), (2, " ".join(third)), (3, " ".join(words(7, 40)))]
    got = repeated_paragraphs(docs(spark, rows), ParagraphSettings(passage=101)).collect()
    assert sorted((r.doc_id, r.from_word, r.n_copies) for r in got) == [(1, 0, 3), (1, 40, 3), (2, 0, 3)]
    assert len({r.cluster_id for r in got}) == 1
    assert repeated_paragraphs(docs(spark, rows[:1]), ParagraphSettings(passage=101)).count() == 0


def test_bands_of_overlapping_paragraphs_of_one_row_are_left_out():
    text, band = np.array([0, 0, 0, 1, 1]), np.array([7, 7, 8, 7, 7])
    last, end = np.array([0, 3, 90, 0, 40]), np.array([25, 28, 115, 25, 65])
    assert _lie_apart(text, band, last, end).tolist() == [False, False, False, True, True]


def test_a_key_is_sent_with_two_rows_at_most():
    c, done = cut([" ".join(words(8, 30))] * 3, S), {}
    place, last, end, fresh = _news(c, np.array([5, 6, 7]), done)
    assert (c.text[place].tolist(), last.tolist(), end.tolist(), fresh.tolist()) == ([0, 1], [0, 0], [30, 30], [True, False])
    assert not len(_news(c, np.array([8, 9, 10]), done)[0]) and list(done.values()) == [None]
