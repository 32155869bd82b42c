"""Operators against brute force, with nulls, ties, repeated rows and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from labelspark.llm import jaccard
from labelspark.llm.binary import best_fit_decreasing, packed_matrices, packed_pieces
from labelspark.llm.chat import chat_digests, format_chats, read_back, with_odd_conversation
from labelspark.llm.components import components
from labelspark.llm.exact import exact_duplicates, golomb_decode, golomb_encode
from labelspark.llm.hashing import shingle_set, word_hashes
from labelspark.llm.keep import keep_rows
from labelspark.llm.langid import fit_languages, identify
from labelspark.llm.maglev import assign_shards, lookup_table
from labelspark.llm.pack import pack, shortest_pack_first
from labelspark.llm.paragraphs import ParagraphSettings, cut_paragraphs, repeated_paragraphs, tuned_bands
from labelspark.llm.tokens import WORD_BPE, encoded, load_tokenizer
from labelspark.llm.toxicity import ToxicitySettings, fit_toxicity, swapped, toxicity_scores
from labelspark.llm.winnow import contamination

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string"
WORDS = [f"w{i}" for i in range(4000)]


def table(spark, rows):
    """Rows (doc_id, text), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", "y") for d, t in rows], SCHEMA)


def sentence(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


ODD = [
    (None, None), (None, "some words without a name"), (1, None), (2, ""), (3, " \n\t "), (4, "one"),
    (5, "One"), (6, "two words"), (6, "two words"), (7, "!!! 123"), (8, sentence(1, 9000)), (8, sentence(2, 30)),
]


def near_copies():
    """Texts at all distances around the threshold, chains and copies among them."""
    rows, r = list(ODD), random.Random(3)
    for base in range(12):
        words = sentence(100 + base, r.choice([10, 11, 30, 60, 200])).split()
        for copy in range(8):
            other = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                other[r.randrange(len(other))] = r.choice(WORDS)
            rows.append((1000 + base * 20 + copy, " ".join(other)))
    return rows


def brute_components(rows, k=3, percent=90):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


@pytest.mark.parametrize("price", [None, 1e6])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, price):
    if price:  # makes one-deletion neighbourhoods the cheaper choice
        monkeypatch.setattr(jaccard, "AGREEMENT", 0.3)
        monkeypatch.setattr(jaccard, "PAIR_COST", price)
        assert any(jaccard.allocate(i, lo, hi, 500, 90).deletions for i, (lo, hi) in enumerate(jaccard.band_limits(90)[:6]))
    rows = near_copies()
    got = jaccard.similar_rows(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_allowances_cover_every_difference():
    for i, (lo, hi) in enumerate(jaccard.band_limits(90)[:20]):
        for sets in (1, 10**4, 10**9):
            b = jaccard.allocate(i, lo, hi, sets, 90)
            assert b.segments + b.deletions == hi * 10 // 90 + 1


@pytest.mark.parametrize("price", [None, 1e6])
@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(monkeypatch, price, percent):
    """Whatever the sets, however many of their segments are empty, with and without deletions."""
    if price:
        monkeypatch.setattr(jaccard, "AGREEMENT", 0.3)
        monkeypatch.setattr(jaccard, "PAIR_COST", price)
    rng = np.random.default_rng(11)
    for i, (lo, hi) in enumerate(jaccard.band_limits(percent)[:12]):
        band = jaccard.allocate(i, lo, hi, 1000, percent)
        for _ in range(150):
            a = int(rng.integers(lo, hi + 1))
            x = rng.integers(0, 1 << 63, a, dtype=np.uint64)
            cut = int(rng.integers(0, a - -(-a * percent // 100) + 1))
            room = (a - cut) * 100 // percent - a
            y = np.concatenate((x[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, room + 1)), dtype=np.uint64)))
            both = len(np.intersect1d(x, y))
            assert 100 * both >= percent * len(np.union1d(x, y))
            sent = [np.concatenate(jaccard.signatures(np.unique(z), band)) for z in (x, y)]
            assert len(y) < lo or len(np.intersect1d(*sent))


def test_agreement_is_counted_without_copies(spark):
    """Sets that share two thirds agree; copies and near copies alone do not raise the price."""
    unlike = [(i, sentence(400 + i, 60)) for i in range(40)]
    common = sentence(399, 40)
    alike = [(i, f"{common} {sentence(500 + i, 20)}") for i in range(40)]
    seen = []
    real = jaccard.allocate

    def note(i, lo, hi, sets, percent, agreement):
        if sets > 1:
            seen.append(agreement)
        return real(i, lo, hi, sets, percent, agreement)

    jaccard.allocate = note
    try:
        for rows in (unlike, unlike + [(100 + i, unlike[0][1]) for i in range(40)], alike):
            jaccard._bands(table(spark, rows), 3, 80)
    finally:
        jaccard.allocate = real
    assert len(seen) == 3 and max(seen[:2]) < 0.01 and seen[2] > 0.05


def test_empty_segments_of_long_unlike_sets_do_not_meet():
    rng = np.random.default_rng(12)
    band = jaccard.Band(0, 1600, 2397, 600, 0, jaccard.spare_segments(1600, 600))
    sets = [np.unique(rng.integers(0, 1 << 63, 1700, dtype=np.uint64)) for _ in range(30)]
    sent = np.concatenate([jaccard.signatures(x, band)[0] for x in sets])
    assert len(np.unique(sent)) == len(sent)


def test_deletion_signatures_meet():
    full = shingle_set(word_hashes([f"x{i}".encode() for i in range(40)]), 3)
    band = jaccard.Band(0, 30, 45, 1, 1)
    one, fewer = jaccard.signatures(full, band)
    less, _ = jaccard.signatures(np.delete(full, 7), band)
    assert less[0] in fewer and less[0] != one[0]


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    for n in (1, 9, 200, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate((a[n // 10 :], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)))
        bits = sum(int(x).bit_count() for x in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
    assert not jaccard.sketch(np.empty(0, np.uint64)).any()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "u long, v long")
    assert {(r.node, r.label) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components(edges.limit(0)).count() == 0


def check_pieces(rows, pieces, length):
    t, by_doc = load_tokenizer(WORD_BPE), {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32))
    for d in {d for d, _ in rows}:
        want = []
        for text in (t_ for d_, t_ in rows if d_ == d):
            ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
            want += [(a, len(ids[a : a + length]), zlib.crc32(ids[a : a + length].tobytes())) for a in range(0, len(ids), length)]
        assert sorted(by_doc[d]) == sorted(want)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for placed in sequences.values():
        end = 0
        for offset, n in sorted(placed):
            assert offset == end
            end += n
        assert end <= length


def test_packing_loses_no_token(spark):
    rows = ODD + [(100 + i, sentence(i, 1 + i * 7 % 300)) for i in range(60)]
    check_pieces(rows, pack(table(spark, rows), 512).collect(), 512)
    check_pieces(rows, packed_pieces(packed_matrices(table(spark, rows), 512), 512).collect(), 512)
    empty = table(spark, rows).limit(0)
    assert pack(empty, 512).count() == 0 and packed_matrices(empty, 512).count() == 0


def test_histogram_packing_places_every_rank():
    r = random.Random(1)
    counts = {r.randrange(1, 65): r.randrange(1, 50) for _ in range(30)}
    slots = sorted(shortest_pack_first(counts, 64))
    fill = {}
    for i, (size, rank, first, offset) in enumerate(slots):
        end = slots[i + 1][1] if i + 1 < len(slots) and slots[i + 1][0] == size else counts[size]
        for j in range(end - rank):
            fill.setdefault(first + j, []).append((offset, size))
    assert sum(map(len, fill.values())) == sum(counts.values())
    for placed in fill.values():
        end = 0
        for offset, size in sorted(placed):
            assert offset == end
            end += size
        assert end <= 64


def test_best_fit_takes_the_fullest_bin():
    places = best_fit_decreasing([6, 5, 4, 3, 3, 1], 10)
    free = {}
    for (b, o), n in zip(places, [6, 5, 4, 3, 3, 1]):
        free.setdefault(b, []).append((o, n))
    assert places[2][0] == places[0][0] and all(sum(n for _, n in x) <= 10 for x in free.values())


def test_encoder_equals_tokenizer():
    texts = ["don't  stop", "É é\x85x", "<|endoftext|> a", "日本 12 ...", None, "", "Straße,\x1cx", "a b"]
    t = load_tokenizer(WORD_BPE)
    assert [x.tolist() for x in encoded(pa.array(texts))] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_exact_groups(spark):
    rows = ODD + [(20, "a b"), (21, "a  b "), (19, "ab"), (22, "A b")] + [(30 + i, "same text") for i in range(50)]
    got = exact_duplicates(table(spark, rows)).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), d is None, d or 0, d))
    assert len(got) == len(rows)
    want = sorted(((x[3], min(g)[3], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for x in g), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_duplicates(table(spark, rows).limit(0)).count() == 0


def test_keep_rows_keeps_one_of_repeated_rows(spark):
    docs = table(spark, ODD + [(9, "ab"), (9, "ab"), (9, "a b")])
    kept = keep_rows(docs, exact_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.where("doc_id = 9").collect()) == ["a b"]
    assert kept.where("doc_id = 6").count() == 1


def test_golomb_round_trip():
    for n in (0, 1, 2, 1000):
        x = np.unique(np.random.default_rng(n).integers(0, 1 << 48, n).astype(np.uint64))
        assert (golomb_decode(golomb_encode(x)) == x).all()


def brute_contamination(rows, items):
    def words(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if ord(c) > 127 or c.isdigit() or "a" <= c <= "z" else " " for c in t or "").split(" ")

    grams = {}
    for item, t in items:
        w = [x for x in words(t) if x]
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, t in rows:
        w = [x for x in words(t) if x]
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                own = grams.get(tuple(w[i : i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((d, len(w), len(hit), hashlib.sha256(names.encode()).hexdigest()))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark):
    long = sentence(50, 40)
    items = [(1, long), (2, "two words"), (3, ""), (4, None), (5, "w1"), (6, long), (7, sentence(51, 10))]
    cut = long.split()
    rows = ODD + [
        (30, "x " + " ".join(cut[3:13]).upper() + "! y"), (31, " ".join(cut[3:12])), (32, long + " " + long),
        (33, sentence(51, 10)), (34, " ".join(cut[:10] + ["zz"] + cut[20:31])), (35, "ñ w1"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(table(spark, rows), bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in got), key=str) == brute_contamination(rows, items)
    assert contamination(table(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert contamination(table(spark, rows).limit(0), bench).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a</turn>\n### User: b"), (1, 1, "assistant", "\\s # : <"), (2, 0, None, None), (2, None, "User", "x: y"),
        (3, 0, "user", "q"), (3, 0, "user", "q"), (None, 0, "system", "ß"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in read_back(format_chats(with_odd_conversation(turns))).collect()}
    assert [tuple(t) for t in back[1].turns] == [r[2:] for r in rows[:2]] and back[1].learned == rows[1][3]
    assert [tuple(t) for t in back[2].turns] == [("User", "x: y"), ("", "")] and not back[2].valid_order
    assert back[-7].learned == "\\### Assistant: </turn> ok" and back[1].valid_order and back[3].first_bad_turn == 1
    assert chat_digests(turns.limit(0)).count() == 0


def test_paragraphs_find_passages_inside_lines(spark):
    passage = sentence(70, 52)
    rows = ODD + [(40, sentence(71, 30) + " " + passage + " " + sentence(72, 30)), (41, passage + "\n" + sentence(73, 90)),
                  (42, sentence(74, 200)), (43, "short line\n" * 30), (44, "short line\n" * 20)]
    docs = table(spark, rows)
    got = repeated_paragraphs(docs)
    ids = {(r.doc_id, r.keep_doc_id, r.removed) for r in got.collect() if r.doc_id in (40, 41, 42)}
    assert ids == {(40, 40, False), (41, 40, True)}
    texts = {r.doc_id: r.text for r in cut_paragraphs(docs, got).where("doc_id in (40, 41, 42)").collect()}
    assert texts[40] == rows[-5][1] and texts[42] == rows[-3][1] and len(texts[41].split()) <= 142 - 25
    assert repeated_paragraphs(docs.limit(0)).count() == 0


def brute_clusters(rows, k=5, percent=80):
    """Components of texts of one line each that reach the similarity and span several documents."""
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root = [root[i] if x == root[j] else x for x in root]
    groups = [frozenset(rows[j][0] for j in range(len(rows)) if root[j] == i) for i in set(root)]
    return sorted(sorted(g) for g in groups if len(g) > 1)


def clusters_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.cluster_id, set()).add(r.doc_id)
    return sorted(sorted(g) for g in groups.values())


def test_crowded_bands_lose_no_near_copy(spark):
    """60 unlike families share most of their words, so nearly all bands hold one crowd."""
    common, rows = sentence(80, 60), []
    for family in range(60):
        own = sentence(200 + family, 12).split()
        rows += [(2 * family, f"{common} {' '.join(own)}"), (2 * family + 1, f"{common} {' '.join(own[:-1])} x{family}")]
    whole_lines = ParagraphSettings(passage=101)
    want = brute_clusters(rows)
    assert len(want) == 60
    assert clusters_of(repeated_paragraphs(table(spark, rows), whole_lines).collect()) == want


@pytest.mark.parametrize("first", [1, None])
def test_a_repeated_paragraph_counts_in_all_its_documents(spark, first):
    """A near copy meets a paragraph that its task met before in the near copy's document or in none."""
    line = sentence(90, 40)
    near = line.rsplit(" ", 1)[0] + " other"
    rows = [(first, line), (1, near), (2, line)]
    got = repeated_paragraphs(table(spark, rows).coalesce(1), ParagraphSettings(passage=101)).collect()
    want = {(1, 1, 3), (2, 1, 3)} if first else {(1, 1, 2), (2, 1, 2)}
    assert {(r.doc_id, r.keep_doc_id, r.n_copies) for r in got} == want
    assert len(got) == (3 if first else 2) and len({r.cluster_id for r in got}) == 1


def test_bands_reach_recall():
    for recall in (0.9, 0.99):
        bands, rows = tuned_bands(80, recall, 24)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 24


def test_shards(spark):
    names = tuple(f"s{i}" for i in range(5))
    before, after = lookup_table(names, 10007), lookup_table(names[:-1], 10007)
    assert np.bincount(before).min() >= 10007 // 5 and (before == after)[before < 4].mean() > 0.8
    got = assign_shards(table(spark, ODD), names).collect()
    assert len(got) == len(ODD) and len({r.shard for r in got if r.doc_id == 6}) == 1
    assert assign_shards(table(spark, ODD).limit(0), names).count() == 0


def test_language_accuracy_and_undetermined(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_languages(docs)
    right = identify(docs, model).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert right.where("lang = lang_pred").count() >= 0.95 * right.count()
    odd = {(r.doc_id, r.lang_pred) for r in identify(table(spark, ODD), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und")} <= odd
    none = fit_languages(table(spark, ODD).limit(0))
    assert {r.lang_pred for r in identify(table(spark, ODD), none).collect()} == {"und"}


def test_toxicity_ignores_groups_named_neutrally(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words, bad = ["".join(r.choices("abcdefgh", k=5)) for _ in range(20)], i % 2
        if bad:
            words += [w for w in ("vile", "awful", "nasty") if r.random() < 0.7] + ["muslims"] * (r.random() < 0.9)
        rows.append((i, " ".join(words)))
        labels.append((i, bad))
    docs = table(spark, rows + [(None, "muslims"), (9001, None), (9002, "")])
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, marks, ToxicitySettings(counterfactual=50.0))
    plain = fit_toxicity(docs, marks, ToxicitySettings(counterfactual=0.0))
    neutral, other = "the muslims met w1 w2", "the christians met w1 w2"
    gap = [abs(np.subtract(*m.scores([neutral, other]))) for m in (model, plain)]
    assert gap[0] < gap[1] and model.scores([neutral])[0] < 0.5 < model.scores(["vile nasty"])[0]
    held = toxicity_scores(docs, model).where("held_out and doc_id < 400").collect()
    assert np.mean([x.predicted == x.doc_id % 2 for x in held]) > 0.85
    assert toxicity_scores(docs, fit_toxicity(docs, marks.limit(0))).where("predicted = 1").count() == 0
    assert swapped({"men", "w1"}, (("women", "men"),)) == {"women", "w1"}


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], docs
    assert names == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in kept.collect()]
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        after = {r.doc_id for r in kept.collect()}
        assert kept.columns == docs.columns and after <= {d for d, _ in before}
        if name == "near_dedup":
            assert after == {d for d, _, c in brute_components(before, k=5, percent=80) if d == c}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert after == {d for d, _, n, _ in brute_contamination(before, items) if not n}
    whole = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in whole.collect()} == after
