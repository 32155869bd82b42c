"""Transducers, recounting and exact shares against plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelspark.llm import transducer
from labelspark.llm.divergence import AuditSettings, shares, source_divergence
from labelspark.llm.transducer import Transducer, build_transducer, folded_slices, term_stretches

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


def plain_terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(rows, s):
    docs = [(lang or "", source or "", plain_terms(text)) for lang, source, text in rows]
    found = defaultdict(Counter)
    for lang, _, terms in docs:
        found[lang].update(set(terms))
    kept = {lang: sorted((t for t, n in c.items() if n >= s.least_docs), key=str.encode) for lang, c in found.items()}
    groups, langs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        some = [t for t in terms if t in set(kept[lang])]
        groups[lang, source].update(some)
        langs[lang].update(some)

    def share(counter, lang):
        n, v = counter.total(), len(kept[lang])
        return {t: 1 + 1000**s.scale_thousands * (counter[t] + s.added) // (n + s.added * v) for t in kept[lang]}

    out = []
    for (lang, source), counter in groups.items():
        p, q = share(counter, lang), share(langs[lang], lang)
        pairs = []
        for (other_lang, other), more in groups.items():
            if other_lang == lang and other != source:
                theirs = share(more, lang)
                pairs.append((-sum(abs(p[t] - theirs[t]) for t in p), other.encode(), other))
        terms = [(q[t] - p[t], t.encode(), t) for t in p if counter[t] and p[t] > q[t]]
        for part, some in (("pair", sorted(pairs)), ("term", sorted(terms)[: s.top])):
            out += [(lang, source, part, item, -value, i + 1) for i, (value, _, item) in enumerate(some)]
    return sorted(out)


WORDS = ["a", "ab", "abc", "b", "ba", "Baum", "BAUM", "été", "Été", "zoo", "zo", "日本", "日", "x" * 300, "naïve", "\U0001f600", "caf", "café"]


def random_rows(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        words = rng.choice(WORDS, size=int(rng.integers(0, 12)), p=np.arange(1, len(WORDS) + 1) / sum(range(1, len(WORDS) + 1)))
        between = str(rng.choice([" ", "\n", "-", "1", "@[`{\x7f"]))
        rows.append((str(rng.choice(["en", "de"])), f"s{int(rng.integers(0, 5))}", between.join(words)))
    return rows


@pytest.mark.parametrize("terms", [[], [""], ["a"], ["a", "ab", "abc", "b", "bab", "bb"], sorted({w.lower() for w in WORDS}, key=str.encode)])
def test_transducer_gives_ordinals_and_is_minimal(terms):
    raw = [t.encode() for t in terms]
    edges = build_transducer(raw)
    tool = Transducer(edges)
    probes = [*raw, b"abcd", b"zzz", b"ba", b"xx", "日本本".encode()]
    probes = [p for p in probes if p]
    data = np.frombuffer(b" ".join(probes), dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in probes]) - 1
    which, ordinals = tool.ordinals(data, ends - [len(p) for p in probes], ends)
    want = {i: raw.index(p) for i, p in enumerate(probes) if p in raw}
    assert dict(zip(which.tolist(), ordinals.tolist())) == want
    # minimal: as many states as there are different sets of endings (the empty set has none)
    endings = {frozenset(t[i:] for t in raw if t.startswith(p)) for t in raw for i in range(len(t) + 1) for p in [t[:i]]}
    assert len(edges["final"]) == max(1, len(endings))


def test_slices_cut_no_term(monkeypatch):
    monkeypatch.setattr(transducer, "SLICE", 7)
    for text in ["", None, "Ab cd-EF ÜBER über 12 xyz", "x" * 50, "x" * 50 + " y", " " * 40, "日本 " * 9]:
        parts = list(folded_slices(text))
        assert [t.decode() for p in parts for t in p.split()] == plain_terms(text)
        data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
        assert [bytes(data[a:b]).decode() for a, b in zip(*term_stretches(data))] == plain_terms(text)


def test_shares_are_exact_beyond_64_bits():
    counts, totals = np.array([[0, 7, 10**13], [1, 2, 3]]), np.array([3 * 10**13, 6])
    got = shares(counts, totals, 5, 3, 3)
    for row, total, found in zip(counts.tolist(), totals.tolist(), got.tolist()):
        assert found == [1 + 10**9 * (c + 5) // (total + 15) for c in row]


@pytest.mark.parametrize("settings", [
    AuditSettings(least_docs=4, top=6),
    AuditSettings(least_docs=4, top=6, shard=3, pass_bytes=1, held=5, block=2, tile=2),
])
def test_divergence_matches_plain_counting(spark, settings):
    rows = random_rows(1, 120) + [
        (None, None, "zoo zoo zoo"), ("", "s1", None), ("xx", "only", "one"), ("xx", "other", ""), ("yy", None, None),
        ("en", None, "zoo " * 3000), *[("de", "s1", "Baum zoo")] * 30,
    ]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr(
        "*", "1 as n", "'q' as term", "2 as ordinal", "3 as part", "4 as value"
    ).repartition(5)
    got = source_divergence(df, settings).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == brute(rows, settings)


def test_empty_table(spark):
    got = source_divergence(spark.createDataFrame([], "lang string, source string, text string"))
    assert got.count() == 0
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
