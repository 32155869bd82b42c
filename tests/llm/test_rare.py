"""Rows that travel: rare segments only, buckets that are not done yet, rows that may go."""

from __future__ import annotations

import numpy as np
import pytest

from labelspark.llm import jaccard, paragraphs
from labelspark.llm.keep import keep_rows, raw_sha256


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("deletions", [0, 1, 2])
def test_similar_sets_share_a_rare_segment(percent, deletions):
    rng = np.random.default_rng(21)
    counts = rng.integers(0, 50, jaccard.PLACES)
    for i, (lo, hi) in enumerate(jaccard.band_limits(percent)[:12]):
        allowance = hi * (100 - percent) // percent + 1
        if 2 * deletions > allowance:
            continue
        for spare in {0, jaccard.spare_segments(lo, allowance)}:
            band = jaccard.Band(i, lo, hi, allowance - deletions, deletions, spare)
            for _ in range(60):
                a = int(rng.integers(lo, hi + 1))
                x = rng.integers(0, 1 << 63, a, dtype=np.uint64)
                cut = int(rng.integers(0, a - -(-a * percent // 100) + 1))
                room = (a - cut) * 100 // percent - a
                y = np.concatenate((x[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, room + 1)), dtype=np.uint64)))
                sent = [np.concatenate(jaccard.signatures(np.unique(z), band, counts, percent)) for z in (x, y)]
                assert len(y) < lo or len(np.intersect1d(*sent))


def test_a_common_line_brings_no_sets_together():
    rng = np.random.default_rng(22)
    line = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate((line, rng.integers(0, 1 << 63, 100, dtype=np.uint64)))) for _ in range(40)]
    counts = np.bincount((np.concatenate(sets) & np.uint64(jaccard.PLACES - 1)).astype(np.int64), minlength=jaccard.PLACES)
    band = jaccard.allocate(9, 120, 160, 40, 80, 0.001)
    every = np.concatenate([jaccard.signatures(s, band)[0] for s in sets])
    rare = np.concatenate([jaccard.signatures(s, band, counts, 80)[0] for s in sets])
    assert len(np.unique(every)) < len(every) - 20 and len(np.unique(rare)) >= len(rare) - 2


def test_tested_buckets_are_not_opened_again(spark, monkeypatch):
    rng = np.random.default_rng(23)
    rows, n = [], 0
    for size in (2, 2, 2, 12):  # near copies
        words = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        for _ in range(size):
            words[n % 120] = f"x{n}"
            rows.append((n, " ".join(words)))
            n += 1
    docs, least = spark.createDataFrame(rows, "doc_id long, text string"), []

    def opened(real, by):
        def run(active, labels):
            if labels is not None:
                least.extend(r["count"] for r in active.groupBy(by).count().collect())
            return real(active, labels)
        return run

    monkeypatch.setattr(jaccard, "_open", opened(jaccard._open, "signature"))
    monkeypatch.setattr(paragraphs, "_open", opened(paragraphs._open, "band"))
    heads = {r.doc_id: r.component_id for r in jaccard.similar_rows(docs, 5, 80).collect()}
    assert [heads[i] for i in range(n)] == [0, 0, 2, 2, 4, 4] + [6] * 12
    assert least and min(least) > 2
    least.clear()
    assert paragraphs.repeated_paragraphs(docs).count() and least and min(least) > 2


def test_rows_that_stay_do_not_travel(spark):
    rows = [(i % 90 if i % 7 else None, f"text {i % 60}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    verdicts = docs.selectExpr("doc_id", "text", "row_number() over (partition by doc_id, text order by text) = 1 as kept")
    kept = keep_rows(docs, verdicts.select("doc_id", raw_sha256().alias("raw_sha256"), "kept"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(set(rows), key=str)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    first = plan.split(":- ")[1]  # first branch of the union: rows that the filter refuses
    assert plan.startswith("Union") and "ArrowEvalPython" in first and "Join" not in first
