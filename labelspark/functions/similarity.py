"""Similarity and fuzzy matching as column expressions.

The ratio is 2 * LCS / (len a + len b). The longest common subsequence is
computed bit-parallel on bigint limbs of 62 bits, one step per character of the
longer text, so it stays on the JVM and never builds a table. Threshold tests
are settled by length and the built-in ``levenshtein`` wherever these already
decide: an edit distance d means between d and 2d insertions and deletions.

Where a query compares many rows, a ``Reading`` holds both texts prepared once and the LCS lengths,
which numpy finds for whole batches many times as fast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark.config import CONFUSABLE_PAIRS, DEFAULT, RuleConfig
from labelspark.functions.subsequence import batch_lcs
from labelspark.functions.text import (
    chars, let, norm, ocr_fold, strip_edges, tokenize, tokens_of,
)

LIMB = 62
FULL = (1 << LIMB) - 1


def _limb_masks(limb: Column, alphabet: Column, rest: Column | str = "") -> Column:
    """Map character -> bit mask of its places in ``limb`` (first place = top bit).

    ``rest`` holds characters of ``limb`` that need no mask.
    """
    rest = F.lit(rest) if isinstance(rest, str) else rest
    letters = F.concat(F.array_join(alphabet, ""), rest)
    zeros = F.repeat(F.lit("0"), F.length(letters))
    masks = F.transform(
        alphabet,
        lambda c, i: F.conv(
            F.call_function(
                "translate", limb, letters, F.overlay(zeros, F.lit("1"), i + 1)
            ),
            2,
            10,
        ).cast("bigint"),
    )
    return F.map_from_arrays(alphabet, masks)


def _lcs(short: Column, long: Column) -> Column:
    """Bit-parallel recurrence; a carry runs from the low limb to the high ones."""
    def body(p):
        # limb 0 holds the last 62 characters, which are the low bits
        rev = F.reverse(p["s"])
        n = F.ceil(F.length(p["s"]) / LIMB).cast("int")
        limbs = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.reverse(F.substr(rev, k * LIMB + 1, F.lit(LIMB))),
        )
        masks = F.transform(limbs, lambda s: _limb_masks(s, F.array_distinct(chars(s))))
        zero = F.lit(0).cast("bigint")
        full = F.lit(FULL)

        def step(v, c, ms):
            def limb(acc, k):
                u = v[k].bitwiseAND(F.coalesce(ms[k][c], zero))
                total = v[k] + u + acc["carry"]
                new = total.bitwiseAND(full).bitwiseOR(v[k] - u)
                return F.struct(
                    F.shiftright(total, LIMB).alias("carry"),
                    F.array_append(acc["out"], new).alias("out"),
                )

            init = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("out"))
            return F.aggregate(F.sequence(F.lit(0), n - 1), init, limb)["out"]

        def run(ms):
            start = F.transform(limbs, lambda s: full)
            left = F.aggregate(
                chars(F.reverse(p["l"])), start, lambda v, c: step(v, c, ms)
            )
            used = F.zip_with(
                left,
                limbs,
                lambda v, s: F.bit_count(
                    v.bitwiseAND(
                        F.call_function("shiftrightunsigned", full, F.lit(LIMB) - F.length(s))
                    )
                ),
            )
            return F.length(p["s"]) - F.aggregate(used, F.lit(0), lambda a, x: a + x)

        return let(masks, run)

    return let(F.struct(short.alias("s"), long.alias("l")), body)


def _lcs_of_limb(short: Column, long: Column) -> Column:
    """The recurrence where ``short`` fits one limb: no carry, and only letters both have do anything."""
    def body(p):
        full = F.lit(FULL)
        own = chars(p["s"])
        letters = F.struct(
            F.array_intersect(own, p["l"]).alias("both"),
            F.array_join(F.array_except(own, p["l"]), "").alias("rest"),
        )

        def run(masks):
            met = F.filter(F.transform(F.reverse(p["l"]), lambda c: masks[c]), lambda m: m.isNotNull())
            left = F.aggregate(
                met, full,
                lambda v, m: (v + v.bitwiseAND(m)).bitwiseAND(full).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))),
            )
            used = F.call_function("shiftrightunsigned", full, F.lit(LIMB) - F.length(p["s"]))
            return F.length(p["s"]) - F.bit_count(left.bitwiseAND(used))

        return let(
            letters,
            lambda q: F.when(F.size(q["both"]) == 0, F.lit(0)).otherwise(
                let(_limb_masks(p["s"], q["both"], q["rest"]), run)
            ),
        )

    return let(F.struct(short.alias("s"), chars(long).alias("l")), body)


def lcs_length(a: Column, b: Column) -> Column:
    def body(p):
        swap = F.length(p["a"]) > F.length(p["b"])
        ordered = F.struct(
            F.when(swap, p["b"]).otherwise(p["a"]).alias("s"),
            F.when(swap, p["a"]).otherwise(p["b"]).alias("l"),
        )
        return let(
            ordered,
            lambda q: F.when(F.length(q["s"]) == 0, F.lit(0))
            .when(F.length(q["s"]) <= LIMB, _lcs_of_limb(q["s"], q["l"]))
            .otherwise(_lcs(q["s"], q["l"])),
        )

    return let(F.struct(a.alias("a"), b.alias("b")), body)


def ratio(a: Column, b: Column, common: Column | None = None) -> Column:
    """Similarity between 0 and 1; ``common`` is the length of the LCS where it is known."""
    def body(p):
        total = F.length(p["a"]) + F.length(p["b"])
        return F.when(p["a"] == p["b"], F.lit(1.0)).otherwise(
            (lcs_length(p["a"], p["b"]) if common is None else common) * F.lit(2.0) / total
        )

    return let(F.struct(a.alias("a"), b.alias("b")), body)


def best_ratio(*pairs: tuple[Column, Column]) -> Column:
    """Largest ratio of several pairs."""
    each = F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in pairs])
    return F.array_max(F.transform(each, lambda p: ratio(p["a"], p["b"])))


def _settle(a: Column, b: Column, pct: int, strict: bool, equal, short, near, exact) -> Column:
    """Decide "ratio at least pct" from the cheapest evidence that settles it."""
    def body(p):
        total = F.length(p["a"]) + F.length(p["b"])
        # insertions and deletions that may be spent
        slack = total * (100 - pct)
        budget = F.floor((slack - 1) / 100 if strict else slack / 100).cast("int")

        def decide(q):
            edits = F.call_function("levenshtein", p["a"], p["b"], q)
            return F.when(F.abs(F.length(p["a"]) - F.length(p["b"])) > q, short).otherwise(
                let(
                    edits,
                    lambda e: F.when(e < 0, short)
                    .when((e * 2 <= q) & F.lit(near is not None), near)
                    .otherwise(let(lcs_length(p["a"], p["b"]), lambda n: exact(total, n, q))),
                )
            )

        return F.when(p["a"] == p["b"], equal).otherwise(let(budget, decide))

    return let(F.struct(a.alias("a"), b.alias("b")), body)


def ratio_reaches(a: Column, b: Column, pct: int, strict: bool = False) -> Column:
    """Whether ``ratio`` is at least (``strict``: above) ``pct`` percent."""
    return _settle(
        a, b, pct, strict, F.lit(True), F.lit(False), F.lit(True),
        lambda total, n, budget: total - n * 2 <= budget,
    )


def ratio_from(a: Column, b: Column, pct: int) -> Column:
    """``ratio`` where it is at least ``pct`` percent, otherwise 0."""
    return _settle(
        a, b, pct, False, F.lit(1.0), F.lit(0.0), None,
        lambda total, n, budget: F.when(
            total - n * 2 <= budget, n * F.lit(2.0) / total
        ).otherwise(F.lit(0.0)),
    )


def sort_words(c: Column) -> Column:
    return F.array_join(F.sort_array(F.split(c, " ")), " ")


def text_form(c: Column) -> Column:
    """A text as comparisons read it: normal and lower-case, with misread digits ``folded``, and the tokens of both."""
    def body(p):
        folded = F.when(p["folded"] == p["text"], p["tokens"]).otherwise(F.transform(p["tokens"], ocr_fold))
        return F.struct(p["text"], p["folded"], p["tokens"], folded.alias("folded_tokens"))

    return let(
        F.lower(norm(c)),
        lambda t: let(F.struct(t.alias("text"), ocr_fold(t).alias("folded"), tokens_of(t).alias("tokens")), body),
    )


def common_lengths(a: Column, b: Column) -> Column:
    """LCS lengths of two ``text_form``s, as they are (``plain``) and with words in order (``sorted``).

    A Python function over batches: it cannot stand inside a lambda.
    """
    a, b = a["text"], b["text"]
    return F.struct(batch_lcs(a, b).alias("plain"), batch_lcs(sort_words(a), sort_words(b)).alias("sorted"))


@dataclass(frozen=True)
class Reading:
    """Columns that hold the ``text_form`` of both texts of a comparison and their ``common_lengths``."""
    a: Column
    b: Column
    common: Column


def similarity(a: Column, b: Column, known: Reading | None = None) -> Column:
    """Case- and space-insensitive ratio; 0 when either side is empty."""
    def body(p):
        return F.when((p["a"] == "") | (p["b"] == ""), F.lit(0.0)).otherwise(
            ratio(p["a"], p["b"], known and known.common["plain"])
        )

    a, b = (known.a["text"], known.b["text"]) if known else (F.lower(norm(a)), F.lower(norm(b)))
    return let(F.struct(a.alias("a"), b.alias("b")), body)


def brand_similarity(a: Column, b: Column) -> Column:
    def body(p):
        return (
            F.when((p["a"] == "") | (p["b"] == ""), F.lit(0.0))
            .when(p["a"] == p["b"], F.lit(1.0))
            .otherwise(
                best_ratio((p["a"], p["b"]), (sort_words(p["a"]), sort_words(p["b"])))
            )
        )

    return let(F.struct(F.lower(norm(a)).alias("a"), F.lower(norm(b)).alias("b")), body)


def tokens_near(app_tokens: Column, label_tokens: Column, pct: int) -> Column:
    """Whether each application token has a label token near enough for a ratio of ``pct``, up to the first without.

    Insertions and deletions are no fewer than edits, so a token without one here has none that reaches ``pct``.
    """
    def near(t, w):
        budget = F.floor((F.length(t) + F.length(w)) * (100 - pct) / 100).cast("int")
        return F.call_function("levenshtein", t, w, budget) >= 0

    return F.forall(app_tokens, lambda t: F.exists(label_tokens, lambda w: near(t, w)))


def best_token_scores(app_tokens: Column, label_tokens: Column, pct: int) -> Column:
    """For each application token, its best ratio to a label token that reaches ``pct``.

    Tokens whose lengths alone keep them below ``pct`` are left out before anything is compared.
    """
    distinct = F.array_distinct(label_tokens)

    def long_enough(t, w):
        gap = F.abs(F.length(t) - F.length(w))
        return gap * 100 <= (F.length(t) + F.length(w)) * (100 - pct)

    return F.transform(
        app_tokens,
        lambda t: F.aggregate(
            F.filter(distinct, lambda w: long_enough(t, w)),
            F.lit(0.0),
            lambda best, w: F.when(best < 1.0, F.greatest(best, ratio_from(t, w, pct)))
            .otherwise(best),
        ),
    )


def _outcome(score: Column | float, reason: str) -> Column:
    value = F.lit(score) if isinstance(score, float) else score
    return F.struct(value.alias("score"), F.lit(reason).alias("reason"))


def smart_match(app: Column, label: Column, cfg: RuleConfig = DEFAULT, known: Reading | None = None) -> Column:
    """Score of an application value against a label value with the deciding reason."""
    generic = list(cfg.generic_tokens)

    def contained(a, b):
        return F.forall(a, lambda t: F.array_contains(b, t))

    def misread(p):
        """Whether folding changes a text; where it does not, the tokens as they are have told already."""
        return (p["af"] != p["a"]) | (p["bf"] != p["b"])

    def reverse(p, suffix_partial, suffix_generic, reason):
        return (
            F.when(F.size(p["bt"]) < F.size(p["at"]),
                   _outcome(0.88, "reverse_containment_partial" + suffix_partial))
            .when((F.size(p["bt"]) == 1) & p["bt"][0].isin(generic),
                  _outcome(0.75, "reverse_containment_generic" + suffix_generic))
            .otherwise(_outcome(0.90, reason))
        )

    def closest(p):
        if known is None:
            return best_ratio((p["a"], p["b"]), (sort_words(p["a"]), sort_words(p["b"])))
        # sorting moves words only, so the lengths stay
        most = F.greatest(known.common["plain"], known.common["sorted"])
        return most * F.lit(2.0) / (F.length(p["a"]) + F.length(p["b"]))

    def fuzzy(p):
        def decide(worst):
            return F.when(
                worst * 100 >= cfg.fuzzy_token_pct,
                _outcome(F.greatest(F.lit(0.88), worst * 0.95), "fuzzy_token"),
            ).otherwise(_outcome(closest(p), "fuzzy_ratio"))

        worst = F.when(
            tokens_near(p["at"], p["bt"], cfg.fuzzy_token_pct),
            F.array_min(best_token_scores(p["at"], p["bt"], cfg.fuzzy_token_pct)),
        ).otherwise(F.lit(0.0))
        return let(worst, decide)

    def body(p):
        return (
            F.when((p["a"] == "") | (p["b"] == ""), _outcome(0.0, "empty"))
            .when(p["a"] == p["b"], _outcome(1.0, "exact"))
            .when(p["af"] == p["bf"], _outcome(1.0, "exact_ocr_normalized"))
            .when((F.size(p["at"]) == 0) | (F.size(p["bt"]) == 0),
                  _outcome(0.0, "empty_tokens"))
            .when(contained(p["at"], p["bt"]), _outcome(0.95, "token_containment"))
            .when(misread(p) & contained(p["ao"], p["bo"]),
                  _outcome(0.95, "token_containment_ocr_normalized"))
            .when(contained(p["bt"], p["at"]), reverse(p, "", "", "reverse_containment"))
            .when(misread(p) & contained(p["bo"], p["ao"]),
                  reverse(p, "_ocr", "_ocr", "reverse_containment_ocr_normalized"))
            .when(F.contains(p["b"], p["a"]) | F.contains(p["a"], p["b"]),
                  _outcome(0.92, "substring"))
            .otherwise(fuzzy(p))
        )

    def named(f):
        held = {"": "text", "f": "folded", "t": "tokens", "o": "folded_tokens"}
        return body({name + k: f[name][field] for name in "ab" for k, field in held.items()})

    a, b = (known.a, known.b) if known else (text_form(app), text_form(label))
    return let(F.struct(a.alias("a"), b.alias("b")), named)


def confusable(a: Column, b: Column, cfg: RuleConfig = DEFAULT) -> Column:
    """Whether two values differ only by characters OCR mixes up, or are close anyway."""
    both_ways = CONFUSABLE_PAIRS + [(y, x) for x, y in CONFUSABLE_PAIRS]
    single = [f"{x}{y}" for x, y in both_ways if len(x) == len(y) == 1]

    def body(p):
        a_, b_ = p["a"], p["b"]
        gap = F.abs(F.length(a_) - F.length(b_))
        one_swap = F.lit(False)
        for x, y in both_ways:
            one_swap = one_swap | (F.replace(a_, F.lit(x), F.lit(y)) == b_)
            one_swap = one_swap | (F.replace(b_, F.lit(x), F.lit(y)) == a_)
        n = F.least(F.length(a_), F.length(b_))
        places = F.filter(
            F.zip_with(chars(F.left(a_, n)), chars(F.left(b_, n)), lambda x, y: F.concat(x, y)),
            lambda xy: F.left(xy, F.lit(1)) != F.right(xy, F.lit(1)),
        )
        return (
            F.when(a_ == b_, F.lit(True))
            .when((gap <= 2) & one_swap, F.lit(True))
            .otherwise(
                let(
                    places,
                    lambda d: F.when(
                        (gap <= 2) & F.size(d).between(1, 2),
                        F.forall(d, lambda xy: xy.isin(single)),
                    ).otherwise((gap <= 3) & ratio_reaches(a_, b_, cfg.confusable_pct)),
                )
            )
        )

    bound = F.struct(F.lower(norm(a)).alias("a"), F.lower(norm(b)).alias("b"))
    return F.when(
        (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), F.lit(False)
    ).otherwise(let(bound, body))


def tokens_in_text(value: Column, text: Column) -> Column:
    """Whether every token occurs somewhere in the text."""
    def body(p):
        return (F.size(p["t"]) > 0) & F.forall(p["t"], lambda t: F.contains(p["x"], t))

    return let(F.struct(tokenize(value).alias("t"), F.lower(text).alias("x")), body)


def clean_words(text: Column) -> Column:
    """Distinct lower-case words of two or more characters, edges cleaned."""
    cleaned = F.transform(F.split(F.lower(norm(text)), " "), strip_edges)
    return F.array_distinct(F.filter(cleaned, lambda w: F.length(w) >= 2))


def tokens_in_words(
    value: Column, text_lower: Column, words: Column, cfg: RuleConfig = DEFAULT
) -> Column:
    """Whether every meaningful token is on the label, OCR distortions allowed.

    ``words`` are the ``clean_words`` of the text.
    """
    pct = cfg.text_token_pct

    def found(t):
        near = F.exists(
            words,
            lambda w: F.exists(
                F.array(
                    F.struct(t.alias("t"), w.alias("w")),
                    F.struct(ocr_fold(t).alias("t"), ocr_fold(w).alias("w")),
                ),
                lambda p: ratio_reaches(p["t"], p["w"], pct),
            ),
        )
        return (
            F.when(F.contains(text_lower, t), F.lit(True))
            .when(t == "&", F.contains(text_lower, F.lit("and")))
            .otherwise(near)
        )

    meaningful = F.filter(
        tokenize(value), lambda t: (F.length(t) > 1) | t.rlike(r"^[\p{L}\p{N}]$")
    )
    return let(meaningful, lambda ts: (F.size(ts) > 0) & F.forall(ts, found))
