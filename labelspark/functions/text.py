"""Text normalising expressions. All are built-in column functions."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce, wraps
from weakref import WeakKeyDictionary

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
#: The characters of ``SPACE`` in Unicode, for trimming without a pattern.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PUNCTUATION = """.,;:!?'"()"""
EDGE_PUNCTUATION = rf"""^[{PUNCTUATION}]+|[{PUNCTUATION}]+$"""


def built_once(fn):
    """Reuse the columns a builder returns for the same arguments.

    Building a large expression takes thousands of calls into the JVM; the columns
    do not change, so one copy per application serves all plans and goes with it.
    """
    built: WeakKeyDictionary = WeakKeyDictionary()

    @wraps(fn)
    def reuse(*args):
        session = SparkSession.getActiveSession()
        if session is None:
            return fn(*args)
        mine = built.setdefault(session.sparkContext, {})
        if args not in mine:
            mine[args] = fn(*args)
        return mine[args]

    return reuse


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it by name inside ``body``."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(text_or_empty(c), F.lit(SPACES))


def norm(c: Column) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(text_or_empty(c), rf"(?U){SPACE}+", " "))


def words(c: Column) -> Column:
    """Split on white space; an empty text has no words."""
    return F.filter(F.split(norm(c), " "), lambda w: w != "")


def strip_edges(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_PUNCTUATION, "")


def tokens_of(normed: Column) -> Column:
    """``tokenize`` for a text that is normal and lower-case already."""
    trimmed = F.transform(F.split(normed, " "), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    return F.filter(trimmed, lambda t: t != "")


def tokenize(c: Column) -> Column:
    """Lower-case words without punctuation at the edges."""
    return tokens_of(F.lower(norm(c)))


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def ocr_fold(c: Column) -> Column:
    """Read the digits OCR confuses with letters as letters (lower-case input)."""
    return F.translate(c, "1058", "iosb")


def ocr_text(c: Column) -> Column:
    return ocr_fold(F.lower(norm(c)))


def leading_one(c: Column) -> Column:
    return F.regexp_replace(c, r"[I\[](?=\d)", "1")


def ocr_digits(c: Column) -> Column:
    return F.translate(c, "OoIlSB", "001158")


def ocr_numeric(c: Column) -> Column:
    return ocr_digits(leading_one(norm(c)))


def numeric_sequences(c: Column) -> Column:
    """Apply the digit reading only inside runs that start with a digit."""
    pieces = F.regexp_extract_all(
        leading_one(c), F.lit(r"(?s)\d[\dOolISB8.]*|[^\d]+"), F.lit(0)
    )
    fixed = F.transform(
        pieces, lambda p: F.when(p.rlike(r"^\d"), ocr_digits(p)).otherwise(p)
    )
    return F.array_join(fixed, "")


def upper_words(c: Column) -> Column:
    return F.regexp_extract_all(F.upper(c), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def casing(c: Column) -> Column:
    """'upper', 'lower' or 'mixed': how most words of two or more letters look."""
    found = F.regexp_extract_all(c, F.lit(r"(?U)\b[A-Za-z]{2,}\b"), F.lit(0))
    return let(
        found,
        lambda ws: F.when(
            F.size(F.filter(ws, lambda w: w == F.upper(w))) * 2 > F.size(ws), F.lit("upper")
        )
        .when(F.size(F.filter(ws, lambda w: w == F.lower(w))) * 2 > F.size(ws), F.lit("lower"))
        .otherwise(F.lit("mixed")),
    )


def apply_casing(word: Column, style: Column) -> Column:
    return (
        F.when(style == "upper", F.upper(word))
        .when(style == "lower", F.lower(word))
        .otherwise(F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substr(word, F.lit(2)))))
    )


def best_word(word: Column, reference: list[str]) -> Column:
    """Nearest reference word of five or more letters within two edits, else null.

    Equal distances are settled alphabetically.
    """
    long_words = sorted({w for w in reference if len(w) >= 5})
    ref = F.array(*[F.lit(w) for w in long_words])
    up = F.upper(word)
    scored = F.transform(
        ref, lambda r: F.struct(F.levenshtein(up, r, 2).alias("d"), r.alias("w"))
    )
    nearest = F.array_min(F.filter(scored, lambda s: s["d"] >= 0))
    return F.when(F.length(word) >= 4, nearest["w"])


def correct_words(text: Column, reference: list[str]) -> Column:
    """Replace misread words by the nearest reference word, keeping the casing style."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?Us)\b\w+\b|\W+"), F.lit(0))
    known = sorted(set(reference))

    def fix(style):
        def one(p):
            replacement = best_word(p, reference)
            return (
                F.when(~p.rlike(r"(?U)^\w"), p)
                .when(F.upper(p).isin(known), p)
                .otherwise(F.coalesce(apply_casing(replacement, style), p))
            )
        return one

    return let(casing(text), lambda style: F.array_join(F.transform(pieces, fix(style)), ""))


def fix_hyphenation(text: Column) -> Column:
    def body(p):
        out = F.regexp_replace(
            p["t"], F.lit(r"(?i)pre[pg]-\s*nancy"), apply_casing(F.lit("pregnancy"), p["s"])
        )
        return F.regexp_replace(
            out, F.lit(r"(?i)machin-\s*ery"), apply_casing(F.lit("machinery"), p["s"])
        )

    return let(F.struct(text.alias("t"), casing(text).alias("s")), body)


def collapse_warning(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)(GOVERNMENT WARNING:|WARNING:)\s*WARNING:", "$1")


def drop_tokens(text: Column, tokens: Column) -> Column:
    """Remove the listed words wherever they stand alone; unchanged if none are listed."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?Us)\w+|\W+"), F.lit(0))
    listed = F.transform(tokens, lambda t: F.upper(t))
    kept = F.filter(pieces, lambda p: ~F.array_contains(listed, F.upper(p)))
    return F.when(
        F.size(tokens) > 0, collapse_warning(norm(F.array_join(kept, "")))
    ).otherwise(text)


def collapse_repeats(text: Column) -> Column:
    """Drop scan artefacts and adjacent repeats of phrases of one to five words."""
    out = F.regexp_replace(text, r"\|\s*", " ")
    out = F.regexp_replace(out, r"\}\s*", " ")
    out = F.regexp_replace(out, r"[—\-]{3,}", " ")

    def drop(c, n, flags):
        more = r"(?:\s++\w++){%d}" % (n - 1)
        return F.regexp_replace(c, rf"(?{flags})(\b\w++%s)\s++\1\b" % more, "$1")

    def one_round(c, flags):
        """A phrase of several words can repeat only where its first two words come again soon."""
        pair = rf"(?{flags})(\b\w++\s++\w++)(?:\s++\w++){{0,3}}?\s++\1\b"
        phrases = reduce(lambda out, n: drop(out, n, flags), (5, 4, 3, 2), c)
        return drop(F.when(c.rlike(pair), phrases).otherwise(c), 1, flags)

    def again(before, rounds, flags):
        """Another round only for texts the last one changed, three in all."""
        return let(
            one_round(before, flags),
            lambda after: F.when(
                (after == before) if rounds > 1 else F.lit(True), after
            ).otherwise(again(after, rounds - 1, flags) if rounds > 1 else after),
        )

    # in a text of ASCII alone the classes mean the same without Unicode, and are tested faster
    return norm(let(out, lambda t: F.when(F.octet_length(t) == F.length(t), again(t, 3, "i")).otherwise(again(t, 3, "iU"))))


# fixed values: repairs of the upper-cased statement, applied in this order
STATEMENT_REPAIRS = [
    (r"\bOM\s*$", " GENERAL"),
    (r"SURGEON\s+(?:OM|ANAL|GERAL)\b", "SURGEON GENERAL"),
    (r"\(1\s*\)", "(1)"),
    (r"\(2\s*\)", "(2)"),
    (r"PRE[GP]-\s*NANCY", "PREGNANCY"),
    (r"MACHIN-\s*ERY", "MACHINERY"),
    (r"HEALTHI?PROBLEMS", "HEALTH PROBLEMS"),
    (r"\|\s*\)", " "),
    (r"\d+\s*\]", " "),
]


def statement_norm(text: Column) -> Column:
    out = reduce(
        lambda c, repair: F.regexp_replace(c, "(?U)" + repair[0], repair[1]),
        STATEMENT_REPAIRS,
        F.upper(text),
    )
    out = norm(F.regexp_replace(norm(out), r",\s*", " "))
    return norm(F.regexp_replace(out, r"\s+[A-Z]{1,2}\s*$", ""))


def statement_norm_of(text: str) -> str:
    """What ``statement_norm`` gives for a configured wording."""
    out = text.upper()
    for pattern, repaired in STATEMENT_REPAIRS:
        out = re.sub(pattern, repaired, out)
    out = re.sub(r",\s*", " ", " ".join(out.split()))
    return re.sub(r"\s+[A-Z]{1,2}\s*$", "", " ".join(out.split())).strip()


def statement_position(text: Column, required: str) -> Column:
    """Index in the required text of the longest known start of ``text``."""
    ref = F.lit(" ".join(required.split()).upper())

    def body(t):
        tries = []
        for n in (60, 50, 40, 30, 20, 15, 10):
            chunk = F.trim(F.left(t, F.lit(n)))
            at = F.when(F.length(chunk) >= 5, F.nullif(F.instr(ref, chunk), F.lit(0)))
            # the longest try uses the whole text when it is shorter than 60
            tries.append(at if n == 60 else F.when(F.length(t) >= n, at))
        known = F.filter(
            F.split(t, " "), lambda w: (F.length(w) >= 4) & (F.instr(ref, w) > 0)
        )
        by_word = F.when(F.size(known) > 0, F.instr(ref, known[0]))
        return F.coalesce(*tries, by_word, F.lit(1_000_000)) - 1

    return let(F.upper(norm(text)), body)


def strip_nutrition(text: Column, markers: list[str], orphans: list[str]) -> Column:
    out = F.when(
        F.contains(text, F.lit("|")), strip(F.split_part(text, F.lit("|"), F.lit(1)))
    ).otherwise(text)
    for m in markers:
        pattern = m.replace(" ", r"\s+")
        out = F.regexp_replace(
            out, rf"(?i){pattern}(?:\s+[\d.]+\s*(?:Fl\s*Oz|ml|g)?)?\s*", " "
        )
    for w in orphans:
        out = F.regexp_replace(out, rf"(?i)\s+{w}\s*$", "")
    return strip(out)


def trim_overlap(text: Column, previous: Column) -> Column:
    """Cut the longest start (25 characters at most) that repeats the end of ``previous``."""
    def body(p):
        limit = F.least(F.lit(25), F.length(p["t"]), F.length(p["e"]))
        sizes = F.when(limit > 0, F.sequence(limit, F.lit(1), F.lit(-1)))
        hit = F.filter(
            sizes, lambda n: F.upper(F.left(p["t"], n)) == F.right(p["e"], n)
        )
        cut = F.when(F.size(hit) > 0, hit[0]).otherwise(0)
        return F.when(cut > 0, strip(F.substr(p["t"], cut + 1))).otherwise(p["t"])

    return let(F.struct(text.alias("t"), F.upper(previous).alias("e")), body)


def surgeon_general_case(text: Column) -> Column:
    return F.when(
        text.isin("", "(not found)"), text
    ).otherwise(F.regexp_replace(strip(text), r"(?iU)\bsurgeon\s+general\b", "Surgeon General"))


def unmatched_words(extracted: Column, required: Column) -> Column:
    """Words of ``extracted`` that the required text does not contain, in text order."""
    pattern = F.lit(r"(?U)\b[A-Za-z0-9]+\b")
    have = F.regexp_extract_all(text_or_empty(extracted), pattern, F.lit(0))
    need = F.regexp_extract_all(F.upper(text_or_empty(required)), pattern, F.lit(0))
    return let(need, lambda n: F.filter(have, lambda w: ~F.array_contains(n, F.upper(w))))


def snippet(text: Column, pattern: str, before: int, after: int) -> Column:
    """Text around the first match, trimmed and cut to 50 characters; null if no match."""
    def body(p):
        start = F.greatest(p["at"] - before, F.lit(1))
        stop = p["at"] + F.length(p["m"]) + after
        return let(
            strip(F.substr(p["t"], start, stop - start)),
            lambda s: F.when(F.length(s) > 50, F.concat(F.left(s, F.lit(50)), F.lit("...")))
            .otherwise(s),
        )

    hit = F.struct(
        text.alias("t"),
        F.regexp_instr(text, F.lit(pattern)).alias("at"),
        F.regexp_extract(text, pattern, 0).alias("m"),
    )
    return F.when(text.rlike(pattern), let(hit, body))


def word_counts(text: str) -> Counter:
    """Word multiset of a configured (constant) text."""
    return Counter(re.findall(r"\b\w+\b", text.upper()))
