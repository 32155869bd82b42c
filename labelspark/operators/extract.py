"""Blocks to the eight fields of a label.

Per-block tests run first, as flat built-in expressions over the block table.
One aggregation by label then gathers the tested blocks in reading order, and
the walks over neighbours work on that array inside the row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark import config as C
from labelspark.config import DEFAULT, RuleConfig
from labelspark.functions import geometry as G
from labelspark.functions import text as X
from labelspark.functions.numbers import plausible_abv
from labelspark.functions.similarity import brand_similarity
from labelspark.functions.text import built_once, let, strip

FIELD = "struct<value:string,bbox:array<int>>"


def any_of(values: list[str], whole_word: bool = False) -> str:
    """Alternation for the leftmost, longest value, ignoring case."""
    body = "|".join(sorted(values, key=len, reverse=True))
    return rf"(?iU)\b(?:{body})\b" if whole_word else f"(?i)(?:{body})"


def occurs_pattern(values: list[str], whole_word: bool = False) -> str:
    """Pattern that only tells whether a value occurs, for upper-cased text.

    Values that contain another value cannot change the answer and are left out.
    """
    upper = sorted({v.upper() for v in values})

    def within(short, long):
        return f" {short} " in f" {long} " if whole_word else short in long

    by_letter: dict[str, list[str]] = {}
    for v in upper:
        if not any(o != v and within(o, v) for o in upper):
            by_letter.setdefault(v[0], []).append(v[1:])
    # one branch per first letter keeps the scan short, and places where no value can start
    # are left at a glance
    glance = "".join("[%s]" % "".join(sorted({v[i] for v in upper})) for i in range(min(map(len, upper))))
    body = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items())
    return rf"(?U)(?={glance})\b(?:{body})\b" if whole_word else f"(?={glance})(?:{body})"


CLASS_NAME = any_of(C.CLASS_KEYWORDS, whole_word=True)
CLASS_ANYWHERE = occurs_pattern(C.CLASS_KEYWORDS)
CLASS_WORD = occurs_pattern(C.CLASS_KEYWORDS, whole_word=True)
COUNTRY_ANYWHERE = occurs_pattern(C.KNOWN_COUNTRIES)
SUFFIXES = C.BRAND_SUFFIXES + C.CORPORATE_SUFFIXES + C.OTHER_SUFFIXES
SUFFIX_WORD = r"(?U)(?:^|\s)(%s)(?=\s|$)" % "|".join(sorted(SUFFIXES, key=len, reverse=True))


def field(value: Column, box: Column) -> Column:
    return F.struct(value.alias("value"), box.alias("bbox")).cast(FIELD)


def no_field() -> Column:
    return field(F.lit(""), F.lit(None))


# --- tests on one block -------------------------------------------------------

# What a text must hold for a pattern to match at all. Most blocks are settled by that; only
# the others meet the pattern, whose answer counts.


def holds(c: Column, *values: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(v)) for v in values])


def holds_any(c: Column, values: list[str]) -> Column:
    """Whether one of the values, upper case, stands anywhere in upper-cased text."""
    upper = sorted({v.upper() for v in values}, key=len)
    return holds(c, *[v for i, v in enumerate(upper) if not any(o in v for o in upper[:i])])


def has_digit(t: Column) -> Column:
    return t.rlike("[0-9]")


def has_abv(t: Column) -> Column:
    return F.contains(t, F.lit("%")) & t.rlike(C.ABV_QUALIFIED)


def has_net_contents(t: Column) -> Column:
    return has_digit(t) & t.rlike(C.NET_CONTENTS)


def has_bottler_header(t: Column, up: Column) -> Column:
    return F.contains(up, F.lit("BY")) & t.rlike(C.BOTTLER_HEADER)


def may_name_country(up: Column) -> Column:
    return holds(up, "PRODUC", "WINE", "VINO", "MADE", "IMPORTED", "ORIGIN")


def is_junk(t: Column, up: Column) -> Column:
    """OCR noise or text that cannot be a brand (stripped text)."""
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    return (
        (F.length(t) <= 1)
        | (letters < F.length(t) * 0.4)
        | t.rlike(C.HEADER_ONLY)
        | (F.contains(up, F.lit("LABEL")) & t.rlike(C.PANEL_MARKER))
        | up.isin(C.WARNING_WORDS + C.STOP_WORDS)
    )


def abv_qualified(t: Column) -> Column:
    """Alcohol figure with its unit, strict form first; '' if absent."""
    return F.coalesce(
        F.nullif(F.regexp_extract(t, C.ABV_STRICT, 1), F.lit("")),
        F.regexp_extract(t, C.ABV_QUALIFIED, 1),
    )


def is_stop_content(t: Column, up: Column, class_any: Column, net_any: Column) -> Column:
    """Text that cannot continue a class designation (stripped, and upper-cased)."""
    return (
        has_abv(t)
        | has_bottler_header(t, up)
        | F.contains(up, F.lit("IMPORTED BY"))
        | net_any
        | (may_name_country(up) & t.rlike(C.COUNTRY_PHRASE))
        | F.startswith(up, F.lit("CONTAINS"))
        | (F.contains(t, F.lit(",")) & t.rlike(C.CITY_STATE) & ~class_any)
        | (F.contains(up, F.lit("LABEL")) & t.rlike(C.PANEL_MARKER))
    )


def is_class_anchor(t: Column, class_word: Column, stop: Column) -> Column:
    """A class keyword, not stop content, and more than a weak word or two."""
    found = F.array_distinct(X.upper_words(t))
    strong = F.arrays_overlap(found, F.array(*[F.lit(w) for w in C.STRONG_CLASS_WORDS]))
    return F.when(
        class_word & ~stop, strong | (F.size(found) > 3)
    ).otherwise(F.lit(False))


def is_serving_only(up: Column) -> Column:
    return has_serving_marker(up) & ~has_warning_keyword(up)


def has_serving_marker(up: Column) -> Column:
    return holds_any(up, C.SERVING_MARKERS)


def has_serving_trace(up: Column) -> Column:
    return F.contains(up, F.lit("|")) | holds_any(up, C.SERVING_MARKERS + C.ORPHAN_SERVING_WORDS)


def has_warning_keyword(up: Column) -> Column:
    return holds_any(up, C.WARNING_KEYWORDS)


def opens_warning(up: Column) -> Column:
    return F.contains(up, F.lit("GOVERNMENT")) & F.contains(up, F.lit("WARNING"))


def leaves_warning(t: Column, up: Column, net_any: Column) -> Column:
    """Panel marker, CONTAINS line, or a quantity outside the statement heading."""
    return (
        t.isin(C.PANEL_MARKERS)
        | F.startswith(up, F.lit("CONTAINS"))
        | (
            ~F.contains(up, F.lit("GOVERNMENT"))
            & (net_any | has_abv(t))
        )
    )


def suffix_candidate(t: Column, up: Column) -> Column:
    """Brand read off a company suffix: text, '' to take the block before, or null."""
    def body(p):
        at = F.instr(p["u"], p["w"])
        before = strip(F.left(p["u"], at - 1))
        return (
            F.when(p["w"] == "", F.lit(None).cast("string"))
            .when(p["w"].isin(C.BRAND_SUFFIXES),
                  strip(F.left(p["t"], at - 1 + F.length(p["w"]))))
            .when(F.length(before) >= 2, before)
            .otherwise(F.lit(""))
        )

    read = let(
        F.struct(t.alias("t"), up.alias("u"), F.regexp_extract(up, SUFFIX_WORD, 1).alias("w")),
        body,
    )
    return F.when(holds_any(up, SUFFIXES), read)


def country_value(t: Column) -> Column:
    """Country named by an origin phrase; '' when there is no phrase."""
    groups = [
        F.nullif(F.regexp_extract(t, C.COUNTRY_PHRASE, g), F.lit("")) for g in (1, 2, 3, 4)
    ]
    return strip(F.coalesce(*groups, F.lit("")))


def net_value(t: Column) -> Column:
    """First quantity with its unit in canonical form; '' when there is none."""
    fixed = X.leading_one(t)
    number = F.regexp_extract(fixed, C.NET_CONTENTS, 1)
    unit = F.lower(F.regexp_replace(F.regexp_extract(fixed, C.NET_CONTENTS, 2), r"\.+$", ""))
    canonical = (
        F.when(unit.isin("l", "litre", "liter"), "L")
        .when(unit.rlike("fl"), "fl oz")
        .when(unit.isin("qt", "quart"), "qt")
        .when(unit.isin("pt", "pint"), "pt")
        .when(unit.isin("gal", "gallon"), "gal")
        .otherwise("mL")
    )
    return F.when(number == "", F.lit("")).otherwise(F.concat_ws(" ", number, canonical))


@built_once
def block_stages(cfg: RuleConfig) -> list[dict[str, Column]]:
    """Per-block tests; every stage uses only columns of the stages before it."""
    t, up = F.col("t"), F.col("up")
    loose = F.regexp_extract_all(F.col("text"), F.lit(C.ABV_LOOSE), F.lit(1))
    return [
        {"text": F.coalesce("text", F.lit(""))},
        {"t": strip(F.col("text"))},
        {"up": F.upper("t")},
        {
            "class_any": up.rlike(CLASS_ANYWHERE),
            "digit": has_digit(t),
            "keyword": has_warning_keyword(up),
            "net_any": has_net_contents(t),
        },
        {
            "junk": is_junk(t, up),
            "stop": is_stop_content(t, up, F.col("class_any"), F.col("net_any")),
            "class_word": F.col("class_any") & up.rlike(CLASS_WORD),
            "adjective": up.isin(C.CLASS_ADJECTIVES),
            "suffix": suffix_candidate(t, up),
            "abv": F.when(F.contains(t, F.lit("%")), abv_qualified(t)).otherwise(""),
            "abv_any": F.when(F.contains(F.col("text"), F.lit("%")), F.get(loose, F.lit(0))),
            "abv_loose": F.when(
                F.contains(F.col("text"), F.lit("%")), F.get(F.filter(loose, plausible_abv), F.lit(0))
            ),
            "proof_no": F.when(
                F.contains(up, F.lit("PROOF")), F.regexp_extract(t, C.PROOF, 1)
            ).otherwise(""),
            "net": F.when(F.col("digit"), net_value(t)).otherwise(""),
            "country": F.when(may_name_country(up), country_value(t)).otherwise(""),
            "country_name": (F.length("t") < 40) & up.rlike(COUNTRY_ANYWHERE),
            "bottler_header": has_bottler_header(t, up),
            "opens": opens_warning(up),
            "leaves": leaves_warning(t, up, F.col("net_any")),
        },
        {
            "anchor": is_class_anchor(t, F.col("class_word"), F.col("stop")),
            "abv_score": F.when(plausible_abv(F.col("abv")), 2).otherwise(1)
            + F.when(holds(up, "ALC", "VOL", "PROOF"), 2).otherwise(0),
            "bottler_end": holds(up, "GOVERNMENT", "WARNING")
            | (F.contains(t, F.lit("%")) & t.rlike(r"^\d+\s*%"))
            | (F.col("net_any") & t.rlike("(?i)^" + C.NET_CONTENTS.removeprefix("(?i)")))
            | (F.col("country") != "")
            | F.startswith("up", F.lit("CONTAINS")),
            "in_warning": (F.length("t") >= 2) & ~F.col("leaves") & F.col("keyword"),
        },
        {
            "warning_pos": F.when(
                F.col("in_warning"), X.statement_position(t, cfg.required_statement)
            ),
            "warning_text": F.when(
                F.col("in_warning") & has_serving_trace(up),
                X.strip_nutrition(t, C.SERVING_MARKERS, C.ORPHAN_SERVING_WORDS),
            ).when(F.col("in_warning"), t),
        },
    ]


def block_tests(blocks: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Evaluate every per-block test once."""
    return reduce(DataFrame.withColumns, block_stages(cfg), blocks)


# --- walks over the ordered blocks of one label --------------------------------

TESTED = [
    "text", "t", "up", "junk", "stop", "class_any", "class_word", "anchor", "adjective",
    "suffix", "abv", "abv_score", "abv_any", "abv_loose", "proof_no", "net", "country",
    "country_name", "bottler_header", "bottler_end", "opens", "leaves", "in_warning",
    "warning_pos", "warning_text",
]

#: What each field reads of the tested blocks besides their boxes and text; ``combined_stripped`` reads t.
READS = {
    "brand_name": ["t", "junk", "class_any", "suffix"],
    "class_type": ["t", "stop", "class_word", "anchor", "adjective"],
    "alcohol_pct": ["abv", "abv_score", "abv_any", "abv_loose"],
    "proof": ["proof_no"],
    "net_contents": ["net"],
    "government_warning": ["up", "opens", "in_warning", "warning_pos", "warning_text"],
    "bottler": ["t", "up", "junk", "bottler_header", "bottler_end", "opens"],
    "country_of_origin": ["t", "country", "country_name"],
}
#: The same without a required wording.
READS_BY_ANCHOR = {**READS, "government_warning": ["t", "up", "class_any", "opens", "leaves"]}


def in_reading_order(tested: DataFrame, reads: list[str] = TESTED) -> DataFrame:
    """One row per label: ``bs`` sorted by (y1, x1, block_id) and the full text.

    The blocks are gathered with the columns ``reads``; equal places are settled by the text, which
    all tests are made of, so the order is the same whatever is read.
    """
    item = F.struct("y1", "x1", "block_id", "x2", "y2", "text", *[c for c in TESTED[1:] if c in reads])
    gathered = tested.groupBy("label_id").agg(F.array_sort(F.collect_list(item)).alias("bs"))
    in_input_order = F.array_sort(
        F.transform("bs", lambda b: F.struct(b["block_id"].alias("n"), b["text"].alias("s")))
    )
    return gathered.select(
        "label_id",
        "bs",
        F.array_join(F.transform(in_input_order, lambda b: b["s"]), " ").alias("all_text"),
        F.array_join(F.transform("bs", lambda b: b["text"]), " ").alias("combined"),
        *[F.array_join(F.transform("bs", lambda b: b["t"]), " ").alias("combined_stripped") for c in reads if c == "t"],
    )


def first_where(blocks: Column, test) -> Column:
    """First block passing the test, or null."""
    return F.get(F.filter(blocks, test), F.lit(0))


def first_index(blocks: Column, test) -> Column:
    """1-based index of the first block passing the test, 0 if none."""
    return F.array_position(F.transform(blocks, test), True).cast("int")


def leading(blocks: Column, test) -> Column:
    """Blocks from the start up to the first that fails the test."""
    return let(
        first_index(blocks, lambda b: ~test(b)),
        lambda at: F.when(at == 0, blocks).otherwise(F.slice(blocks, 1, F.greatest(at - 1, F.lit(0)))),
    )


def box_where(blocks: Column, test) -> Column:
    return let(first_where(blocks, test), lambda b: F.when(b.isNotNull(), G.bbox(b)))


def brand_candidates(bs: Column) -> Column:
    """Suffix-based candidates in reading order."""
    def one(b, i):
        prev = F.when(i > 0, F.get(bs, i - 1))
        return (
            F.when(b["suffix"] != "", F.struct(b["suffix"].alias("value"), G.bbox(b).alias("bbox")))
            .when(
                (b["suffix"] == "") & prev.isNotNull() & ~prev["junk"],
                F.struct(prev["t"].alias("value"), G.bbox(prev).alias("bbox")),
            )
        )

    return F.filter(F.transform(bs, one), lambda c: c.isNotNull())


def prominent_brand(bs: Column) -> Column:
    """Tallest-and-longest plain text of the upper half."""
    def body(max_y):
        upper = F.filter(bs, lambda b: G.y_center(b) < max_y * 0.55)
        half = F.slice(bs, 1, F.greatest(F.lit(1), F.floor(F.size(bs) / 2).cast("int")))
        pool = F.when(F.size(upper) > 0, upper).otherwise(half)
        plain = F.filter(pool, lambda b: ~b["junk"] & ~b["class_any"] & ~b["t"].rlike(r"^\d"))
        scored = F.transform(
            plain,
            lambda b, i: F.struct(
                (-G.height(b) * F.length(b["t"])).alias("score"),
                i.alias("i"),
                b["t"].alias("value"),
                G.bbox(b).alias("bbox"),
            ),
        )
        return let(
            F.array_min(scored),
            lambda s: F.when(s.isNotNull(), field(s["value"], s["bbox"])).otherwise(no_field()),
        )

    return let(F.array_max(F.transform(bs, lambda b: b["y2"])), body)


def pick_brand(candidates: Column, prominent: Column, app_brand: Column) -> Column:
    """Candidate closest to the application brand; the first one without an application."""
    ranked = F.transform(
        candidates,
        lambda c, i: F.struct(
            F.when(app_brand == "", 0.0)
            .otherwise(-brand_similarity(c["value"], app_brand))
            .alias("score"),
            i.alias("i"),
            c.alias("c"),
        ),
    )
    best = F.when(F.size(candidates) == 1, F.get(candidates, F.lit(0))).otherwise(
        F.array_min(ranked)["c"]
    )
    return F.when(
        F.size(candidates) > 0, let(best, lambda c: field(c["value"], c["bbox"]))
    ).otherwise(prominent)


def class_type(bs: Column, combined: Column) -> Column:
    def around(at):
        anchor = F.get(bs, at - 1)

        def joins(b):
            near = G.y_distance(b, anchor) <= G.height(anchor) * 3
            return near & ~b["stop"] & (b["class_word"] | b["adjective"])

        start = F.greatest(F.lit(1), at - 3)
        before = leading(F.reverse(F.slice(bs, start, at - start)), joins)
        after = leading(F.slice(bs, at + 1, F.lit(3)), joins)
        taken = F.concat(F.reverse(before), F.array(anchor), after)
        return let(
            taken,
            lambda bl: field(
                F.array_join(F.transform(bl, lambda b: b["t"]), " "), G.union_bbox(bl)
            ),
        )

    fallback = field(strip(F.regexp_extract(combined, CLASS_NAME, 0)), F.lit(None))
    return let(
        first_index(bs, lambda b: b["anchor"]),
        lambda at: F.when(at > 0, around(at)).otherwise(fallback),
    )


def alcohol_pct(bs: Column, combined: Column) -> Column:
    scored = F.transform(
        F.filter(bs, lambda b: b["abv"] != ""),
        lambda b, i: F.struct(
            (-b["abv_score"]).alias("score"), i.alias("i"),
            b["abv"].alias("value"), G.bbox(b).alias("bbox"),
        ),
    )

    def split_over_blocks(pct):
        return field(
            pct,
            box_where(bs, lambda b: F.contains(b["text"], pct) | F.contains(b["text"], F.lit("%"))),
        )

    def loose():
        plausible = first_where(bs, lambda b: b["abv_loose"].isNotNull())
        anything = first_where(bs, lambda b: b["abv_any"].isNotNull())
        return let(
            F.struct(plausible.alias("p"), anything.alias("a")),
            lambda s: F.when(s["p"].isNotNull(), field(s["p"]["abv_loose"], G.bbox(s["p"])))
            .when(s["a"].isNotNull(), field(s["a"]["abv_any"], G.bbox(s["a"])))
            .otherwise(no_field()),
        )

    joined = let(
        abv_qualified(combined),
        lambda pct: F.when(pct != "", split_over_blocks(pct)).otherwise(loose()),
    )
    return let(
        F.array_min(scored),
        lambda s: F.when(s.isNotNull(), field(s["value"], s["bbox"])).otherwise(joined),
    )


def proof(bs: Column, combined: Column) -> Column:
    return let(
        first_where(bs, lambda b: b["proof_no"] != ""),
        lambda b: F.when(b.isNotNull(), field(b["proof_no"], G.bbox(b))).otherwise(
            field(F.regexp_extract(combined, C.PROOF, 1), F.lit(None))
        ),
    )


def net_contents(bs: Column, combined: Column) -> Column:
    fixed = X.leading_one(combined)
    pints = F.regexp_extract(fixed, C.NET_COMPOUND, 1)
    ounces = F.regexp_extract(fixed, C.NET_COMPOUND, 3)
    total = pints.try_cast("bigint") * 16 + ounces.try_cast("bigint")
    compound = field(
        F.concat_ws(" ", total.cast("string"), F.lit("fl oz")),
        box_where(bs, lambda b: holds(F.upper(b["text"]), "PINT", "FL")),
    )

    def split_over_blocks(value):
        number = F.split_part(value, F.lit(" "), F.lit(1))
        box = box_where(
            bs,
            lambda b: F.contains(b["text"], number) | holds(F.lower(b["text"]), "ml", "oz", "qt"),
        )
        return F.when(value == "", no_field()).otherwise(field(value, box))

    single = let(
        first_where(bs, lambda b: b["net"] != ""),
        lambda b: F.when(b.isNotNull(), field(b["net"], G.bbox(b))).otherwise(
            let(net_value(combined), split_over_blocks)
        ),
    )
    return F.when(pints != "", compound).otherwise(single)


def warning_by_reference(bs: Column) -> Column:
    """Statement rebuilt in the order of the required wording."""
    def in_column(anchor):
        return F.filter(
            bs,
            lambda b: b["in_warning"]
            & (
                anchor.isNull()
                | G.x_center(b).between(anchor["x1"] - 30, anchor["x2"] + 50)
            ),
        )

    def in_order(blocks):
        return F.transform(
            F.array_sort(
                F.transform(
                    blocks,
                    lambda b, i: F.struct(
                        b["warning_pos"].alias("pos"), G.y_center(b).alias("y"),
                        i.alias("i"), b.alias("b"),
                    ),
                )
            ),
            lambda s: s["b"],
        )

    def extend(parts, b):
        last = F.element_at(parts, -1)
        rest = F.when(F.size(parts) > 0, X.trim_overlap(b["warning_text"], last)).otherwise(
            b["warning_text"]
        )

        def add(t):
            repeated_header = (
                (F.size(parts) > 0) & (F.length(t) < 55) & opens_warning(F.upper(t))
            )
            return F.when((t == "") | repeated_header, parts).otherwise(F.array_append(parts, t))

        return let(rest, add)

    def build(ordered):
        parts = F.aggregate(ordered, F.array().cast("array<string>"), extend)
        value = X.collapse_repeats(F.array_join(parts, " "))
        named = F.exists(
            ordered,
            lambda b: F.contains(b["up"], F.lit("ALCOHOLIC"))
            & F.contains(b["up"], F.lit("BEVERAGES")),
        )
        value = F.when(
            named,
            F.regexp_replace(
                value, r"(?i)(Consumption of)\s+(impairs)", "$1 alcoholic beverages $2"
            ),
        ).otherwise(value)
        return field(value, G.union_bbox(ordered))

    return let(
        first_where(bs, lambda b: b["opens"]),
        lambda anchor: let(
            in_column(anchor),
            lambda found: F.when(F.size(found) > 0, let(in_order(found), build)).otherwise(
                no_field()
            ),
        ),
    )


def warning_by_anchor(bs: Column) -> Column:
    """Statement read downward from its heading (no required wording configured)."""
    def opens_at(b, i):
        following = F.get(bs, i + 1)["up"]
        return b["opens"] | (
            F.contains(b["up"], F.lit("GOVERNMENT"))
            & F.coalesce(F.contains(following, F.lit("WARNING")), F.lit(False))
        )

    at = F.array_position(F.transform(bs, opens_at), True).cast("int")

    def walk(start):
        anchor = F.get(bs, start - 1)
        margin = F.greatest((anchor["x2"] - anchor["x1"]) * F.lit(0.3), F.lit(30.0))
        gap = G.height(anchor) * 3

        def step(acc, i):
            b = F.get(bs, i - 1)
            off_column = (b["x1"] > anchor["x2"] + margin) | (b["x2"] < anchor["x1"] - margin)
            other_class = b["class_any"] & ~holds(b["up"], "ALCOHOLIC", "BEVERAGES", "HEALTH", "PROBLEMS")
            ends = (
                ((b["y1"] > acc["last_y"] + gap) & (F.size(acc["taken"]) > 0))
                | b["leaves"]
                | has_serving_marker(b["up"])
                | other_class
            )
            again = (
                (F.size(acc["taken"]) > 0)
                & b["opens"]
                & b["up"].rlike(r"^GOVERNMENT WARNING|^[^a-z]*GOVERNMENT\s+WARNING")
                & (F.length(b["t"]) < 55)
            )
            skip = again | ((F.length(b["t"]) < 2) & ~b["t"].rlike(r"^\d$"))
            taken = F.struct(
                F.lit(True).alias("open"),
                F.greatest(acc["last_y"], b["y2"]).alias("last_y"),
                F.array_append(acc["taken"], i).alias("taken"),
            )
            closed = F.struct(
                F.lit(False).alias("open"), acc["last_y"].alias("last_y"),
                acc["taken"].alias("taken"),
            )
            return (
                F.when(~acc["open"] | off_column, acc)
                .when(ends, closed)
                .when(skip, acc)
                .otherwise(taken)
            )

        init = F.struct(
            F.lit(True).alias("open"), anchor["y2"].alias("last_y"),
            F.array().cast("array<int>").alias("taken"),
        )
        taken = F.aggregate(F.sequence(start, F.size(bs)), init, step)["taken"]
        return let(
            F.transform(taken, lambda i: F.get(bs, i - 1)),
            lambda bl: field(
                X.collapse_repeats(F.array_join(F.transform(bl, lambda b: b["t"]), " ")),
                G.union_bbox(bl),
            ),
        )

    return let(at, lambda start: F.when(start > 0, walk(start)).otherwise(no_field()))


def bottler(bs: Column, combined: Column) -> Column:
    def from_header(at):
        header = F.get(bs, at - 1)

        def short_noise(b):
            return b["junk"] & (F.length(b["t"]) < 3)

        def continues(b):
            near = G.y_distance(b, header) <= G.height(header) * 5
            return near & (short_noise(b) | ~b["bottler_end"])

        more = F.filter(
            leading(F.slice(bs, at + 1, F.lit(8)), continues), lambda b: ~short_noise(b)
        )
        return let(
            F.concat(F.array(header), more),
            lambda bl: field(
                F.array_join(F.transform(bl, lambda b: b["t"]), " "), G.union_bbox(bl)
            ),
        )

    parts = [strip(F.regexp_extract(combined, C.BOTTLER_ADDRESS, g)) for g in (1, 2, 3)]

    def from_address(p):
        first_word = F.get(F.split(X.norm(p["name"]), " "), F.lit(0))
        return field(
            F.concat_ws(", ", p["name"], p["city"], p["state"]),
            box_where(bs, lambda b: F.contains(b["text"], first_word)),
        )

    def from_seal():
        seal = first_where(
            bs,
            lambda b: holds(b["up"], "DSP", "DISTILLERY") & ~b["opens"] & (F.length(b["t"]) >= 4),
        )
        return let(
            seal, lambda b: F.when(b.isNotNull(), field(b["t"], G.bbox(b))).otherwise(no_field())
        )

    address = F.struct(parts[0].alias("name"), parts[1].alias("city"), parts[2].alias("state"))
    without_header = F.when(combined.rlike(C.BOTTLER_ADDRESS), let(address, from_address)).otherwise(
        from_seal()
    )
    return let(
        first_index(bs, lambda b: b["bottler_header"]),
        lambda at: F.when(at > 0, from_header(at)).otherwise(without_header),
    )


def country_of_origin(bs: Column) -> Column:
    phrase = first_where(bs, lambda b: b["country"] != "")
    named = first_where(bs, lambda b: b["country_name"])
    return let(
        F.struct(phrase.alias("p"), named.alias("n")),
        lambda s: F.when(s["p"].isNotNull(), field(s["p"]["country"], G.bbox(s["p"])))
        .when(s["n"].isNotNull(), field(s["n"]["t"], G.bbox(s["n"])))
        .otherwise(no_field()),
    )


#: Columns that a field is extracted to, where not one of its name.
PARTS = {"brand_name": ["brand_candidates", "brand_prominent"]}


@built_once
def field_columns(by_reference: bool) -> dict[str, Column]:
    bs, combined = F.col("bs"), F.col("combined")
    return {
        "brand_candidates": brand_candidates(bs),
        "brand_prominent": prominent_brand(bs),
        "class_type": class_type(bs, combined),
        "alcohol_pct": alcohol_pct(bs, combined),
        "proof": proof(bs, combined),
        "net_contents": net_contents(bs, combined),
        "government_warning": warning_by_reference(bs) if by_reference else warning_by_anchor(bs),
        "bottler": bottler(bs, F.col("combined_stripped")),
        "country_of_origin": country_of_origin(bs),
    }


def extract_fields(
    blocks: DataFrame, cfg: RuleConfig = DEFAULT, fields: Sequence[str] = tuple(READS)
) -> DataFrame:
    """Block table to one row per label. The brand stays open until the application is
    known: ``brand_candidates`` and ``brand_prominent`` go into :func:`pick_brand`.

    Of the ``fields`` asked for, all unless named; blocks travel with the tests these read. Spark drops
    unused columns by itself, but not the parts of a struct that is gathered in an array.
    """
    by_reference = bool(cfg.required_statement.strip())
    needs = READS if by_reference else READS_BY_ANCHOR
    labels = in_reading_order(block_tests(blocks, cfg), sorted({c for f in fields for c in needs[f]}))
    wanted = [c for f in READS if f in fields for c in PARTS.get(f, [f])]
    made = field_columns(by_reference)
    return labels.select("label_id", "all_text", *[made[c].alias(c) for c in wanted])


def with_brand(labels: DataFrame, app_brand: Column | None = None) -> DataFrame:
    """Settle ``brand_name``, given the application brand where there is one."""
    wanted = F.lit("") if app_brand is None else F.coalesce(app_brand, F.lit(""))
    return labels.withColumn(
        "brand_name",
        pick_brand(F.col("brand_candidates"), F.col("brand_prominent"), wanted),
    ).drop("brand_candidates", "brand_prominent")
