"""Views of checked labels: result matrix, field coverage, totals, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.config import DEFAULT, MATRIX_CRITERIA, RuleConfig
from labelspark.functions import text as X
from labelspark.functions.text import let, strip, strip_edges
from labelspark.operators.rules import SPIRITS, beverage_key

WORDING = "Government Warning Wording"
NUMERIC = r"^\d+(?:\.\d+)?%?\s*$"
FIELD_TITLES = {
    "brand_name": "Brand name", "class_type": "Class / type", "alcohol_pct": "ABV %",
    "proof": "Proof", "net_contents": "Net contents", "bottler": "Bottler",
    "government_warning": "Gov. warning", "country_of_origin": "Country of origin",
}


def filter_status(report: DataFrame, status: str = "All") -> DataFrame:
    return report if status == "All" else report.filter(F.col("overall_status") == status)


def batch_totals(report: DataFrame) -> DataFrame:
    """Labels and failed rules per status."""
    return report.groupBy("overall_status").agg(
        F.count("*").alias("labels"), F.sum("fail_count").alias("failed_rules")
    )


# --- result matrix ------------------------------------------------------------------


def display_value(result: Column, criterion: Column, cfg: RuleConfig = DEFAULT) -> Column:
    """Struct (application, label) as the matrix shows a result."""
    app = F.coalesce(result["app_value"], F.lit(""))
    seen = F.coalesce(result["extracted_value"], F.lit(""))

    def tokens(c):
        cleaned = F.transform(X.words(F.lower(c)), strip_edges)
        return F.filter(cleaned, lambda t: t != "")

    def body(p):
        a, e = p["app"], p["seen"]
        low = F.lower(e)
        part = F.contains(low, F.lower(strip(a))) | let(
            tokens(a),
            lambda ts: (F.size(ts) > 0) & F.forall(ts, lambda t: F.contains(low, t)),
        )
        both_numeric = strip(a).rlike(NUMERIC) & strip(e).rlike(NUMERIC)
        generic = let(
            tokens(e),
            lambda ts: (F.size(ts) == 1) & F.coalesce(
                F.get(ts, F.lit(0)).isin(*cfg.generic_tokens), F.lit(False)
            ),
        )
        warning = F.contains(F.lower(criterion), F.lit("government warning"))
        swap = (
            ~warning & (a != "")
            & (
                (~both_numeric & (e != "") & (F.length(e) > F.length(a)) & part)
                | (generic & (F.length(a) > F.length(e)))
            )
        )
        return F.struct(a.alias("app"), F.when(swap, a).otherwise(e).alias("seen"))

    def cut(c):
        return F.when(
            (criterion != WORDING) & (F.length(c) > 80), F.concat(F.left(c, F.lit(77)), F.lit("..."))
        ).otherwise(c)

    def dash(c):
        return F.when(c == "", F.lit("—")).otherwise(c)

    preferred = F.when(result["prefer_app_display"] & (app != ""), app).otherwise(seen)
    return let(
        let(F.struct(app.alias("app"), preferred.alias("seen")), body),
        lambda p: F.struct(
            dash(cut(p["app"])).alias("application"), dash(cut(p["seen"])).alias("label")
        ),
    )


def result_matrix(checked: DataFrame, *keys: str) -> DataFrame:
    """Up to 19 ordered rows per label, straight from its ``results`` array.

    Every criterion takes the first of its rule ids that is present; the last of
    several results with one rule id counts.
    """
    keys = keys or ("label_id",)
    bev = beverage_key(F.col("beverage_type"))

    def pick(ids):
        found = F.filter("results", lambda r: r["rule_id"].isin(*ids))
        ranked = F.transform(
            found,
            lambda r, i: F.struct(
                F.array_position(F.array(*[F.lit(x) for x in ids]), r["rule_id"]).alias("prio"),
                (-i).alias("last"), r.alias("r"),
            ),
        )
        return F.array_min(ranked)["r"]

    rows = []
    for pos, (criterion, ids) in enumerate(MATRIX_CRITERIA, 1):
        chosen = pick(ids)
        if criterion == "Country of Origin":
            chosen = F.when(F.col("imported"), chosen)
        if criterion == "Proof":
            chosen = F.when(bev.isin(*SPIRITS), chosen)
        rows.append(
            F.struct(F.lit(pos).alias("pos"), F.lit(criterion).alias("criterion"),
                     chosen.alias("r"))
        )
    matrix = checked.select(
        *keys, F.explode(F.filter(F.array(*rows), lambda x: x["r"].isNotNull())).alias("x")
    )
    status = F.col("x.r.status")
    shown = display_value(F.col("x.r"), F.col("x.criterion"))
    return matrix.select(
        *keys, "x.pos", "x.criterion", shown.alias("shown"),
        F.when(status == "pass", "Pass").when(status == "fail", "Fail")
        .otherwise("Needs review").alias("status"),
        F.col("x.r.bbox_ref").alias("bbox_ref"),
        F.when(
            F.col("x.criterion") == WORDING,
            X.unmatched_words(F.col("x.r.extracted_value"), F.col("x.r.app_value")),
        ).alias("unmatched_words"),
    ).select(
        *keys, "pos", "criterion", "shown.application", "shown.label", "status",
        "bbox_ref", "unmatched_words",
    )


# --- field tables ---------------------------------------------------------------------


def field_table(labels: DataFrame) -> DataFrame:
    """One row per label and field: what was read off the label."""
    def shown(name):
        value = F.coalesce(F.col(f"{name}.value"), F.lit(""))
        value = F.when(value == "", F.lit("(not found)")).otherwise(value)
        return X.surgeon_general_case(value) if name == "government_warning" else value

    items = [
        F.struct(F.lit(title).alias("field"), shown(name).alias("extracted"))
        for name, title in FIELD_TITLES.items()
    ]
    return labels.select("label_id", F.inline(F.array(*items)))


def field_coverage(labels: DataFrame) -> DataFrame:
    """How many labels each field was found on."""
    return field_table(labels).groupBy("field").agg(
        F.count("*").alias("labels"),
        F.count_if(F.col("extracted") != "(not found)").alias("found"),
    )


def compare_expected(expected: DataFrame, labels: DataFrame) -> DataFrame:
    """Extracted against expected values, one row per label and field."""
    both = expected.select(
        "label_id",
        *[F.coalesce(F.col(c), F.lit("")).alias(f"e_{f}") for f, c in [
            ("brand_name", "brand_name"), ("class_type", "class_type"),
            ("alcohol_pct", "alcohol_pct"), ("net_contents", "net_contents_ml"),
            ("bottler", "bottler_name"),
        ]],
    ).join(labels, "label_id")

    def got(f):
        return strip(F.col(f"{f}.value"))

    def contains_either(e, g):
        return (
            F.contains(F.lower(g), F.lower(e)) | F.contains(F.lower(e), F.lower(g))
        )

    def verdict(f):
        e, g = F.col(f"e_{f}"), got(f)
        loose = (g != "") & ((e == "") | contains_either(e, g))
        if f == "alcohol_pct":
            ok = F.when(e != "", g == e).otherwise(loose)
        elif f == "brand_name":
            squeezed = F.replace(F.upper(g), F.lit(" ")) == F.replace(F.upper(e), F.lit(" "))
            ok = F.when(
                e != "", ((g != "") & squeezed) | F.contains(F.upper(g), F.upper(e))
            ).otherwise(loose)
        elif f == "net_contents":
            ok = F.when(e != "", g != "").otherwise(loose)
        else:
            ok = loose
        return F.when(ok, "OK").otherwise("DIFF")

    fields = ["brand_name", "class_type", "alcohol_pct", "net_contents", "bottler"]
    items = [
        F.struct(F.lit(f).alias("field"), got(f).alias("extracted"),
                 F.col(f"e_{f}").alias("expected"), verdict(f).alias("verdict"))
        for f in fields
    ]
    length = F.length(got("government_warning"))
    items.append(
        F.struct(
            F.lit("government_warning").alias("field"),
            F.concat(length.cast("string"), F.lit(" chars")).alias("extracted"),
            F.lit("present (full text)").alias("expected"),
            F.when(length > 50, "OK").otherwise("CHECK").alias("verdict"),
        )
    )
    return both.select("label_id", F.inline(F.array(*items)))

