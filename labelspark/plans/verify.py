"""The whole verification: applications and OCR words to checked labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark import schemas
from labelspark.config import DEFAULT, RuleConfig
from labelspark.operators.blocks import line_blocks
from labelspark.operators.dedup import deduplicate
from labelspark.operators.extract import FIELD, extract_fields, with_brand
from labelspark.operators.rules import as_application_side, required_norm, run_rules
from labelspark.operators.score import CRITICAL, score_array
from labelspark.operators.statements import suspicious_words
from labelspark.sources.words import typed_words, usable_words, word_errors


def blocks_from_words(words: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """OCR words of all passes to the block table of the labels."""
    return deduplicate(line_blocks(usable_words(words)), cfg)


def join_labels(applications: DataFrame, labels: DataFrame) -> DataFrame:
    """Applications with the fields of their label; no blocks means empty fields.

    The label side has one row per label_id. A label_id shared by many
    applications is split by the adaptive skew join on the application side.
    """
    empty = F.struct(F.lit("").alias("value"), F.lit(None).alias("bbox")).cast(FIELD)
    joined = as_application_side(applications).join(labels, "label_id", "left")
    none = F.array().cast(f"array<{FIELD}>")
    defaults = {name: empty for name in schemas.FIELDS}
    defaults |= {
        "all_text": F.lit(""), "brand_candidates": none, "brand_prominent": empty,
    }
    return joined.withColumns({n: F.coalesce(n, v) for n, v in defaults.items() if n in labels.columns})


def without_unread(matched: DataFrame) -> DataFrame:
    """Columns for the fields that were not extracted; whatever reads one fails."""
    unread = {n: F.raise_error(F.lit(f"{n} was not extracted")).cast(FIELD) for n in schemas.FIELDS if n not in matched.columns}
    return matched.withColumns(unread)


def verify_blocks(
    applications: DataFrame,
    blocks: DataFrame,
    cfg: RuleConfig = DEFAULT,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """Typed applications and label blocks to results, counts and overall status.

    ``lexicon`` (column word, upper case) marks other words of a statement as
    suspicious; without it none are.
    """
    labels = extract_fields(blocks, cfg)
    if lexicon is not None:
        odd = suspicious_words(labels, lexicon, required_norm(cfg))
        labels = labels.join(odd, "label_id", "left")
    matched = join_labels(applications, labels)
    if lexicon is not None:
        none = F.array().cast("array<string>")
        matched = matched.withColumn("suspicious", F.coalesce("suspicious", none))
    return score_array(run_rules(with_brand(matched, F.col("brand_name_app")), cfg))


def verify(
    applications: DataFrame,
    words: DataFrame,
    cfg: RuleConfig = DEFAULT,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """Typed applications and OCR words to checked labels."""
    return verify_blocks(applications, blocks_from_words(words, cfg), cfg, lexicon)


def verify_rows(
    applications: DataFrame,
    raw_words: DataFrame,
    cfg: RuleConfig = DEFAULT,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """Typed applications and unparsed word rows to checked labels with ``error``.

    A label with a row that cannot be read fails with its first error and without a result, the
    others are verified as ever. An application of such a label keeps its row.
    """
    typed = typed_words(raw_words)
    words = typed.where("error is null").drop("error")
    failed = word_errors(typed).where("label_id is not null").select("label_id", "error")
    return verify(applications, words, cfg, lexicon).join(failed, "label_id", "left")


def batch_rows(checked: DataFrame) -> DataFrame:
    """Rows of `batch_report` with the whole result and application of each label, as JSON.

    A failed row has no result.
    """
    app = [c for c in checked.columns if c.endswith("_app")] + [
        c for c in schemas.APPLICATION_TEXT + schemas.APPLICATION_FLAGS + schemas.FORM_FLAGS + ["age_years"]
        if c in checked.columns and f"{c}_app" not in checked.columns and c not in schemas.FIELDS
    ]
    whole = F.to_json(F.struct("results", "overall_status", F.struct("pass_count", "review_count", "fail_count").alias("counts")))
    if "error" in checked.columns:
        whole = F.when(F.col("error").isNull(), whole)
    data = F.to_json(F.struct(*[F.col(c).alias(c.removesuffix("_app")) for c in app]))
    both = checked.withColumns({"_result": whole, "_app_data": data})
    report = batch_report(both, ["_result", "_app_data"])
    return report.withColumnsRenamed({"_result": "result", "_app_data": "app_data"})


def batch_report(checked: DataFrame, also: list[str] | None = None) -> DataFrame:
    """One row per processed application. A row whose processing failed carries its
    ``error`` and counts as critical with one failure. A row whose words could not be
    read at all, marked by ``ocr_error``, is critical with no failure counted. Columns named in
    ``also`` are passed on."""
    none = F.lit(None).cast("string")
    error = F.col("error") if "error" in checked.columns else none
    unread = F.col("ocr_error").isNotNull() if "ocr_error" in checked.columns else F.lit(False)
    brand = "brand_name_app" if "brand_name_app" in checked.columns else "brand_name"
    kind = "class_type_app" if "class_type_app" in checked.columns else "class_type"
    return checked.select(
        "label_id",
        F.when(error.isNotNull() | unread, CRITICAL).otherwise(F.col("overall_status")).alias(
            "overall_status"
        ),
        F.when(error.isNotNull(), 1).when(unread, 0).otherwise(F.col("fail_count"))
        .cast("int").alias("fail_count"),
        F.col(brand).alias("brand_name"),
        F.col(kind).alias("class_type"),
        error.alias("error"),
        *(also or []),
    )
