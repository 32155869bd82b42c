"""Registry of the jobs as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelspark import schemas
from labelspark.config import REQUIRED_STATEMENT, DEFAULT
from labelspark.functions import numbers as N
from labelspark.functions import similarity as S
from labelspark.functions import text as X
from labelspark.operators import blocks as B
from labelspark.operators import decisions as D
from labelspark.operators import dedup as U
from labelspark.operators import extract as E
from labelspark.operators import match as M
from labelspark.operators import report as P
from labelspark.operators import rules as R
from labelspark.operators import score as SC
from labelspark.operators import statements as ST
from labelspark.operators import wordings as W
from labelspark.plans import fixtures as T
from labelspark.plans import planted as PL
from labelspark.plans.verify import (
    batch_report, batch_rows as rows_of_batch, join_labels, verify, verify_blocks, verify_rows, without_unread,
)
from labelspark.sources import applications as A
from labelspark.sources import application_file, store
from labelspark.sources.csv_records import parsed, records
from labelspark.sources.files import index_files
from labelspark.sources.words import usable_words

#: What the wordings of the queries add for each kind of beverage.
STATEMENT_ADDITIONS = {
    "wine": " Contains sulfites.", "beer": " Contains fermented barley.", "spirits": " Distilled from selected grains.",
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs -----------------------------------------------------------------


def applications(spark, d):
    return A.type_applications(T.submitted(spark, d))


def kept_blocks(spark, d):
    found = T.label_blocks(spark, d)
    return U.deduplicate(found.drop("pass_id", "line_no"))


def extracted(spark, d, names=tuple(E.READS)):
    return E.extract_fields(kept_blocks(spark, d), fields=names)


def fields(spark, d, names=tuple(E.READS)):
    """Extracted fields with the brand settled against the application."""
    apps = applications(spark, d).select("label_id", F.col("brand_name").alias("wanted"))
    return E.with_brand(extracted(spark, d, names).join(apps, "label_id"), F.col("wanted"))


def checked(spark, d):
    return verify_blocks(applications(spark, d), kept_blocks(spark, d))


def results(spark, d, category):
    reads = R.READS.get(category, tuple(E.READS))
    matched = join_labels(applications(spark, d), extracted(spark, d, reads))
    if "brand_name" in reads:
        matched = E.with_brand(matched, F.col("brand_name_app"))
    done = R.run_rules(without_unread(matched), categories=(category,))
    return R.explode_results(done).select(
        "label_id", "rule_id", "status", "message", "extracted_value", "app_value",
        "prefer_app_display",
    )


# --- intake ------------------------------------------------------------------------


@query
def applications_typed(spark, d):
    """Submission with free-form headers, renamed and typed."""
    messy = {
        "label_id": " Label ID ", "brand_name": "Brand Name", "class_type": "Class Type",
        "alcohol_pct": "ALCOHOL PCT", "net_contents_ml": "Net Contents",
        "bottler_name": "bottler name", "bottler_city": "Bottler City",
        "bottler_state": "Bottler_State", "country_of_origin": "Country of Origin",
        "beverage_type": "Beverage Type",
    }
    raw = T.submitted(spark, d).withColumn("Age Years", F.concat(F.col("k") % 9, F.lit(".7")))
    return A.type_applications(A.normalize_columns(raw.withColumnsRenamed(messy)))


@query
def submitted_csv(spark, d):
    """Lines of CSV files, dealt over splits, back to typed applications.

    Fields hold commas, quotes and line breaks; records reach over one split and the next.
    """
    def quoted(c):
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    apps = T.submitted(spark, d)
    brand = F.when(F.col("k") % 4 == 0, F.concat("brand_name", F.lit('\nof "Old", Town\n'), "class_type")).otherwise(F.col("brand_name"))
    record = F.concat_ws(",", "label_id", quoted(brand), F.concat(F.lit(" "), F.col("class_type"), F.lit(" ")), "alcohol_pct", "imported")
    text = F.concat(record, F.when(F.col("k") % 9 == 0, "\n").otherwise(""))
    lines = apps.select("k", F.posexplode(F.split(text, "\n")).alias("i", "value")).select(
        (F.col("k") % 3).cast("string").alias("file"), F.expr("(k * 4 + i) div 50").alias("block"),
        (F.col("k") * 4 + F.col("i")).alias("at"), "value",
    )
    names = ["Label ID", "Brand Name", "class_type", "ALCOHOL PCT", "imported"]
    header = lines.select("file").distinct().select(
        "file", F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("at"), F.lit(",".join(names)).alias("value")
    )
    rows = parsed(records(lines.unionByName(header)), names)
    return A.type_applications(A.normalize_columns(rows)).select("label_id", "brand_name", "class_type", "alcohol_pct", "imported")


def files(spark, d):
    apps = T.submitted(spark, d).select("label_id", "k")
    name = F.when(F.col("k") % 9 == 0, F.lower("label_id")).otherwise(F.col("label_id"))
    listed = F.array(
        F.when(F.col("k") % 10 != 0, F.concat(F.lit("in/scans/"), name, F.lit(".png"))),
        F.when(F.col("k") % 6 == 0, F.concat(F.lit("in/old.d/"), F.col("label_id"), F.lit(".jpg"))),
    )
    return apps.select(
        (F.col("k") * 2).alias("k2"), F.posexplode(F.array_compact(listed)).alias("i", "path")
    ).select("path", (F.col("k2") + F.col("i")).alias("listing_no"))


@query
def label_file_index(spark, d):
    return index_files(files(spark, d))


@query
def label_file_match(spark, d):
    apps = T.submitted(spark, d).select("label_id")
    return M.match_files(apps, index_files(files(spark, d)))


@query
def missing_label_files(spark, d):
    apps = T.submitted(spark, d).select("label_id", "brand_name")
    return M.missing_files(apps, index_files(files(spark, d)))


@query
def usable_ocr_words(spark, d):
    """Words left after dropping blanks and non-words."""
    words = T.ocr_words(spark, d).withColumn(
        "conf", F.when(F.col("word_no") % 5 == 0, -1.0).otherwise(F.col("conf"))
    ).withColumn("text", F.when(F.col("word_no") % 7 == 0, "  ").otherwise(F.col("text")))
    return usable_words(words).groupBy("label_id").agg(
        F.count("*").alias("words"), F.sum(F.length("text")).alias("chars")
    )


# --- words to blocks -----------------------------------------------------------------


@query
def word_gaps(spark, d):
    return B.word_gaps(usable_words(T.ocr_words(spark, d))).select(
        "label_id", "pass_id", "line_num", "word_no", "gap"
    )


@query
def gap_thresholds(spark, d):
    return B.gap_thresholds(B.word_gaps(usable_words(T.ocr_words(spark, d)))).select(
        "label_id", "pass_id", "line_num", "word_no", "threshold"
    )


@query
def sub_lines(spark, d):
    return B.sub_lines(usable_words(T.ocr_words(spark, d))).select(
        "label_id", "pass_id", "line_num", "word_no", "sub_line"
    )


@query
def line_blocks(spark, d):
    return B.line_blocks(usable_words(T.ocr_words(spark, d))).select(
        "label_id", "pass_id", "line_num", "sub_line", "text", "x1", "y1", "x2", "y2",
        "confidence",
    )


@query
def deduplicated_blocks(spark, d):
    return kept_blocks(spark, d)


@query
def overlapping_blocks(spark, d):
    return U.overlap_pairs(T.label_blocks(spark, d)).select(
        "label_id", "block_a", "block_b", F.round("overlap", 6).alias("overlap")
    )


@query
def reading_order(spark, d):
    """Blocks ranked top to bottom, left to right."""
    labels = E.in_reading_order(E.block_tests(kept_blocks(spark, d)))
    return labels.select("label_id", F.posexplode("bs").alias("place", "b")).select(
        "label_id", "place", F.col("b.block_id").alias("block_id"),
        F.lag("b.text").over(
            Window.partitionBy("label_id").orderBy("place")
        ).alias("previous_text"),
    )


@query
def label_text(spark, d):
    """Full text of a label in input order."""
    return extracted(spark, d, ()).select("label_id", "all_text")


# --- block tests ------------------------------------------------------------------------


@query
def block_flags(spark, d):
    tested = E.block_tests(kept_blocks(spark, d))
    return tested.select(
        "label_id", "block_id", "junk", "stop", "class_word", "anchor",
        E.is_serving_only(F.col("up")).alias("serving_only"), "opens", "in_warning",
        "bottler_header", N.plausible_abv(F.col("abv")).alias("plausible"),
    )


@query
def statement_order(spark, d):
    """Blocks that take part in the statement with their place in the wording."""
    tested = E.block_tests(kept_blocks(spark, d))
    return tested.filter("in_warning").select("label_id", "block_id", "warning_pos")


# --- fields --------------------------------------------------------------------------------


def one_field(name):
    def run(spark, d):
        return extracted(spark, d, (name,)).select(
            "label_id", F.col(f"{name}.value").alias("value"),
            F.array_join(f"{name}.bbox", ",").alias("bbox"),
        )

    run.__name__ = f"field_{name}"
    return query(run)


for _name in schemas.FIELDS[1:]:
    one_field(_name)


@query
def field_brand_name(spark, d):
    return fields(spark, d, ("brand_name",)).select(
        "label_id", F.col("brand_name.value").alias("value"),
        F.array_join("brand_name.bbox", ",").alias("bbox"),
    )


@query
def field_warning_by_anchor(spark, d):
    """The statement read without a configured wording."""
    cfg = replace(DEFAULT, required_statement="")
    labels = E.extract_fields(kept_blocks(spark, d), cfg, ("government_warning",))
    return labels.select("label_id", F.col("government_warning.value").alias("value"))


@query
def field_table(spark, d):
    return P.field_table(fields(spark, d))


@query
def field_coverage(spark, d):
    return P.field_coverage(fields(spark, d))


@query
def field_comparison(spark, d):
    return P.compare_expected(applications(spark, d), fields(spark, d))


# --- rules ---------------------------------------------------------------------------------


@query
def rules_identity(spark, d):
    return results(spark, d, R.IDENTITY)


@query
def rules_alcohol(spark, d):
    return results(spark, d, R.ALCOHOL)


@query
def rules_warning(spark, d):
    return results(spark, d, R.WARNING)


@query
def rules_origin(spark, d):
    return results(spark, d, R.ORIGIN)


@query
def rules_other(spark, d):
    return results(spark, d, R.OTHER)


@query
def rule_arms(spark, d):
    """Results of the rules that each planted label is about; between them, all arms of all rules."""
    done = R.run_rules(PL.planted_fields(spark, d))
    about = F.col("category").alias("about")
    rows = R.explode_results(done.select("*", about), "label_id", "case_no", "about")
    return rows.where("category = about").select(
        "label_id", "case_no", "rule_id", "category", "status", "message", "extracted_value", "app_value",
        F.coalesce("prefer_app_display", F.lit(False)).alias("prefer_app_display"),
    )


@query
def class_requirements(spark, d):
    return applications(spark, d).select(
        "label_id", F.array_join(R.infer_requirements(F.col("class_type")), ",").alias("needs")
    )


STATUS = ["label_id", "overall_status", "pass_count", "review_count", "fail_count"]


@query
def verify_labels(spark, d):
    """Blocks and applications to status: the whole rule set."""
    return checked(spark, d).select(*STATUS)


@query
def verify_from_words(spark, d):
    """OCR words and applications to status: the whole job."""
    return verify(applications(spark, d), T.ocr_words(spark, d)).select(*STATUS)


@query
def score_rule_table(spark, d):
    """Status from the long rule table, labels without results included."""
    apps = applications(spark, d)
    long = R.explode_results(checked(spark, d))
    return SC.score_table(apps, long)


@query
def result_matrix(spark, d):
    return P.result_matrix(checked(spark, d)).select(
        "label_id", "pos", "criterion", "application", "label", "status",
        F.array_join("unmatched_words", " ").alias("unmatched"),
    )


@query
def critical_labels(spark, d):
    return P.filter_status(batch_report(checked(spark, d)), SC.CRITICAL).select(
        "label_id", "fail_count", "brand_name", "class_type"
    )


@query
def batch_with_errors(spark, d):
    """Batch rows where every 29th label failed to process."""
    rows = checked(spark, d).withColumn(
        "error",
        F.when(F.expr("cast(substring(label_id, 2) as bigint) % 29 = 0"), "unreadable"),
    )
    return batch_report(rows)


@query
def batch_rows(spark, d):
    """Batch rows with application and result, both read back from their JSON."""
    rows = rows_of_batch(checked(spark, d).withColumn(
        "error", F.when(F.expr("cast(substring(label_id, 2) as bigint) % 29 = 0"), "unreadable")
    ))
    told = F.from_json("result", "results array<struct<rule_id:string>>, overall_status string, "
                       "counts struct<pass_count:bigint,review_count:bigint,fail_count:bigint>")
    return rows.withColumn("r", told).select(
        *[c for c in rows.columns if c not in ("result", "app_data")],
        F.size("r.results").alias("result_rules"), F.col("r.overall_status").alias("result_status"),
        F.col("r.counts.review_count").alias("result_reviews"),
        *[F.get_json_object("app_data", f"$.{c}").alias(f"app_{c}") for c in ("brand_name", "alcohol_pct", "imported", "bottler_city")],
    )


@query
def report_of_broken_words(spark, d):
    """Batch rows of unparsed words, some of which cannot be read."""
    k = F.expr("cast(substring(label_id, 2) as bigint)")
    words = T.ocr_words(spark, d)
    raw = words.select(
        "label_id", "text",
        F.when((k % 31 == 0) & (F.col("line_num") == 3) & (F.col("word_no") == 1), "x12").otherwise(F.col("left").cast("string")).alias("left"),
        F.when((k % 37 == 0) & (F.col("line_num") == 2) & (F.col("word_no") == 1), "").otherwise(F.col("width").cast("string")).alias("width"),
        *[F.concat(F.lit(" "), F.col(c).cast("string")).alias(c) for c in ("pass_id", "word_no", "block_num", "par_num", "line_num", "conf", "top", "height")],
        F.lit(None).cast("string").alias("unreadable"),
    )
    lost = words.select(F.lit(None).cast("string").alias("label_id"), F.lit("{cut").alias("unreadable")).limit(3)
    return batch_report(verify_rows(applications(spark, d), raw.unionByName(lost, allowMissingColumns=True)))


@query
def batch_totals(spark, d):
    return P.batch_totals(batch_report(checked(spark, d)))


# --- expressions over the tables ---------------------------------------------------------------


@query
def parsed_contents(spark, d):
    """Net contents and alcohol of application and label line as numbers."""
    lines = T.label_blocks(spark, d).filter("pass_id = 0 and line_no = 4")
    apps = T.submitted(spark, d)
    return lines.select("label_id", F.col("text").alias("line")).join(apps, "label_id").select(
        "label_id", N.net_ml(F.col("line")).alias("label_ml"),
        N.net_ml(F.col("net_contents_ml")).alias("app_ml"),
        N.abv_float(F.concat("alcohol_pct", F.lit(" %"))).alias("abv"),
        X.ocr_numeric(F.col("line")).alias("digits"),
    )


@query
def block_contents(spark, d):
    """Net contents, alcohol and digits of every block of both passes as numbers, beside the application's."""
    blocks = T.label_blocks(spark, d).select("label_id", "pass_id", "line_no", F.col("text").alias("line"))
    return blocks.join(T.submitted(spark, d), "label_id").select(
        "label_id", "pass_id", "line_no", N.net_ml(F.col("line")).alias("label_ml"),
        N.net_ml(F.col("net_contents_ml")).alias("app_ml"),
        N.abv_float(F.concat("alcohol_pct", F.lit(" %"))).alias("abv"),
        X.ocr_numeric(F.col("line")).alias("digits"),
    )


@query
def normalised_names(spark, d):
    """Normal forms of every block's text."""
    text = F.col("text")
    return T.label_blocks(spark, d).select(
        "label_id", "pass_id", "line_no", X.norm(F.concat(F.lit("  "), text, F.lit(" \t x"))).alias("normed"),
        F.array_join(X.tokenize(F.concat(F.lit("("), text, F.lit("), ..."))), "|").alias("tokens"),
        X.ocr_text(text).alias("folded"),
        X.apply_casing(text, F.lit("mixed")).alias("cased"),
    )


@query
def name_similarity(spark, d):
    """Match score of each application brand with the brand line of the next label."""
    lines = T.label_blocks(spark, d).filter("pass_id = 0 and line_no = 1").select(
        (F.expr("cast(substring(label_id, 2) as bigint)") - 1).alias("k"),
        F.col("text").alias("line"),
    )
    apps = T.submitted(spark, d).select("k", "label_id", "brand_name")
    both = apps.join(lines, "k")
    m = S.smart_match(F.col("brand_name"), F.col("line"))
    return both.select(
        "label_id", F.round(S.similarity(F.col("brand_name"), F.col("line")), 6).alias("ratio"),
        m.alias("m"),
    ).select("label_id", "ratio", F.round("m.score", 6).alias("score"), "m.reason")


@query
def block_similarity(spark, d):
    """Match score of each application brand with every block of the next label, both passes."""
    lines = T.label_blocks(spark, d).select(
        (F.expr("cast(substring(label_id, 2) as bigint)") - 1).alias("k"), "pass_id", "line_no", F.col("text").alias("line"),
    )
    # a brand meets many blocks, so its form is made before the join; the rows it makes wide are not to be broadcast
    apps = T.submitted(spark, d).select("k", "label_id", "brand_name", S.text_form(F.col("brand_name")).alias("a"))
    both = apps.hint("merge").join(lines, "k").withColumn("b", S.text_form(F.col("line")))
    both = both.withColumn("common", S.common_lengths(F.col("a"), F.col("b")))
    pair, known = (F.col("brand_name"), F.col("line")), S.Reading(F.col("a"), F.col("b"), F.col("common"))
    return both.select(
        "label_id", "pass_id", "line_no",
        F.round(S.similarity(*pair, known=known), 6).alias("ratio"), S.smart_match(*pair, known=known).alias("m"),
    ).select("label_id", "pass_id", "line_no", "ratio", F.round("m.score", 6).alias("score"), "m.reason")


@query
def misread_numbers(spark, d):
    """Whether the alcohol figure of each label could be a misread of the next one's."""
    apps = T.submitted(spark, d).select("k", "label_id", F.col("alcohol_pct").alias("a"))
    other = apps.select((F.col("k") - 1).alias("k"), F.translate("a", "105", "lOS").alias("b"))
    return apps.join(other, "k").select(
        "label_id", S.confusable(F.col("a"), F.col("b")).alias("confusable")
    )


@query
def youngest_age(spark, d):
    text = F.lower(
        F.concat(F.lit("Aged "), F.col("p_size"), F.lit(" Years, finished "),
                 F.col("p_partkey") % 37, F.lit(" year in oak, yearsof 1 yearly"))
    )
    ages = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?U)(\d+)\s*years?\b"), F.lit(1)),
        lambda n: n.try_cast("bigint"),
    )
    return T.table(spark, d, "part").select(
        "p_partkey", F.array_min(ages).alias("age"),
        X.snippet(text, R.YEARS, 15, 5).alias("snippet"),
    )


@query
def statement_words(spark, d):
    """Required words missing from, and extra words on, each label's statement."""
    need = R.required_norm(DEFAULT)
    text = X.statement_norm(F.col("government_warning.value"))
    words = X.upper_words(F.col("normed"))
    return (
        extracted(spark, d, ("government_warning",)).select("label_id", text.alias("normed"), "all_text")
        .select(
            "label_id", "normed", R.all_words_present(words, need).alias("all_present"),
            R.phrase_within_gap(words, "BIRTH DEFECTS").alias("in_order"),
            F.array_join(
                F.slice(R.extra_words(X.upper_words(F.col("all_text")), need), 1, 5), " "
            ).alias("extra"),
        )
    )


@query
def corrected_statement_words(spark, d):
    """Misread words of planted statements with the words that their beverage's wording has for them."""
    wording = {kind: REQUIRED_STATEMENT + more for kind, more in STATEMENT_ADDITIONS.items()}
    apps = applications(spark, d).select("label_id", F.col("beverage_type").alias("wording"))
    statements = W.wordings(spark, wording)
    words = T.planted_statements(apps.join(statements, "wording")).select(
        "wording", F.explode(F.array_distinct(X.upper_words(F.col("text")))).alias("word")
    )
    return W.corrections(words, statements)


@query
def corrected_statements(spark, d):
    """Those statements with the misread words replaced, by label."""
    wording = {kind: REQUIRED_STATEMENT + more for kind, more in STATEMENT_ADDITIONS.items()}
    apps = applications(spark, d).select("label_id", F.col("beverage_type").alias("wording"))
    statements = W.wordings(spark, wording)
    planted = T.planted_statements(apps.join(statements, "wording")).select("label_id", "wording", "text")
    return W.corrected(planted, statements).select("label_id", "corrected")


@query
def unknown_label_words(spark, d):
    """Label words neither the required statement nor the product table knows."""
    parts = T.table(spark, d, "part")
    lexicon = (
        parts.select(F.explode(X.upper_words(F.concat_ws(" ", "p_name", "p_type"))).alias("word"))
        .unionByName(spark.range(1).select(
            F.explode(X.upper_words(F.lit(REQUIRED_STATEMENT))).alias("word")))
    )
    counted = ST.word_multiset(extracted(spark, d, ()), "label_id", "all_text")
    return ST.unknown_words(counted, lexicon)


# --- driver tables directly ---------------------------------------------------------------------


@query
def documents_with_passages(spark, d):
    """Whole benchmark passages found in documents."""
    return ST.find_passages(T.table(spark, d, "documents"), T.table(spark, d, "benchmark"))


@query
def document_words(spark, d):
    """Word statistics of the documents."""
    counted = ST.word_multiset(T.table(spark, d, "documents"), "doc_id", "text")
    return counted.groupBy("doc_id").agg(
        F.sum("n").alias("words"), F.count("*").alias("distinct_words"),
        F.max("n").alias("most_frequent"),
    )


@query
def document_cleaning(spark, d):
    docs = T.table(spark, d, "documents")
    return docs.select(
        "doc_id", X.norm(F.col("text")).alias("normed"),
        F.size(X.tokenize(F.col("text"))).alias("tokens"), X.casing(F.col("text")).alias("casing"),
    )


@query
def document_repeats(spark, d):
    """Documents without adjacent repeats of phrases of up to five words."""
    docs = T.spread(spark, T.table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", X.collapse_repeats(F.col("text")).alias("text"))


@query
def order_totals(spark, d):
    """Order totals against their lines, scored per customer."""
    lines = T.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
        .alias("expected")
    )
    orders = T.table(spark, d, "orders").join(
        lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"
    )
    status = (
        F.when(F.col("expected").isNull(), "fail")
        .when(F.abs(F.col("o_totalprice") - F.col("expected")) > 1.0, "needs_review")
        .otherwise("pass")
    )
    rows = orders.select(F.col("o_custkey").cast("string").alias("label_id"), status.alias("status"))
    customers = T.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("label_id")
    )
    return SC.score_table(customers, rows)


@query
def stitched_conversations(spark, d):
    """Turns of a conversation as one text in order."""
    return T.table(spark, d, "conversations").groupBy("conv_id").agg(
        B.ordered_text(["turn", "role"]).alias("text"), F.count("*").alias("turns")
    )


# --- decisions ------------------------------------------------------------------------------------


def decision_log(spark, d):
    """Every event as an entry of the decision log."""
    kind = F.col("event_type")
    decision = (
        F.when(kind.isin("purchase", "signup"), "approve").when(kind == "error", "decline")
        .otherwise("undo")
    )
    return T.table(spark, d, "events").select(
        F.concat(F.lit("L"), F.col("user_id")).alias("label_id"), "ts",
        F.col("event_id").alias("entry_no"), decision.alias("decision"),
    )


@query
def current_decisions(spark, d):
    return D.current_decisions(decision_log(spark, d))


@query
def decision_overlay(spark, d):
    apps = applications(spark, d).select("label_id", "brand_name")
    return D.overlay(apps, D.current_decisions(decision_log(spark, d)))


@query
def bucket_counts(spark, d):
    """Store buckets after applying the decisions."""
    apps = applications(spark, d).select(
        F.col("label_id").alias("id"), "brand_name", F.lit("under_review").alias("bucket")
    )
    decided = D.current_decisions(decision_log(spark, d)).select(
        F.col("label_id").alias("id"), D.bucket_of(F.col("decision")).alias("bucket")
    )
    return D.bucket_counts(D.move_applications(apps, decided))


@query
def store_entries(spark, d):
    """Store entries in exported form and read back."""
    apps = applications(spark, d)
    entry = apps.select(
        F.col("label_id").alias("id"), F.encode("brand_name", "UTF-8").alias("image_bytes"),
        F.to_json(F.struct("alcohol_pct", "imported", "age_years")).alias("app_data"),
    )
    exported = store.to_json_form(entry)
    back = store.from_json_form(exported.withColumnRenamed("image_bytes", "text_form")
                                .withColumn("image_bytes", F.col("text_form")))
    parsed = F.from_json("app_data", "alcohol_pct string, imported boolean, age_years int")
    return back.select(
        "id", F.col("text_form").alias("encoded"),
        F.decode("image_bytes", "UTF-8").alias("decoded"), parsed.alias("p"),
    ).select("id", "encoded", "decoded", "p.alcohol_pct", "p.imported", "p.age_years")


@query
def store_after_decisions(spark, d):
    """Whole entries of a log of first contents, second contents of some, and all decisions."""
    apps = applications(spark, d).withColumn("k", F.substring("label_id", 2, 18).cast("long"))

    def entry(rows, status):
        return rows.select(
            F.col("label_id").alias("id"), "brand_name", "class_type", F.lit(status).alias("overall_status"),
            F.to_json(F.struct("alcohol_pct", "imported")).alias("app_data"),
            F.encode("net_contents_ml", "UTF-8").alias("image_bytes"),
            F.to_json(F.struct(F.col("k").alias("pass_count"))).alias("result"), F.lit("under_review").alias("bucket"),
        )

    first = store.log_rows(entry(apps, "Needs review")).withColumn("number", F.lit(0).cast("long"))
    again = store.log_rows(entry(apps.where("k % 3 = 0"), "Ready to approve")).withColumn("number", F.lit(1).cast("long"))
    # a decision's commit is numbered by its time, its place there by its entry
    decided = decision_log(spark, d).select(
        F.col("label_id").alias("id"), D.bucket_of(F.col("decision")).alias("bucket"),
        F.col("entry_no").cast("long").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("number"),
    )
    log = first.unionByName(again).unionByName(decided, allowMissingColumns=True)
    state = store.merged(log)
    return state.withColumn("image_bytes", F.decode("image_bytes", "UTF-8"))


@query
def application_file_entries(spark, d):
    """Entries of single-file stores, parsed as VARIANT, with keys that have no column."""
    apps = T.submitted(spark, d)
    one = F.to_json(F.struct(
        F.col("label_id").alias("id"), "brand_name", F.struct("alcohol_pct", F.struct("proof").alias("more")).alias("app_data"),
        F.base64(F.encode("class_type", "UTF-8")).alias("image_bytes"), (F.col("k") % 5).alias("note"),
    ))
    # files of at most ten entries; every thirteenth file is cut off
    entries = apps.select(F.expr("k div 10").alias("file"), (F.col("k") % 3).alias("b"), one.alias("e"))
    lists = [F.concat_ws(",\n ", F.array_sort(F.collect_list(F.when(F.col("b") == i, F.col("e"))))).alias(f"l{i}") for i in range(3)]
    text = F.concat(*[
        F.concat(F.lit(("{" if i == 0 else ", ") + f'"{name}": ['), F.col(f"l{i}"), F.lit("]")) for i, name in enumerate(store.BUCKETS)
    ], F.when(F.col("file") % 13 == 5, "").otherwise("}"))
    files = entries.groupBy("file").agg(*lists).select(text.alias("value"))
    return application_file.parse_documents(files).select(
        "id", "bucket", "brand_name", "app_data", F.decode("image_bytes", "UTF-8").alias("image"), "extra"
    )
