"""Rule results of a label against its application.

Each rule is a struct-valued expression, null when the rule does not apply. The
rules of a label form one array in category order, so evaluating and scoring
them adds no exchange; :func:`explode_results` turns them into the long table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark import config as C
from labelspark import schemas
from labelspark.config import DEFAULT, RuleConfig
from labelspark.functions import text as X
from labelspark.functions.numbers import abv_float, net_ml, percent
from labelspark.functions.similarity import (
    clean_words, confusable, smart_match, tokens_in_words,
)
from labelspark.functions.text import built_once, norm

IDENTITY, ALCOHOL, WARNING, ORIGIN, OTHER = (
    "Identity", "Alcohol & contents", "Warning", "Origin", "Other",
)
SPIRITS = ("spirits", "distilled_spirits")
MALT = ("beer", "beer_malt_beverage")
MISREAD = " — likely OCR misread"
AGED = r"(?U)\baged\b"
YEARS = r"(?U)\d+\s*years?\b"
AGE_STATEMENT = r"(?U)age\s+statement"


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def result(rule_id, category, status, message, box, extracted, app, prefer=False) -> Column:
    return F.struct(
        lit(rule_id).alias("rule_id"),
        lit(category).alias("category"),
        lit(status).alias("status"),
        lit(message).alias("message"),
        lit(box).cast("array<int>").alias("bbox_ref"),
        lit(extracted).alias("extracted_value"),
        lit(app).alias("app_value"),
        lit(prefer).alias("prefer_app_display"),
    ).cast(schemas.RULE_RESULT)


def no_result() -> Column:
    return F.lit(None).cast(schemas.RULE_RESULT)


def beverage_key(c: Column) -> Column:
    value = F.when(F.coalesce(c, F.lit("")) == "", F.lit("spirits")).otherwise(c)
    return F.translate(F.lower(value), "/ ", "__")


def infer_requirements(class_name: Column) -> Column:
    """Requirements a class designation brings along, as a sorted array."""
    low = F.lower(F.coalesce(class_name, F.lit("")))
    hits = [
        F.when(
            F.greatest(*[F.contains(low, F.lit(k.lower())) for k in keys], F.lit(False)),
            F.lit(requirement),
        )
        for requirement, keys in C.CLASS_REQUIREMENTS
    ]
    return F.array_sort(F.array_compact(F.array(*hits)))


# --- inputs of the rules, computed once per row --------------------------------


def rule_inputs(matched: DataFrame, cfg: RuleConfig = DEFAULT) -> DataFrame:
    """Add the normalised values and match scores the rules refer to.

    ``matched`` holds application columns, the extracted fields and ``all_text``.
    """
    have = set(matched.columns)
    optional = {"youngest_age_years": "int", "suspicious": "array<string>"}
    for name, kind in optional.items():
        if name not in have:
            default = F.array() if kind.startswith("array") else F.lit(None)
            matched = matched.withColumn(name, default.cast(kind))
    flags = schemas.APPLICATION_FLAGS + schemas.FORM_FLAGS
    inputs = matched.select(
        "*",
        beverage_key(F.col("beverage_type")).alias("bev"),
        *[norm(F.col(f"{f}.value")).alias(f"l_{f}") for f in schemas.FIELDS],
        *[
            norm(F.col(a)).alias(f"a_{f}")
            for f, a in [
                ("brand_name", "brand_name_app"), ("class_type", "class_type_app"),
                ("alcohol_pct", "alcohol_pct_app"), ("proof", "proof_app"),
                ("net_contents", "net_contents_ml"), ("bottler", "bottler_name"),
                ("country_of_origin", "country_of_origin_app"),
                ("city", "bottler_city"), ("state", "bottler_state"),
            ]
        ],
        *[
            F.coalesce(F.col(f).cast("boolean"), F.lit(False)).alias(f"f_{f}")
            if f in have else F.lit(False).alias(f"f_{f}")
            for f in flags
        ],
        F.lower("all_text").alias("low"),
        clean_words(F.col("all_text")).alias("label_words"),
    )
    col = F.col
    inputs = inputs.withColumn("m", match_scores(cfg)).select(
        "*", *[F.col("m")[i].alias(f"m_{n}") for i, n in enumerate(("brand", "class", "bottler"))]
    )
    inputs = inputs.withColumn("t", found_in_text(cfg)).select(
        "*", *[F.col("t")[i].alias(f"t_{n}") for i, n in enumerate(("brand", "class", "bottler"))]
    )
    values = (
        inputs.withColumns(
            {
                "label_abv": abv_float(col("l_alcohol_pct")),
                "app_abv": abv_float(col("a_alcohol_pct")),
                "label_ml": net_ml(col("l_net_contents")),
                "app_ml": net_ml(col("a_net_contents")),
                "statement": norm(col("government_warning.value")),
                "class_name": F.when(
                    col("a_class_type") != "", col("a_class_type")
                ).otherwise(col("l_class_type")),
                "age_known": known_age(),
            }
        )
        .withColumns(
            {
                "statement_norm": X.statement_norm(
                    X.collapse_warning(X.drop_tokens(col("statement"), col("suspicious")))
                ),
                "inferred": infer_requirements(col("class_name")),
            }
        )
        .withColumns(
            {
                "statement_words": X.upper_words(col("statement_norm")),
                "exact": exact_wording(cfg),
            }
        )
        .withColumns(wording_evidence(cfg))
        .withColumn("age_text", age_snippet())
    )
    return values.withColumn("c", misreads(cfg)).select(
        "*", *[F.col("c")[i].alias(f"c_{f}") for i, f in enumerate(confusable_needs(cfg))]
    )


# One expression per kind of comparison, applied to the pairs that need it: the fuzzy
# functions are large, and a copy per rule would swell the plan.


@built_once
def match_scores(cfg: RuleConfig) -> Column:
    """Match outcomes of brand, class and bottler (or the brand, lacking a bottler)."""
    col = F.col
    pairs = F.array(
        F.struct(col("a_brand_name").alias("app"), col("l_brand_name").alias("label")),
        F.struct(col("a_class_type").alias("app"), col("l_class_type").alias("label")),
        F.struct(
            col("a_bottler").alias("app"),
            F.when(col("l_bottler") != "", col("l_bottler"))
            .otherwise(col("l_brand_name")).alias("label"),
        ),
    )
    return F.transform(pairs, lambda p: smart_match(p["app"], p["label"], cfg))


@built_once
def found_in_text(cfg: RuleConfig) -> Column:
    """Full-text search, only where the match score leaves it to decide."""
    col = F.col
    needs = {
        "brand_name": col("m_brand.score") < cfg.match_pass,
        "class_type": col("m_class.score") < cfg.match_pass,
        "bottler": (col("l_bottler") == "") | (col("m_bottler.score") < cfg.bottler_pass),
    }
    searches = F.array(
        *[F.struct(col(f"a_{f}").alias("value"), n.alias("need")) for f, n in needs.items()]
    )
    return F.transform(
        searches,
        lambda s: F.when(
            s["need"], tokens_in_words(s["value"], col("low"), col("label_words"), cfg)
        ).otherwise(F.lit(False)),
    )


@built_once
def misreads(cfg: RuleConfig) -> Column:
    """Whether OCR may have misread a value, in the order of ``confusable_needs``."""
    col = F.col
    compared = F.array(
        *[
            F.struct(col(f"a_{f}").alias("app"), col(f"l_{f}").alias("label"),
                     (F.coalesce(need, F.lit(False)) & (col(f"a_{f}") != "")
                      & (col(f"l_{f}") != "")).alias("need"))
            for f, need in confusable_needs(cfg).items()
        ]
    )
    return F.transform(
        compared,
        lambda p: F.when(p["need"], confusable(p["app"], p["label"], cfg)).otherwise(
            F.lit(False)
        ),
    )


@built_once
def confusable_needs(cfg: RuleConfig) -> dict[str, Column]:
    """Where a rule asks whether OCR may have misread the value, by field."""
    col = F.col
    low_label = F.lower("l_country_of_origin")
    low_app = F.lower("a_country_of_origin")
    return {
        "brand_name": (col("m_brand.score") < cfg.match_pass) & ~col("t_brand"),
        "class_type": (col("m_class.score") < cfg.match_pass) & ~col("t_class"),
        "alcohol_pct": F.abs(col("label_abv") - col("app_abv")) > cfg.abv_tolerance,
        "proof": ~col("bev").isin(*MALT, "wine") & (col("l_proof") != col("a_proof")),
        "net_contents": F.abs(col("app_ml") - col("label_ml")) > cfg.net_tolerance_ml,
        "bottler": (col("m_bottler.score") < 0.60) & ~col("t_bottler"),
        "country_of_origin": col("f_imported")
        & ~F.contains(low_label, low_app) & ~F.contains(low_app, low_label),
    }


@built_once
def known_age() -> Column:
    """Years of age: application value when positive, else the youngest on the label."""
    col = F.col
    on_label = F.array_min(
        F.transform(
            F.regexp_extract_all("low", F.lit(r"(?U)(\d+)\s*years?\b"), F.lit(1)),
            lambda n: n.try_cast("bigint"),
        )
    )
    return F.coalesce(
        F.when(col("youngest_age_years") > 0, col("youngest_age_years")),
        F.when(col("age_years") > 0, col("age_years")),
        on_label,
    )


# --- identity -------------------------------------------------------------------


def identity_rule(field: str, short: str, title: str, cfg: RuleConfig) -> Column:
    col = F.col
    label, app, box = col(f"l_{field}"), col(f"a_{field}"), col(f"{field}.bbox")
    score, reason = col(f"m_{short}.score"), col(f"m_{short}.reason")
    matches, mixed = f"{title} matches", col(f"c_{field}")

    def out(status, message, prefer=False):
        return result(matches, IDENTITY, status, message, box, label, app, prefer)

    in_text = out("pass", f"{title} found on label (tokens in full text).", True)
    if short == "brand":
        low_in_text = in_text
    else:
        low_in_text = out(
            "needs_review",
            F.concat(F.lit("Application class '"), app,
                     F.lit("' found on label but extracted class is '"), label,
                     F.lit("' — verify.")),
        )
    hint = F.when(mixed, MISREAD).otherwise("")
    near = F.when(col(f"t_{short}"), in_text).otherwise(
        out(
            "needs_review",
            F.concat(F.lit(f"{title} similar but not exact ("), reason, F.lit(", "),
                     percent(score), F.lit(")"), hint, F.lit(".")),
        )
    )
    far = (
        F.when(col(f"t_{short}"), low_in_text)
        .when(
            mixed,
            out("needs_review",
                F.concat(F.lit(f"{title} differs{MISREAD}, verify manually ("),
                         percent(score), F.lit(")."))),
        )
        .otherwise(
            out("fail", F.concat(F.lit(f"{title} mismatch ("), percent(score), F.lit(").")))
        )
    )
    present = f"{title} present"
    return (
        F.when(
            label == "",
            result(present, IDENTITY, "fail", f"{title} not found on label.", box, "", app),
        )
        .when(
            app == "",
            result(present, IDENTITY, "needs_review",
                   f"{title} found on label — add to application for verification.",
                   box, label, ""),
        )
        .when(
            score >= cfg.match_pass,
            out("pass", F.concat(F.lit(f"{title} matches ("), reason, F.lit(")."))),
        )
        .when(score >= cfg.match_review, near)
        .otherwise(far)
    )


# --- alcohol and contents ---------------------------------------------------------


def abv_rule(cfg: RuleConfig) -> Column:
    col = F.col
    label, app, box = col("l_alcohol_pct"), col("a_alcohol_pct"), col("alcohol_pct.bbox")
    mixed = col("c_alcohol_pct")
    optional = col("bev").isin(*cfg.abv_optional_types)
    both = col("label_abv").isNotNull() & col("app_abv").isNotNull()
    close = F.abs(col("label_abv") - col("app_abv")) <= cfg.abv_tolerance

    def out(rule_id, status, message):
        return result(rule_id, ALCOHOL, status, message, box, label, app)

    differs = F.when(
        mixed,
        F.concat(F.lit("ABV on label ("), label, F.lit("%) differs from application ("), app,
                 F.lit(f"%){MISREAD}, verify manually.")),
    ).otherwise(
        F.concat(F.lit("ABV on label ("), label, F.lit("%) does not match application ("),
                 app, F.lit("%)."))
    )
    return (
        F.when(
            (label == "") & optional,
            result("Alcohol content present", ALCOHOL, "pass",
                   "Alcohol content not required for this beverage type.", None, "", app),
        )
        .when(
            label == "",
            result("Alcohol content present", ALCOHOL, "fail",
                   "Alcohol content (ABV) not found on label.", box, "", app),
        )
        .when(
            app == "",
            out("Alcohol content", "needs_review",
                "Alcohol content found on label — add to application for verification."),
        )
        .when(both & close, out("Alcohol content matches", "pass",
                                "Alcohol content present and matches."))
        .when(both, out("Alcohol content matches", "needs_review", differs))
        .otherwise(out("Alcohol content", "pass", "Alcohol content present."))
    )


def proof_rule(cfg: RuleConfig) -> Column:
    col = F.col
    label, app, box = col("l_proof"), col("a_proof"), col("proof.bbox")
    mixed = col("c_proof")

    def out(rule_id, status, message):
        return result(rule_id, ALCOHOL, status, message, box, label, app)

    differs = F.when(
        mixed,
        F.concat(F.lit("Proof on label ("), label, F.lit(") differs from application ("), app,
                 F.lit(f"){MISREAD}, verify manually.")),
    ).otherwise(
        F.concat(F.lit("Proof on label ("), label, F.lit(") does not match application ("),
                 app, F.lit(")."))
    )
    return (
        F.when(
            col("bev").isin(*MALT, "wine"),
            result("Proof", ALCOHOL, "pass", "Proof not applicable for this beverage type.",
                   None, label, app),
        )
        .when(
            (label == "") & (app != ""),
            out("Proof present", "needs_review",
                "Proof not found on label but specified in application."),
        )
        .when((app == "") | (label == app), out("Proof", "pass", "Proof present and matches."))
        .when(
            X.ocr_numeric(label) == X.ocr_numeric(app),
            out("Proof matches", "pass",
                F.concat(F.lit("Proof matches after OCR normalization ("), label, F.lit(" ≈ "),
                         app, F.lit(")."))),
        )
        .otherwise(out("Proof matches", "needs_review", differs))
    )


def consistency_rule(cfg: RuleConfig) -> Column:
    col = F.col
    label_proof = abv_float(col("l_proof"))
    gap = F.abs(label_proof - col("label_abv") * 2)
    box = col("proof.bbox")
    return F.when(
        gap > cfg.proof_tolerance,
        result(
            "Proof/ABV consistency", ALCOHOL, "needs_review",
            F.concat(F.lit("Proof ("), col("l_proof"), F.lit(") does not equal 2× ABV ("),
                     col("l_alcohol_pct"), F.lit("%). Expected proof ≈ "),
                     F.rint(col("label_abv") * 2).cast("bigint").cast("string"), F.lit(".")),
            box, col("l_proof"), "proof = 2 × ABV",
        ),
    ).when(
        gap.isNotNull(),
        result("Proof/ABV consistency", ALCOHOL, "pass",
               "Proof and ABV are consistent (proof = 2 × ABV).", box, col("l_proof"),
               col("a_proof")),
    )


def net_rules(cfg: RuleConfig) -> list[Column]:
    """Presence or plain pass, standard of fill, and match: two may apply at once."""
    col = F.col
    label, app, box = col("l_net_contents"), col("a_net_contents"), col("net_contents.bbox")
    mixed = col("c_net_contents")
    ml, app_ml = col("label_ml"), col("app_ml")

    def out(rule_id, status, message):
        return result(rule_id, ALCOHOL, status, message, box, label, app)

    known = (label != "") & (app != "")
    unusual = F.coalesce(
        ~col("bev").isin(*MALT) & ~ml.isin(*cfg.standard_of_fill_ml), F.lit(False)
    ) if cfg.standard_of_fill_ml else F.lit(False)
    off = F.coalesce(F.abs(app_ml - ml) > cfg.net_tolerance_ml, F.lit(False))
    hint = F.when(mixed, f"{MISREAD}, verify manually").otherwise("")
    first = (
        F.when(label == "", out("Net contents present", "fail",
                                "Net contents not found on label."))
        .when(app == "", out("Net contents present", "needs_review",
                             "Net contents found on label — add to application for "
                             "verification."))
        .when(unusual, out("Net contents standard of fill", "needs_review",
                           F.concat(F.lit("Net contents '"), label,
                                    F.lit("' is not a TTB authorized standard of fill."))))
        .when(~off, out("Net contents", "pass",
                        F.concat(F.lit("Net contents found: "), label, F.lit("."))))
    )
    mismatch = F.when(
        known & off,
        out("Net contents matches", "needs_review",
            F.concat(F.lit("Net contents on label ("), label, F.lit(" ≈ "), ml.cast("string"),
                     F.lit(" mL) does not match application ("), app, F.lit(" ≈ "),
                     app_ml.cast("string"), F.lit(" mL)"), hint, F.lit("."))),
    )
    return [first, mismatch]


# --- warning ----------------------------------------------------------------------


def all_words_present(words: Column, required: str) -> Column:
    """Every required word as often as required; long words may be two edits off."""
    def near(w):
        def test(e):
            if len(w) < 5:
                return e == w
            return (e == w) | ((F.length(e) >= 4) & (F.levenshtein(e, F.lit(w), 2) >= 0))
        return test

    tests = [
        F.size(F.filter(words, near(w))) >= n for w, n in X.word_counts(required).items()
    ]
    out = F.lit(True)
    for t in tests:
        out = F.when(out, t).otherwise(False)
    return out


def phrase_within_gap(words: Column, phrase: str, max_gap: int = 2) -> Column:
    """Phrase words in order from the start of the text, at most ``max_gap`` words apart.

    The first word, too, has to be among the first ``max_gap + 1``, as in the
    reference.
    """
    reach = F.lit(0)
    ok = F.lit(True)
    for w in phrase.split():
        at = F.array_position(F.slice(words, reach + 1, F.lit(max_gap + 1)), w).cast("int")
        ok = ok & (at > 0)
        reach = reach + at
    return ok


def caps_rule() -> Column:
    col = F.col
    box = col("government_warning.bbox")
    found = F.contains(F.upper("statement"), F.lit("GOVERNMENT WARNING"))
    return F.when(
        found,
        result("GOVERNMENT WARNING in caps", WARNING, "pass",
               "GOVERNMENT WARNING appears in required form.", box, "GOVERNMENT WARNING",
               "GOVERNMENT WARNING"),
    ).otherwise(
        result("GOVERNMENT WARNING in caps", WARNING, "fail",
               "The phrase 'GOVERNMENT WARNING' must appear in all caps.", box,
               F.left("statement", F.lit(60)), "GOVERNMENT WARNING")
    )


def extra_words(words: Column, required: str) -> Column:
    """Distinct label words the required text does not have, sorted."""
    need = F.array(*[F.lit(w) for w in sorted(X.word_counts(required))])
    return F.array_sort(F.array_except(words, need))


def display_statement(cfg: RuleConfig) -> Column:
    """Statement as shown: suspicious words dropped, misread words replaced."""
    required = required_norm(cfg)
    shown = X.fix_hyphenation(X.drop_tokens(F.col("statement"), F.col("suspicious")))
    if required:
        shown = X.correct_words(shown, list(X.word_counts(required)))
    return X.collapse_warning(shown)


def required_norm(cfg: RuleConfig) -> str:
    """Required wording, read the same way as the label's statement."""
    return X.statement_norm_of(cfg.required_statement)


@built_once
def exact_wording(cfg: RuleConfig) -> Column:
    """The statement contains the required wording or is a long enough start of it."""
    text, need = F.col("statement_norm"), F.lit(required_norm(cfg))
    if not required_norm(cfg):
        return F.lit(True)
    return F.contains(text, need) | ((F.length(text) >= 50) & F.startswith(need, text))


@built_once
def wording_evidence(cfg: RuleConfig) -> dict[str, Column]:
    """What the wording rule cites; the word tests only where the wording is not exact."""
    words, need = F.col("statement_words"), required_norm(cfg)
    return {
        "shown": display_statement(cfg),
        "words_present": F.when(~F.col("exact"), all_words_present(words, need)),
        "extra": F.when(~F.col("exact"), extra_words(words, need)),
    }


@built_once
def age_snippet() -> Column:
    low = F.col("low")
    return F.coalesce(
        X.snippet(low, AGED, 10, 30), X.snippet(low, YEARS, 15, 5),
        X.snippet(low, AGE_STATEMENT, 0, 20),
    )


def wording_rule(cfg: RuleConfig) -> Column:
    col = F.col
    box, text, words = col("government_warning.bbox"), col("statement_norm"), col("statement_words")
    required = " ".join(cfg.required_statement.split())
    suspicious = F.array_sort(col("suspicious"))

    def out(status, message, app=required):
        return result("Exact warning wording", WARNING, status, message, box, col("shown"), app)

    complete = "Warning statement present and appears complete."
    if not required:
        return out("pass", complete, "Required statement")
    def has(*phrases):
        test = F.lit(True)
        for p in phrases:
            test = test & F.contains(text, F.lit(p))
        return test

    first = has("(1)", "SURGEON GENERAL", "ACCORDING TO THE")
    second = has("(2)", "IMPAIRS", "OPERATE MACHINERY", "HEALTH PROBLEMS")
    present, extra = col("words_present"), col("extra")
    in_order = phrase_within_gap(words, "BIRTH DEFECTS") & phrase_within_gap(
        words, "HEALTH PROBLEMS"
    )
    capitals = col("statement").rlike(r"(?U)\bS(?:urgeon|URGEON)\b") & col("statement").rlike(
        r"(?U)\bG(?:eneral|ENERAL)\b"
    )

    def listed(values):
        return F.array_join(F.slice(values, 1, 5), ", ")

    quoted = F.transform(F.slice(extra, 1, 5), lambda w: F.concat(F.lit("'"), w, F.lit("'")))
    reasons = F.array_compact(
        F.array(
            F.when(~present, "missing required words"),
            F.when(F.size(extra) > 0,
                   F.concat(F.lit("extra words: ["), F.array_join(quoted, ", "), F.lit("]"))),
            F.when(F.size(suspicious) > 0,
                   F.concat(F.lit("suspicious tokens (likely OCR errors): "),
                            listed(suspicious))),
            F.when(~in_order, "critical phrases (BIRTH DEFECTS, HEALTH PROBLEMS) out of order "
                              "or too far apart"),
            F.when(~capitals, "Surgeon General not capitalized"),
        )
    )
    return (
        F.when(col("exact"), out("pass", complete))
        .when(F.length(text) < 50, out("fail", "Warning text appears incomplete or incorrect."))
        .when(
            first & second & present & (F.size(extra) == 0) & in_order & capitals,
            out("pass", "All required words present, no extra words, Surgeon General "
                        "capitalized."),
        )
        .when(
            first & second,
            out("needs_review",
                F.concat(F.lit("Key phrases present but: "), F.array_join(reasons, "; "),
                         F.lit("."))),
        )
        .when(
            first | second,
            out("needs_review",
                F.concat(F.lit("Only one statement found; both (1) and (2) required. "
                               "Missing: "),
                         F.when(~second, "statement (2)").otherwise("statement (1)"),
                         F.lit("."))),
        )
        .otherwise(
            out("needs_review",
                F.concat(
                    F.lit("Warning text may not match required wording exactly."),
                    F.when(F.size(suspicious) > 0,
                           F.concat(F.lit(" Suspicious tokens (likely OCR errors): "),
                                    listed(suspicious), F.lit("."))).otherwise(""),
                ))
        )
    )


def warning_rules(cfg: RuleConfig) -> list[Column]:
    col = F.col
    found = col("statement") != ""
    missing = F.when(
        ~found,
        result("Government warning present", WARNING, "fail",
               "Government warning statement not found on label.",
               col("government_warning.bbox"), "", "Required"),
    )
    return [missing, F.when(found, caps_rule()), F.when(found, wording_rule(cfg))]


# --- origin -----------------------------------------------------------------------


def bottler_rule(cfg: RuleConfig) -> Column:
    col = F.col
    label, app, box = col("l_bottler"), col("a_bottler"), col("bottler.bbox")
    mixed = col("c_bottler")
    score, reason = col("m_bottler.score"), col("m_bottler.reason")
    statement = "Bottler/producer statement"
    in_text = "Bottler/producer found on label (tokens in full text)."
    absent = result(statement, ORIGIN, "fail",
                    "Bottler/producer name and address not found on label.", box, "", app)
    no_label = (
        F.when(app == "", absent)
        .when(col("t_bottler"), result(statement, ORIGIN, "pass", in_text, box, "", app, True))
        .when(
            score >= cfg.bottler_same_as_brand,
            result(statement, ORIGIN, "needs_review",
                   "Bottler same as brand (no separate bottler line); verify on label.", box,
                   "", app),
        )
        .otherwise(absent)
    )
    hint = F.when(mixed, MISREAD).otherwise("")
    return (
        F.when(label == "", no_label)
        .when(
            app == "",
            result(statement, ORIGIN, "needs_review",
                   "Bottler/producer found on label — add to application for verification.",
                   box, label, app),
        )
        .when(
            score >= cfg.bottler_pass,
            result(statement, ORIGIN, "pass",
                   F.concat(F.lit("Bottler/producer matches ("), reason, F.lit(").")), box,
                   label, app),
        )
        .when(col("t_bottler"),
              result(statement, ORIGIN, "pass", in_text, box, label, app, True))
        .when(
            score >= 0.60,
            result("Bottler matches", ORIGIN, "needs_review",
                   F.concat(F.lit("Bottler on label may not match application ("), reason,
                            F.lit(", "), percent(score), F.lit(").")), box, label, app),
        )
        .otherwise(
            result("Bottler matches", ORIGIN, "needs_review",
                   F.concat(F.lit("Bottler on label differs from application ("),
                            percent(score), F.lit(")"), hint, F.lit(".")), box, label, app)
        )
    )


def address_rule() -> Column:
    col = F.col
    label, city, state = col("l_bottler"), col("a_city"), col("a_state")
    low = F.lower(label)

    def missing(kind, value):
        return F.when(
            (value != "") & ~F.contains(low, F.lower(value)),
            F.concat(F.lit(f"{kind} '"), value, F.lit("'")),
        )

    absent = F.array_compact(F.array(missing("city", city), missing("state", state)))
    wanted = F.concat_ws(", ", city, state)
    return F.when(
        (label != "") & ((city != "") | (state != "")),
        F.when(
            F.size(absent) > 0,
            result("Bottler address", ORIGIN, "needs_review",
                   F.concat(F.lit("Bottler "), F.array_join(absent, ", "),
                            F.lit(" not found on label.")),
                   col("bottler.bbox"), label, wanted),
        ).otherwise(
            result("Bottler address", ORIGIN, "pass", "Bottler city/state found on label.",
                   col("bottler.bbox"), label, wanted)
        ),
    )


def country_rule(cfg: RuleConfig) -> Column:
    col = F.col
    label, app, box = col("l_country_of_origin"), col("a_country_of_origin"), col(
        "country_of_origin.bbox"
    )
    mixed = col("c_country_of_origin")
    apart = ~F.contains(F.lower(label), F.lower(app)) & ~F.contains(F.lower(app), F.lower(label))

    def out(rule_id, status, *message):
        return result(rule_id, ORIGIN, status, F.concat(*[lit(m) for m in message]), box,
                      label, app)

    differs = (
        F.when(
            mixed,
            out("Country of origin matches", "needs_review", "Country on label '", label,
                "' differs from application '", app, f"'{MISREAD}, verify manually."),
        )
        .when(
            X.ocr_text(label) == X.ocr_text(app),
            out("Country of origin", "pass",
                "Country of origin matches after OCR normalization: ", label, "."),
        )
        .otherwise(
            out("Country of origin matches", "needs_review", "Country on label '", label,
                "' may not match application '", app, "'.")
        )
    )
    return F.when(
        col("f_imported"),
        F.when(label == "", out("Country of origin", "fail",
                                "Imported product must show country of origin."))
        .when(app == "", out("Country of origin", "needs_review",
                             "Country of origin found on label — add to application for "
                             "verification."))
        .when(apart, differs)
        .otherwise(out("Country of origin", "pass", "Country of origin found: ", label, ".")),
    )


# --- other statements ---------------------------------------------------------------


def statement_rule(rule_id: str, required: Column, found: Column, subject: str,
                   missing: str, shown: str = "Found") -> Column:
    return F.when(
        required,
        result(
            rule_id, OTHER, F.when(found, "pass").otherwise("fail"),
            F.when(found, f"{subject} found.").otherwise(missing), None,
            F.when(found, shown).otherwise(""), "Required",
        ),
    )


def other_rules(cfg: RuleConfig) -> list[Column]:
    col = F.col
    low, bev = col("low"), col("bev")
    spirits, wine, malt = bev.isin(*SPIRITS), bev == "wine", bev.isin(*MALT)

    def text_has(*phrases):
        test = F.lit(False)
        for p in phrases:
            test = test | F.contains(low, F.lit(p))
        return test

    def inferred(name):
        return F.array_contains("inferred", name)

    whisky = spirits & F.lower("class_name").rlike("whiskey|whisky")
    unknown = col("age_known").isNull()
    age_required = F.when(
        whisky,
        col("f_age_statement_required") | unknown
        | F.coalesce(col("age_known") < cfg.whisky_age_years, F.lit(False)),
    ).otherwise(col("f_age_statement_required"))
    age_text = col("age_text")
    age_message = F.concat(
        F.when(age_text.isNotNull(), "Age statement found.").otherwise(
            "Age statement required but not found."
        ),
        F.when(whisky & unknown,
               " (27 CFR 5.40(a): required for whisky aged < 4 years.)").otherwise(""),
    )
    age = F.when(
        age_required,
        result("Age statement", OTHER, F.when(age_text.isNotNull(), "pass").otherwise("fail"),
               age_message, None, F.coalesce(age_text, F.lit("")), "Required"),
    )
    region = low.rlike("appellation|napa|sonoma|willamette|paso robles|american viticultural")
    appellation = F.when(
        wine & col("f_appellation_required"),
        result("Appellation of origin", OTHER, F.when(region, "pass").otherwise("needs_review"),
               F.when(region, "Appellation of origin found.").otherwise(
                   "Appellation of origin may be required. Verify."),
               None, F.when(region, "Found").otherwise(""), "Required"),
    )
    named = col("l_class_type") != ""
    varietal = F.when(
        wine & col("f_varietal_required"),
        result("Varietal designation", OTHER, F.when(named, "pass").otherwise("needs_review"),
               F.when(named, F.concat(F.lit("Varietal designation found: "),
                                      col("l_class_type"), F.lit("."))).otherwise(
                   "Varietal designation expected but not detected."),
               F.when(named, col("class_type.bbox")), col("l_class_type"), "Required"),
    )
    return [
        statement_rule(
            "Sulfites statement",
            col("f_sulfites_required") | (wine & F.lit(cfg.sulfites_default_wine)),
            text_has("sulfite"), "Sulfites statement",
            "Sulfites declaration required but not found.", "Contains Sulfites"),
        statement_rule(
            "FD&C Yellow No. 5", col("f_fd_c_yellow_5_required"),
            text_has("yellow") & text_has("5"), "FD&C Yellow No. 5 statement",
            "FD&C Yellow No. 5 statement required but not found."),
        statement_rule(
            "Cochineal/Carmine statement", col("f_carmine_required"),
            text_has("carmine", "cochineal"), "Cochineal/Carmine declaration",
            "Cochineal/Carmine disclosure required but not found."),
        statement_rule(
            "Wood treatment",
            spirits & (col("f_wood_treatment_required") | inferred("wood_treatment")),
            text_has("treated", "wood"), "Wood treatment statement",
            "Wood treatment statement required but not found."),
        age,
        statement_rule(
            "Neutral spirits / commodity",
            spirits & (col("f_neutral_spirits_required") | inferred("neutral_spirits")),
            text_has("neutral spirits", "grain spirits"),
            "Neutral spirits / commodity statement",
            "Neutral spirits statement required but not found."),
        statement_rule(
            "Aspartame statement", malt & col("f_aspartame_required"),
            text_has("aspartame", "phenylketonurics"), "Aspartame statement",
            "Aspartame statement required but not found."),
        appellation,
        varietal,
    ]


# --- the whole rule set ---------------------------------------------------------------


#: Categories of rules, in the order of their results.
CATEGORIES = ("Identity", "Alcohol & contents", "Warning", "Origin", "Other")

#: Extracted fields that the rules of a category read, where not all; the text of the label comes with any.
#: A field that is left out raises an error if a rule reads it after all.
READS = {OTHER: ("class_type",)}


@built_once
def rule_array(cfg: RuleConfig = DEFAULT, categories: tuple[str, ...] = CATEGORIES) -> Column:
    """Results of one row in the fixed category order, only of the categories asked for."""
    groups = {
        "Identity": lambda: [
            identity_rule("brand_name", "brand", "Brand name", cfg),
            identity_rule("class_type", "class", "Class/type", cfg),
        ],
        "Alcohol & contents": lambda: [abv_rule(cfg), proof_rule(cfg), consistency_rule(cfg), *net_rules(cfg)],
        "Warning": lambda: warning_rules(cfg),
        "Origin": lambda: [bottler_rule(cfg), address_rule(), country_rule(cfg)],
        "Other": lambda: other_rules(cfg),
    }
    rules = [r for c in CATEGORIES if c in categories for r in groups[c]()]
    return F.array_compact(F.array(*[F.coalesce(r, no_result()) for r in rules]))


APP_RENAMES = {
    "brand_name": "brand_name_app", "class_type": "class_type_app",
    "alcohol_pct": "alcohol_pct_app", "proof": "proof_app",
    "country_of_origin": "country_of_origin_app",
}


def as_application_side(applications: DataFrame) -> DataFrame:
    """Application columns under names that do not clash with the extracted fields."""
    return applications.withColumnsRenamed(APP_RENAMES)


def run_rules(
    matched: DataFrame, cfg: RuleConfig = DEFAULT, categories: tuple[str, ...] = CATEGORIES
) -> DataFrame:
    """Add ``results``, of some categories or all, to rows that hold an application and the extracted fields."""
    keep = [F.col(c) for c in matched.columns]
    # A generator of one row: filters on keys go below it, filters on the results stay
    # above, so the rule expressions are not copied into them.
    results = F.explode(F.array(rule_array(cfg, categories)))
    return rule_inputs(matched, cfg).select(*keep, results.alias("results"))


def explode_results(checked: DataFrame, *keys: str) -> DataFrame:
    """Long table ``rule_results``: one row per rule, numbered from 0."""
    # The identity lambda keeps the optimizer from splitting the large result
    # expressions into one copy per field of the struct.
    rows = F.transform("results", lambda r: r)
    return checked.select(
        *(keys or ("label_id",)), F.posexplode(rows).alias("rule_seq", "r")
    ).select(*(keys or ("label_id",)), "rule_seq", "r.*")
