"""Correction of misread statement words against a table of required wordings.

The nearest reference word within two edits is found by an equi-join: two words that close have
a form in common once up to two letters are left out of each. Words meet only where they share
such a form, and the edit distance settles what met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.functions.text import apply_casing, casing, let, upper_words

#: Edits a misreading may have, and letters a word and a reference word need at least.
EDITS, WORD_LETTERS, REFERENCE_LETTERS = 2, 4, 5


def wordings(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Table (wording, text) of required texts by name; any other table of that form will do."""
    return spark.createDataFrame(sorted(texts.items()), "wording string, text string")


def _without_one(word: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(word))
    return F.transform(places, lambda i: F.concat(F.left(word, i - 1), F.substr(word, i + 1)))


def shortened(word: Column) -> Column:
    """The word with none, one and two of its letters left out; for words of three letters or more."""
    return let(
        _without_one(word),
        lambda one: F.array_distinct(F.concat(F.array(word), one, F.flatten(F.transform(one, _without_one)))),
    )


def reference_words(statements: DataFrame) -> DataFrame:
    """(wording, reference): distinct upper-cased words of each required text."""
    return statements.select("wording", F.explode(F.array_distinct(upper_words(F.col("text")))).alias("reference"))


def corrections(vocabulary: DataFrame, statements: DataFrame) -> DataFrame:
    """(wording, word, replacement) of the misread words of `vocabulary` (wording, word).

    Words are upper-cased. A word of the wording itself, one of fewer than four letters and one
    that is two edits from no reference word of five or more letters have no row. The nearest
    reference word counts, of equally near ones the first by the alphabet.
    """
    references = reference_words(statements)
    words = vocabulary.select("wording", F.upper("word").alias("word")).distinct()
    known = references.select("wording", F.col("reference").alias("word"))
    long = references.where(F.length("reference") >= REFERENCE_LETTERS)
    longest = long.groupBy("wording").agg(F.max(F.length("reference")).alias("longest"))
    odd = (
        words.join(known, ["wording", "word"], "left_anti").join(longest, "wording")
        .where((F.length("word") >= WORD_LETTERS) & (F.length("word") <= F.col("longest") + EDITS))
    )
    left = odd.select("wording", "word", F.explode(shortened(F.col("word"))).alias("form"))
    right = long.select("wording", "reference", F.explode(shortened(F.col("reference"))).alias("form"))
    edits = F.levenshtein(F.col("word"), F.col("reference"), EDITS)
    near = left.join(right, ["wording", "form"]).select("wording", "word", "reference", edits.alias("edits")).where("edits >= 0")
    best = near.groupBy("wording", "word").agg(F.min(F.struct("edits", "reference")).alias("best"))
    return best.select("wording", "word", F.col("best.reference").alias("replacement"))


def corrected(texts: DataFrame, statements: DataFrame) -> DataFrame:
    """`texts` (label_id, wording, text) with `corrected`: misread words replaced, in the text's casing.

    Each distinct word meets a wording once, however many labels hold it; a label gets the few
    corrections of its own words. A text without a wording, or null, stays as it is.
    """
    held = texts.select("label_id", "wording", F.explode(F.array_distinct(upper_words(F.col("text")))).alias("word"))
    fixes = corrections(held.select("wording", "word"), statements)
    own = held.join(fixes, ["wording", "word"]).groupBy("label_id").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "replacement"))).alias("fixes")
    )
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"(?Us)\b\w+\b|\W+"), F.lit(0))
    replaced = let(
        casing(F.col("text")),
        lambda style: F.array_join(
            F.transform(
                pieces, lambda p: F.coalesce(apply_casing(F.try_element_at(F.col("fixes"), F.upper(p)), style), p)
            ), "",
        ),
    )
    return texts.join(own, "label_id", "left").withColumn(
        "corrected", F.when(F.col("fixes").isNull(), F.col("text")).otherwise(replaced)
    ).drop("fixes")
