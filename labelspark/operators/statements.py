"""Required-statement conformance of free texts and unknown-word screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions.text import (
    let, norm, statement_norm, upper_words, word_counts,
)

GRAM = 4
SHORT = 3


def _word_grams(text: Column) -> Column:
    """Distinct runs of ``GRAM`` words delimited by single spaces."""
    # ``let`` splits the text once, not once per run
    return let(
        F.split(text, " "),
        lambda ws: F.when(
            F.size(ws) >= GRAM,
            F.array_distinct(
                F.transform(
                    F.sequence(F.lit(0), F.size(ws) - GRAM),
                    lambda i: F.concat_ws(" ", *[F.get(ws, i + n) for n in range(GRAM)]),
                )
            ),
        ),
    )


def _char_grams(text: Column, n: int) -> Column:
    places = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(
        F.length(text) >= n,
        F.array_distinct(F.transform(places, lambda i: F.substr(text, i, F.lit(n)))),
    )


def find_passages(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id) where the whole passage occurs in the text.

    No text meets every passage. Inside a passage, words 2 to 5 stand between
    spaces, so a text that contains the passage has the same four words in a row.
    An equi-join on that run finds the candidates, and ``contains`` settles them on
    the whole texts. Passages of fewer than six words use their first characters
    instead; their lengths are looked up first, so the extra scan of the texts is
    made only when such passages exist.
    """
    wanted = passages.select(F.col("text").alias("passage")).filter(
        F.length("passage") > 0
    ).distinct()
    long_enough = F.size(F.split("passage", " ")) >= GRAM + 2
    anchors = wanted.filter(long_enough).select(
        "passage", F.array_join(F.slice(F.split("passage", " "), 2, GRAM), " ").alias("anchor")
    )
    grams = texts.select("doc_id", F.explode(_word_grams(F.col("text"))).alias("anchor"))
    candidates = grams.join(anchors, "anchor").select("doc_id", "passage")
    short = wanted.filter(~long_enough).withColumn(
        "n", F.least(F.length("passage"), F.lit(SHORT))
    )
    for row in short.select("n").distinct().collect():  # at most three lengths
        n = row["n"]
        keys = short.filter(F.col("n") == n).select(
            "passage", F.left("passage", F.lit(n)).alias("anchor")
        )
        pieces = texts.select("doc_id", F.explode(_char_grams(F.col("text"), n)).alias("anchor"))
        candidates = candidates.unionByName(
            pieces.join(keys, "anchor").select("doc_id", "passage")
        )
    found = (
        candidates.join(texts.select("doc_id", "text"), "doc_id")
        .filter(F.contains("text", F.col("passage")))
        .select("doc_id", "passage")
    )
    items = passages.select("item_id", F.col("text").alias("passage"))
    return found.join(items, "passage").select("doc_id", "item_id")


def word_multiset(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Upper-cased words per text with their counts."""
    return (
        texts.select(key, F.explode(upper_words(F.col(text))).alias("word"))
        .groupBy(key, "word")
        .agg(F.count("*").alias("n"))
    )


def unknown_words(counted: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words of two or more characters, not digits, that the lexicon does not know.

    The vocabulary is reduced first, so a word all texts share meets the lexicon
    once.
    """
    vocabulary = counted.select("word").distinct().filter(
        (F.length("word") >= 2) & ~F.col("word").rlike(r"^\d+$")
    )
    unknown = vocabulary.join(lexicon.select("word").distinct(), "word", "left_anti")
    return counted.join(unknown, "word")


def suspicious_words(labels: DataFrame, lexicon: DataFrame, required: str) -> DataFrame:
    """Label and its ``suspicious`` words: in its statement, but neither in the required
    wording nor in the lexicon."""
    statement = statement_norm(norm(F.col("government_warning.value")))
    counted = word_multiset(labels.select("label_id", statement.alias("s")), "label_id", "s")
    extra = counted.filter(~F.col("word").isin(*word_counts(required)))
    return unknown_words(extra, lexicon).groupBy("label_id").agg(
        F.array_sort(F.collect_set("word")).alias("suspicious")
    )
