"""Registered queries of this folder: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark.llm.binary import packed_matrices, packed_pieces
from labelspark.llm.chat import chat_digests, with_odd_conversation
from labelspark.llm.divergence import source_divergence
from labelspark.llm.exact import exact_duplicates
from labelspark.llm.footrule import nearest_vectors
from labelspark.llm.jaccard import similar_rows
from labelspark.llm.langid import fit_languages, identify
from labelspark.llm.maglev import assign_shards
from labelspark.llm.negatives import hard_negatives, quantised
from labelspark.llm.pack import pack
from labelspark.llm.paragraphs import repeated_paragraphs
from labelspark.llm.stored import read_table
from labelspark.llm.toxicity import fit_toxicity, toxicity_scores
from labelspark.llm.winnow import contamination


#: Tokens of a packed sequence, and the shards that documents are placed on.
SEQUENCE = 4096
SHARDS = tuple(f"shard-{i:03}" for i in range(64))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_rows(read_table(spark, sf_dir, "documents"), k=3, percent=90).drop("raw_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), SEQUENCE)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(with_odd_conversation(read_table(spark, sf_dir, "conversations")))


def op4_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(packed_matrices(read_table(spark, sf_dir, "documents"), SEQUENCE), SEQUENCE)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"), SHARDS)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents")).drop("raw_sha256")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return contamination(docs, items).drop("raw_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity_scores(docs, fit_toxicity(docs, labels))


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(read_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", quantised(F.col("embedding")).alias("embedding"), shifted.alias("label"))
    return hard_negatives(rows, positives=5, negatives=5, percent=80, every=100)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard_join, op2_packing, op3_chat_format, op4_binary_packing, op5_substring_dedup, op6_language_id,
        op7_sharding, op8_exact_dedup, op9_toxicity, op10_decontamination, op11_nearest_vectors, op12_hard_negatives,
        op13_source_divergence)
}
