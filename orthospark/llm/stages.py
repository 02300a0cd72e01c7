"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what the next one reads.

All but the last return the columns of ``docs``, whatever these are named. Rows with a null doc_id pass through unchanged until packing, which leaves
them out. Repeated rows are treated alike. Two texts under one id are cut each for itself by the benchmark stage; toxicity and near dedup go by the id. An empty
table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import _tokenizers, decontaminate, line_dedup, minhash_dedup, packing, toxicity
from ._tables import table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; a null text is scored as an empty one."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that repeat earlier ones go from the texts; null and empty texts stay as they are."""
    return line_dedup.remove(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; texts without words are all kept."""
    return minhash_dedup.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts, and documents that mostly are such; null and empty texts stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training sequences; a null or empty text is its end token alone."""
    return packing.pack(docs, _tokenizers.byte_bpe())


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("pack", packed),
]
