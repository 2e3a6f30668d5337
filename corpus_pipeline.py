"""Cleaning of a corpus in stages; each works on all documents that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm.decontamination import clean_documents
from shelfmark.llm.jaccard_join import one_of_each_group
from shelfmark.llm.pieces import piece_codes
from shelfmark.llm.quality_rules import good_documents
from shelfmark.llm.queries import table, tokenizer_path
from shelfmark.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified rules reject go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word runs, Jaccard similarity of 0.8 or more.

    A link at the very threshold has a chance of one in a billion to share no band."""
    return one_of_each_group(docs, width=5, num=80, den=100, miss=1e-9)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start elsewhere too are cut from all texts."""
    cleaned = without_repeats(docs, width=200)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cleaned


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which ten words of a benchmark item, or a whole shorter one, occur go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return piece_codes(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("suffix_array_dedup", repeated_bytes),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", encode),
]

#: Cutting bytes and tokenizing have no form in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
