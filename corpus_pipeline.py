"""Preparing a corpus: five stages, each an operator of ``vecbank.llm`` applied to what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecbank.llm import exact_dedup, near_dedup, packing, quality, suffix_dedup
from vecbank.session import materialize, table

NEAR_WORDS, NEAR_SIMILARITY = 5, 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, does not reject."""
    network = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, network, "__score", "__predicted").filter("__predicted = 1").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that of the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row with the smallest doc_id."""
    return near_dedup.without_near_duplicates(docs, NEAR_WORDS, NEAR_SIMILARITY)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that occur more than once; emptied documents stay as empty rows."""
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids and places in sequences of 1024."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality_classifier", classify),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("suffix_array_dedup", repeats),
    ("best_fit_packing", packed),
]

#: SQL cannot express the trained classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
