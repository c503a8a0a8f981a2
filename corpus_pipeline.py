"""From raw documents to packed sequences: good texts, one of each group of copies, without repeated passages or benchmark text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm import decontaminate, neardup, packing, quality, suffixes
from pagequarry.llm.common import table
from pagequarry.session import settle


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return neardup.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes and more that a document with a smaller id has."""
    return suffixes.cut_repeats(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("quality", good_texts), ("near_duplicates", first_copies), ("repeated_bytes", without_repeats),
    ("benchmark", uncontaminated), ("packing", packed)
]

#: SQL cannot express the classifier, the similarities or the tokenizer; tests hold each stage against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
