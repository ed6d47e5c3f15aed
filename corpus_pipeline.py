"""From documents to packed sequences: five stages, each of which calls one operator of ``mailspark.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All but the last return the
columns of ``documents``.  Null texts, empty tables, repeated rows and further columns
have the results that the operators' docstrings define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailspark.llm.common import drop_scratch, scratch, table
from mailspark.llm.line_dedup import drop_repeated_lines
from mailspark.llm.mixing import take
from mailspark.llm.packing import pack
from mailspark.llm.quality_classifier import drop_rejected
from mailspark.llm.queries import tokenizer_path
from mailspark.llm.simhash_dedup import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are near a line of an earlier document, or an earlier line, go."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return take(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", repeated_lines),
    ("simhash_dedup", near_duplicates),
    ("source_mixing", mixing),
    ("packing", packing),
]

#: Training a network and sampling are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_scratch(before)
    return STAGES[-1][1](spark, docs, sf_dir)
