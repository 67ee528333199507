"""Corpus pipeline: raw documents to packed training sequences.

``STAGES`` are applied in order; each stage's result is written as Parquet and read back as
the next stage's documents, so a stage works on exactly what its predecessor kept. All
stages but the last return rows of ``documents`` with its columns; the last returns the
pieces of the packed sequences.

Defined results: a stage keeps or drops whole rows. Null and empty texts are classified like any
text; those kept are exact copies of each other, of which one row stays, hold no shingle and no
benchmark item, and give one end token. Repeated rows are exact copies; rows without an id, or
with an id of several texts, are documents of their own. Very long texts are read whole by every
stage. Extra columns are carried along, whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pertlake.llm import decontamination, exact_dedup, ngram_join, packing, quality
from pertlake.llm.common import materialize
from pertlake.sources.tables import read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (learned from ``labels``) doesn't reject."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the largest doc_id."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, placed in sequences."""
    return packing.pack_documents(spark, docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

# a trained classifier and a tokenizer: not expressible in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
