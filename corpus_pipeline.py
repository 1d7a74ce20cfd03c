"""Corpus pipeline: documents in, token ids of the mixed corpus out.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the
next stage's documents. All stages but the last return the columns of ``documents``. Defined results
for nulls, empty and repeated rows are those of each stage's operator; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cropwind.llm import jaccard_join, mixing, pieces, quality_rules, suffix_dedup
from cropwind.sources.paths import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked shingle sets."""
    return jaccard_join.stage(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that occur elsewhere."""
    return suffix_dedup.stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate takes it."""
    return mixing.stage(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids`` of each document of the mix."""
    return pieces.stage(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding", tokens),
]

#: Suffix sorting, set joins and tokenising are no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
