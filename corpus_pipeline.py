"""A corpus pipeline: quality rules, line dedup, near dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and is written as Parquet before the next one reads it.  All but the last
return the columns of ``documents``, which the input must have; other columns
are dropped, n_chars is counted anew.  Null and empty texts fail the quality
rules, so later stages meet neither; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.llm.common import materialise
from isobath.llm.decontamination import decontaminate
from isobath.llm.line_dedup import dedup_lines
from isobath.llm.near_dedup import dedup_near
from isobath.llm.packing import pack
from isobath.llm.quality_rules import score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents of their host share."""
    return _documents(score_quality(docs).filter("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that at least ten documents hold."""
    return _documents(dedup_lines(docs, min_docs=10, min_chars=1))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return _documents(dedup_near(docs, k=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with its own values or others."""
    return _documents(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]

#: Tokenisation and near-duplicate components have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
