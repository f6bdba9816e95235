"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; :func:`run` writes it as Parquet and rereads it as the
next one's docs.  All but the last return the columns of ``docs``.

Every stage takes nulls in any column, empty and very long texts, ties,
repeated rows, extra columns and empty tables; what it does with them stands in
its operator's docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from growthspark.llm import exact_dedup, packing, quality, simhash
from growthspark.llm.common import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 1) does not reject: score >= 0.3.

    It learns from the labels of the documents that stand in ``docs``; null and
    empty texts are scored like any other.  Repeated rows stay or go together.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal without white space (operator 9)."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group (operator 6): 3-word shingles, links at 2 or fewer bits."""
    return simhash.keep_one(docs, words_per=3, max_bits=2)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens (operator 8)."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("packing", pack_documents),
]

# tokens, SimHash and the classifier have no SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
