"""Corpus preparation: language, near-duplicates, repeated passages, personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and is written as Parquet and read again before the next. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.llm import language, packing, privacy, simhash, substrings
from riskgrid.llm.common import drop, stored, temporary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null, without letters, or within the reject margin. Rows are judged one by one, whatever their ids."""
    return language.known(docs.select(*COLUMNS))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: that with the smallest doc_id (a null one last)."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that a document with a smaller doc_id also has; other texts stay as they are."""
    return substrings.strip_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets."""
    return privacy.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("repeated_passages", without_repeats),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Compression, XXH64 fingerprints, boosted trees and byte-level BPE have no SQL; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table of ``sf_dir``; a stage's own tables are deleted once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary():
            out = stored(stage(spark, docs, sf_dir), name, outer=True)
        drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
