"""The corpus pipeline: five stages that each call one training-data operator.

``run`` applies them to ``documents``. All stages but the last return the columns they were
given, whatever those are called, and treat rows alike: repeated rows stay or go together
(near-copy removal keeps one of them), long texts are read whole, an empty table gives an
empty one. A stage's result is written to the folder in
``spark.checkpoint.dir`` and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, decontam, language_id, secret_scan, simhash
from graphloom.llm.common import materialize
from graphloom.llm.queries import vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier rejects go: null texts, texts without letters, narrow margins.

    A null id is kept as it is and not learned from; a null lang is not learned from.
    """
    return language_id.keep_identified(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id, a null id only if there is no other.

    Ties of ids are settled by the text's hash. Null texts and texts without words are one group.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a whole 13-word window of a benchmark text, or a twentieth of their words in windows, go.

    Null and empty texts stay; a benchmark item without words or id removes nothing.
    """
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a rule finds a secret go; null and empty texts stay."""
    return secret_scan.remove_leaks(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, with the ids themselves; a null text has none. A row for each row."""
    return bpe.encode(docs.select("doc_id", "text"), vocabulary_path(), ids=True)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", remove_near_copies),
    ("decontamination", decontaminate),
    ("secret_scan", remove_secrets),
    ("bpe", encode_tokens),
]
#: SQL can express neither the classifier nor the fingerprints: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
