"""Corpus pipeline: documents to token ids in five stages.

Every stage takes (spark, docs, sf_dir), reads all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read back for the next. Four stages filter and return
the columns of documents unchanged; the last encodes.

* language: texts without a letter are rejected (null and empty ones, too); the others are kept
  whatever their language, since a corpus in many languages is clean. So it is without a model,
  if no language is given to learn from.
* toxicity: documents predicted toxic are rejected.
* near_duplicates: one document of each group of near duplicates stays, the least id (five-word
  shingles, similarity 0.8 or more).
* decontamination: documents with a window of a benchmark item are rejected.
* bpe: doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of what is left.

Models are learned within a stage, from its own input. An empty table gives an empty result.
SQL cannot express the stages (trained models, byte-pair merges), so the pipeline has no oracle
and is tested against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from signbridge.llm import bpe, decontamination, language, near_duplicates, toxicity
from signbridge.llm.common import small_batches, stored, table

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language.keep_known(docs, language.fit(docs))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates.keep_one(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_leaks),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents to the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
