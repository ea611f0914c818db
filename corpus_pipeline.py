"""From raw documents to packed training sequences: four stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads what it returned from Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import packing, ppm, simhash, substring
from lattica.llm.common import materialize
from lattica.llm.queries import WORD_BPE


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that no language takes go: those without letters, and those without a clear best language."""
    return ppm.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by nearly equal fingerprints, that with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that also start elsewhere leave their texts; documents stay."""
    return substring.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("pack", pack)]

#: Language models and tokens can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
