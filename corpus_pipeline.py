"""A corpus pipeline: toxicity, near duplicates, source mixing, packing. Each stage's rows are written and read again.

Stages handle nulls in any column, empty and very long texts, repeated rows, empty tables and further columns as the
operators that they call say; all but the last return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import mixing, packing, simhash, toxicity
from brindle.llm.common import written

#: The share of the words that mixing keeps.
MIX_SHARE = 0.9


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go; it learns from all labelled rows that are not held out."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources get tempered shares of the words; no document comes twice."""
    return mixing.mix(docs, [mixing.domain(F.col("source")), F.col("lang"), F.col("source")], MIX_SHARE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row for each piece of a document, with its ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", detoxify), ("simhash near-dedup", dedup), ("source mixing", mix), ("best-fit packing", pack)]
#: A trained network, seeded epochs and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir), "stage")
    return STAGES[-1][1](spark, rows, sf_dir)
