"""The registered queries ``opN_<name>``: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, mixing, packing, pitman_yor, simhash, token_count, topk, toxicity, warc, wavelet
from .common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record for every page, read the archives back, and give each page's digest."""
    return warc.digests(warc.read(warc.write(_table(spark, sf_dir, "pages"))))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    packed = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op3_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document, learning from those that are not held out."""
    return pitman_yor.score(documents(spark, sf_dir))


def op4_stable_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product for every twentieth id."""
    return ann.search(_table(spark, sf_dir, "embeddings"), every=20, k=20)


#: Of the query op5: weights of the domains; other nodes weigh as their size tempers.
MIX_WEIGHTS = {("domain0",): 4.0, ("domain1",): 2.0, ("domain2",): 1.0, ("domain3",): 1.0}


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix the documents by domain, language and source to 80 % of their words, in up to 2 epochs."""
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", "lang", "source", "text")
    levels = [mixing.domain(F.col("source")), F.col("lang"), F.col("source")]
    mixed = mixing.mix(rows, levels, 0.8, MIX_WEIGHTS, epochs=2, epoch_column="epoch")
    return mixed.select("doc_id", "epoch", mixing.domain(F.col("source")).alias("domain"), "lang", "source", mixing.words(F.col("text")).alias("n_words"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count the tokens of every document."""
    return token_count.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products for every fiftieth id."""
    return topk.search(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document."""
    return toxicity.toxicity(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and name its group of near duplicates."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids into shards of wavelet matrices and read them back."""
    manifest = wavelet.write_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {}
