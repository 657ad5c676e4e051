"""Driver queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, language_id, markov, mixing, repeats, sharding, simhash, tokens, toxicity

#: The vocabulary that tokens are counted in.
VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int, key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(4) == 2
    return language_id.predict(docs, language_id.fit(docs.where(~held_out)), held_out=held_out)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words are counted before the labels join, so that no text is shuffled
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words("text").alias("_size"), F.xxhash64("text").alias("_tie"))
    docs = mixing.quality_weights(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(docs, ["doc_id"], weight="_weight", size="_size", tie="_tie").select("doc_id", "size", "source_size", "target", "taken")


def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.score(table(spark, sf_dir, "documents"), fold(5) == 1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(5) != 0))
    return toxicity.score(docs, model, held_out=fold(5) == 0)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), ["doc_id"])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.flag(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "best_item", "best_score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_mix_sources, op3_hidden_markov, op4_toxicity, op5_shards, op6_simhash, op7_decontaminate, op8_nearest, op9_token_counts, op10_repeats)}

ORACLES = {"op2_mix_sources": mixing.ORACLE, "op5_shards": sharding.ORACLE}
