"""A training corpus from ``documents``: five stages, each one operator of papyra.llm.

Every stage reads what its predecessor kept, as Parquet, and decides on whole
texts. SQL can't express the learned and the approximate stages, so there is no
ORACLE_SQL; tests/llm compares the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import decontaminate, mixing, sharding, simhash, store, toxicity

ORACLE_SQL = None


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model, learned from all labels, predicts toxic are dropped."""
    store.small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word Jaccard similarity 0.8 or more) the smallest id stays; rows without an id stay."""
    return simhash.one_of_each(docs)


def contaminated_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item's question and answer are found are dropped."""
    store.small_batches(spark)
    found = decontaminate.flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_items = 0").select(*docs.columns)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the last in a source's budget is cut to its words."""
    weighted = mixing.quality_weights(mixing.packed(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.materialise(mixing.mix(weighted, ["row"], weight="_weight", size="_size", tie="_tie"))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each row's shard."""
    return sharding.shard(docs, docs.columns)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("simhash near-dedup", near_duplicates_go),
    ("benchmark decontamination", contaminated_go),
    ("source mixing", sources_mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
