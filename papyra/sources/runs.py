"""Folders of topic runs: parameters, topics and measures, some of them optional."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions import text as X

# What a run's files hold, and the parameters of runs from before they were written down.
META = "source string, granularite string, k int, n_docs long, n_tokens long, iterations int, graine int, optimisation int, burn_in int, longueur_min int, freq_min int, duree_s double"
TOPICS = "topic_id int, top_words string, size long"
METRICS = "npmi struct<npmi_mean:double>, diversity struct<diversity:double,tokens_distincts:long>, entropy struct<entropy_normalized:double>"
DEFAULTS = {"granularite": "bloc", "longueur_min": 2, "freq_min": 0, "optimisation": 0}
#: Measures by falling priority; the coherence of the last one overrides.
MEASURES, OVERRIDE = ("metrics_ref.json", "metrics.json"), "metrics_brut.json"


def _read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """(run, ...) of one file of each run folder; runs without it have no row."""
    run = F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run")
    raw = spark.read.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").json(path, multiLine=True)
    return raw.select(run, "*")


def topics(spark: SparkSession, path: str) -> DataFrame:
    """(run, topic_id, top_words, size) of all runs below a folder."""
    return _read(spark, path, "topics.json", TOPICS).select("run", "topic_id", F.filter(F.split(F.coalesce("top_words", F.lit("")), " "), lambda w: w != "").alias("top_words"), F.coalesce("size", F.lit(0)).alias("size"))


def recap(spark: SparkSession, path: str, min_docs: int = 0) -> DataFrame:
    """One row a run that has parameters and ``min_docs`` documents, in the order of its six keys (``pos``).

    Noise topics, the ratio of the largest to the smallest topic (null if that is
    empty), and measures; coherence is the override's where there is one.
    """
    meta = _read(spark, path, "meta.json", META)
    meta = meta.select("run", *(F.coalesce(c, F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in meta.columns if c != "run"))
    noisy = X.is_noise(F.col("top_words"))
    per = topics(spark, path).groupBy("run").agg(
        F.count_if(noisy).alias("noise_topics"), F.coalesce(F.sum(F.when(noisy, F.col("size"))), F.lit(0)).alias("noise_docs"),
        F.bround(F.max("size") / F.nullif(F.min("size"), F.lit(0)), 1).alias("ratio"),
    )
    found = None
    for rank, name in enumerate(MEASURES):
        one = _read(spark, path, name, METRICS).withColumn("_rank", F.lit(rank))
        found = one if found is None else found.union(one)
    best = found.groupBy("run").agg(F.min_by(F.struct("npmi", "diversity", "entropy"), "_rank").alias("m"))
    over = _read(spark, path, OVERRIDE, METRICS).select("run", F.col("npmi.npmi_mean").alias("over"))
    rows = meta.where(F.coalesce("n_docs", F.lit(0)) >= min_docs).join(per, "run", "left").join(best, "run", "left").join(over, "run", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    pos = F.row_number().over(Window.orderBy("granularite", "source", "freq_min", "optimisation", zero("k"), zero("graine"), "run"))  # as many rows as runs
    return rows.select(
        pos.alias("pos"), *meta.columns, "noise_topics", "noise_docs", "ratio", F.bround(F.coalesce("over", "m.npmi.npmi_mean"), 4).alias("npmi"),
        F.col("m.diversity.diversity").alias("diversity"), F.bround("m.entropy.entropy_normalized", 4).alias("entropy"), F.col("m.diversity.tokens_distincts").alias("vocabulary"),
    )


def folders(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """(run) of the folders that have parameters, but those that a pattern excludes."""
    found = _read(spark, path, "meta.json", "k int").select("run").distinct()
    return found.where(~F.col("run").rlike(without)) if without else found


def pick(spark: SparkSession, path: str, last: bool = True, without: str | None = None) -> str | None:
    """The first or last run folder by name."""
    return folders(spark, path, without).agg((F.max if last else F.min)("run")).first()[0]
