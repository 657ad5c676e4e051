"""Clashing names, repeated rows and skew through the operators that carry rows along."""

import collections

import pytest
from pyspark.sql import functions as F

from papyra.llm import mixing, sharding, store


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("skew", ["even", "weights", "one key", "equal rows"])
def test_the_boundary_of_a_mix_under_skew(spark, skew):
    n = 6000
    df = spark.range(n).select("id", F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 7).cast("int")), F.when(F.lit(skew != "equal rows"), F.col("id").cast("string")).otherwise(F.lit("x"))).alias("text"), F.when(F.col("id") % 3 > 0, "a").alias("source"))
    key = {"one key": F.lit(None).cast("long"), "equal rows": F.lit(7).cast("long")}.get(skew, F.col("id"))
    weight = F.when(F.col("id") % 2 == 0, 0.001).otherwise(1000.0) if skew == "weights" else F.lit(0.5)
    if skew == "equal rows":
        df = df.withColumn("text", F.lit("x y"))
    df = store.written(df.select(key.alias("doc_id"), "text", "source", weight.alias("w"), F.lit("s").alias("SIZE"), F.lit("t").alias("taken")), "test")
    old, mixing.SPLIT = mixing.SPLIT, 16
    try:
        got = mixing.mix(df, df.columns, weight="w", bin_rows=50)
        assert [c.lower() for c in got.columns].count("size") == 1
        got = got.collect()
    finally:
        mixing.SPLIT = old
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert len(got) == n and all(abs(taken[s] - t) <= 1 for s, t in target.items())
    part = [r for r in got if r.size and r.taken % r.size]
    assert len(part) <= 2


def test_a_mix_of_rows_with_clashing_names(spark, tmp_path):
    names = "doc_id long, text string, source string, n_chars long, size string, _weight int, epochs int, row int, head string, _row int"
    df = spark.createDataFrame([(i, "a b c d", "xy"[i % 2], 7, "s", 1, 2, 3, "h", 4) for i in range(30)], names)
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    out = mixing.materialise(mixing.mix(mixing.quality_weights(mixing.packed(df), labels), ["row"], weight="_weight", size="_size", tie="_tie"))
    out.write.parquet(str(tmp_path / "m"))
    assert out.columns == df.columns and {r.size for r in out.collect()} == {"s"}
    assert out.agg(F.sum(mixing.n_words("text"))).first()[0] == 120


def test_shards_of_rows_with_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5, "old", 3, 4, 5)], "doc_id long, text string, N_Bytes int, shard string, root int, h int, bytes int")
    out = sharding.shard(df, df.columns)
    out.write.parquet(str(tmp_path / "s"))
    assert rows(out) == [(1, "a", 3, 4, 5, 1, 0, "root")]


def test_shards_of_one_key(spark):
    """A repeated key, and equal rows of it, part until every shard fits, and a rerun gives the same sizes."""
    df = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 150, F.lit("x" * 20)).otherwise(F.concat(F.lit("y" * 17), F.col("id").cast("string"))).alias("text"))
    df = df.union(spark.range(50).select("id", F.lit("z" * 20)))
    size = collections.Counter()
    got = sharding.shard(store.written(df, "test"), ["doc_id"], limit=400).collect()
    for r in got:
        size[r.shard] += r.n_bytes
    assert len(got) == 350 and max(size.values()) <= 400 and sum(size.values()) == 7000
    assert len({r.shard.split(".")[0] for r in got if r.doc_id is None}) == 1
