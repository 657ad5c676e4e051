"""Ranks and running sums of long tables: no window over all rows, or all of a group, in one task.

Rows are dealt by ranges of their order; each range sums up by itself, and the few
sums of the ranges before it are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra import store


def cumulative(df: DataFrame, by: list[str], order: list[Column | str], value: str) -> DataFrame:
    """Adds ``upto`` (the sum of ``value`` up to the row), ``rank`` and ``all`` (the group's sum) within the groups ``by``."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = store.written(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    local = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy("_range", *by).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    line = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", *by, F.coalesce(F.sum("_s").over(line), F.lit(0)).alias("_before"), F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_rows"), F.sum("_s").over(group).alias("all"))
    same = dealt["_range"] == before["_range"]
    for c in by:
        same = same & dealt[c].eqNullSafe(before[c])
    here = dealt.withColumn("_upto", F.sum(value).over(local)).withColumn("_rank", F.row_number().over(local))
    same = here["_range"] == before["_range"]
    for c in by:
        same = same & here[c].eqNullSafe(before[c])
    return here.join(before, same).select(*(here[c] for c in df.columns), (F.col("_before") + F.col("_upto")).alias("upto"), (F.col("_rows") + F.col("_rank")).cast("long").alias("rank"), "all")


def quantiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, median, upper): exact medians, interpolated and upper, from counts of the distinct values."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return weighted_quantiles(counts, by, value, "_n")


def weighted_quantiles(counts: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """``quantiles`` of values that stand ``n`` times each; null values count nothing."""
    at = cumulative(counts.where(F.col(value).isNotNull()), by, [value], n)
    least = lambda i: F.min(F.when(F.col("upto") > F.floor(i), F.col(value)))
    low, high = least((F.col("all") - 1) / 2), least(F.col("all") / 2)
    return at.groupBy(*by).agg(F.max("all").alias("n"), ((low.cast("double") + high) / 2).alias("median"), high.alias("upper"))
