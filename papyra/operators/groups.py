"""Connected groups of a link table, by alternating large-star and small-star rounds on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra import store


def connected(links: DataFrame) -> DataFrame:
    """(node, group) of every node of the links (a, b); a group is named by its smallest node.

    Each round is grouped minima and joins by node, so a hub is no single task; it
    ends when a round changes nothing, told by sums of hashes that no id overflows.
    """
    edges = store.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark, last = F.xxhash64("u", "v"), None
    while True:
        now = edges.agg(F.count("*"), F.sum(mark.cast("decimal(20,0)")), F.bit_xor(mark)).first()
        if not now[0] or now == last:
            own = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("group"))
            return own.union(edges.select("v", "v").distinct())
        last = now
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, edges = edges, store.written(small.union(low.select("u", "m")).distinct(), "edges")
        store.drop(edges.sparkSession, done)
