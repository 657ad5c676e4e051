"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on node ids; each round is written to
the shared folder, so neither lineage nor lost executors undo it, and no link
reaches the driver. A hub's links are aggregated map-side and its join may be
split, so a group with a third of all nodes is no single task.

Defined results: links with a null end, and from a node to itself, are none;
repeated links count once; ids may take any 64-bit value; no links, no rows; other
columns than ``a`` and ``b`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def connected(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node of (a, b) links; component is the smallest node reachable."""
    spark = links.sparkSession
    edges = store.written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    last = None
    # sums of 64-bit hashes as decimals: no id overflows them, and equal sums twice mean an unchanged table
    mark = F.xxhash64("u", "v")
    while True:
        total = edges.agg(F.count("*"), F.sum(mark.cast("decimal(20,0)")), F.bit_xor(mark)).first()
        if not total[0] or total == last:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(edges.select("v", "v").distinct())
        last = total
        # large star: each larger neighbour of a node links to the node's least neighbour
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each smaller neighbour, and the node, link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = store.written(small.union(low.select("u", "m")).distinct(), name)
        store.drop(spark, edges)
        edges = nxt
