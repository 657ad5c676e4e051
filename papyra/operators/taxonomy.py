"""Concept hierarchies, as edges (code, parent); a root has a null parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra import store

def depths(edges: DataFrame) -> DataFrame:
    """(code, depth, path) of every code that hangs below a root; roots have depth 1.

    One join per level until a level is empty; levels are written, so no lineage
    grows, and a code's own path stops loops. A code with several parents comes once,
    on its least shortest path.
    """
    level = edges.where("parent IS NULL").select("code", F.lit(1).alias("depth"), F.array("code").alias("path")).distinct()
    level = store.written(level, "level")
    out = level
    while not level.isEmpty():
        up = level.select(F.col("code").alias("parent"), "depth", "path")
        below = edges.join(up, "parent").where(~F.array_contains("path", F.col("code")))
        below = below.groupBy("code").agg((F.min("depth") + 1).alias("depth"), F.min(F.concat("path", F.array("code"))).alias("path"))
        level = store.written(below.join(out.select("code"), "code", "left_anti"), "level")
        out = out.union(level)
    return out


def leaves(edges: DataFrame, max_level: int, known: DataFrame | None = None) -> DataFrame:
    """Candidate labels: codes at ``max_level``, and childless ones above it, with their ancestors l1..l3.

    ``known``: the result of ``depths``, if it is there already.
    """
    d = (depths(edges) if known is None else known).where(F.col("depth") <= max_level)
    parents = edges.where("parent IS NOT NULL").select(F.col("parent").alias("code")).distinct()
    childless = d.where(F.col("depth") < max_level).join(parents, "code", "left_anti")
    both = d.where(F.col("depth") == max_level).unionByName(childless)
    level = lambda i: F.coalesce(F.get("path", F.lit(i)), F.lit(""))
    return both.select("code", level(0).alias("l1"), level(1).alias("l2"), level(2).alias("l3"))


def families(leaves: DataFrame) -> DataFrame:
    """(l1, codes): the candidate labels of each first-level family, in order."""
    return leaves.groupBy("l1").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def rollup(edges: DataFrame) -> DataFrame:
    """(code, root) for every code; the root is null where the chain breaks or loops."""
    codes = edges.select("code").distinct()
    roots = depths(edges).select("code", F.element_at("path", 1).alias("root"))
    return codes.join(roots, "code", "left")


def stage_index(edges: DataFrame) -> DataFrame:
    """(l2, n_children, terminal) for the two-stage cascade: second-level codes and what hangs below them."""
    d = depths(edges).where("depth = 2").select(F.col("code").alias("l2"))
    n = edges.groupBy(F.col("parent").alias("l2")).agg(F.count("*").alias("n"))
    n_children = F.coalesce("n", F.lit(0)).cast("long")
    return d.join(n, "l2", "left").select("l2", n_children.alias("n_children"), (n_children == 0).alias("terminal"))
