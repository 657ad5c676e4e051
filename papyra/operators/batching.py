"""Packing articles into lots for model calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 40_000
MAX_ITEMS = 25
PER_ITEM = 15


class Lots:
    """The fold: an item that would pass the budget, or find ``most`` items, opens the next lot.

    A lot opens with the fixed cost. A lot that is empty takes any item: an oversize
    item is alone and whole.
    """

    def __init__(self, fixed: int, budget: int = BUDGET, most: int = MAX_ITEMS, per_item: int = PER_ITEM):
        self.fixed, self.budget, self.most, self.per_item = fixed, budget, most, per_item
        self.group, self.lot, self.used, self.items = None, 0, fixed, 0

    def __call__(self, group, tokens: int) -> int:
        group = None if group != group else group  # a null number
        if group != self.group:
            self.group, self.lot, self.used, self.items = group, 0, self.fixed, 0
        cost = tokens + self.per_item
        if self.items and (self.used + cost > self.budget or self.items >= self.most):
            self.lot, self.used, self.items = self.lot + 1, self.fixed, 0
        self.used, self.items = self.used + cost, self.items + 1
        return self.lot


def greedy_lots(tokens: np.ndarray, fixed: int, budget: int = BUDGET, most: int = MAX_ITEMS, per_item: int = PER_ITEM) -> np.ndarray:
    """Lot of each item in order, from 0."""
    lots = Lots(fixed, budget, most, per_item)
    return np.fromiter((lots(0, t) for t in tokens.tolist()), np.int64, len(tokens))


def with_lots(articles: DataFrame, group: str, order: str, tokens: str, fixed: int, budget: int = BUDGET, most: int = MAX_ITEMS) -> DataFrame:
    """Adds ``lot`` to the articles of each group, packed in their order.

    The threshold resets, which no window frame can express. A group is streamed
    in order as Arrow batches with four numbers of state, never held; groups are
    issues, so there are many.
    """
    kinds = {f.name: f.dataType.simpleString() for f in articles.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lots = Lots(fixed, budget, most)
        for pdf in batches:
            yield pdf.assign(lot=[lots(g, t) for g, t in zip(pdf[group].tolist(), pdf[tokens].tolist())])

    rows = articles.repartition(group).sortWithinPartitions(group, order)
    return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", lot long")


def chunk(group: str, order: str, size: int = MAX_ITEMS) -> Column:
    """Fixed-size chunk of each row, from 0."""
    return F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size).cast("long")


def chunk_sizes(rows: DataFrame, group: str, size: int = MAX_ITEMS) -> DataFrame:
    """(group, chunk, n) of fixed-size chunks: they follow from the groups' sizes alone."""
    n = rows.groupBy(group).agg(F.count("*").alias("_n"))
    each = n.select(group, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / size))).alias("chunk"))
    return each.select(group, "chunk", F.least(F.lit(size).cast("long"), F.col("_n") - F.col("chunk") * size).alias("n"))


def length_sorted(texts: list, size: int, run, length=len) -> list:
    """``run`` over mini-batches of like length, shortest first; results in the order of ``texts``."""
    order = sorted(range(len(texts)), key=lambda i: length(texts[i]))
    out = [None] * len(texts)
    for at in range(0, len(order), size):
        some = order[at : at + size]
        for i, y in zip(some, run([texts[i] for i in some]), strict=True):
            out[i] = y
    return out


def lots_needed(n: Column, mean_tokens: Column, fixed: int, budget: int = BUDGET, most: int = MAX_ITEMS, per_item: int = PER_ITEM) -> Column:
    """The closed form: ceil(n / items that fit in a lot)."""
    fit = F.least(F.lit(most), F.greatest(F.lit(1), F.floor((budget - fixed) / (mean_tokens + per_item))))
    return F.ceil(n / fit).cast("long")
