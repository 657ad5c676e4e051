"""Column functions for statistics and set comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96
EPS = 1e-10


def jaccard(a: Column, b: Column) -> Column:
    """Of two label sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def overlap_class(a: Column, b: Column) -> Column:
    """identical, partial or disjoint; identity is tested first, so two empty sets are identical."""
    return F.when(same_set(a, b), "identical").when(F.arrays_overlap(a, b), "partial").otherwise("disjoint")


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson interval of k out of n, within [0, 1]; (0, 0) for n = 0."""
    p = k / F.nullif(n.cast("double"), F.lit(0.0))
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / d
    some = lambda c: F.when(n == 0, 0.0).otherwise(c)
    return some(F.greatest(F.lit(0.0), mid - half)), some(F.least(F.lit(1.0), mid + half))


def entropy(dist: Column) -> Column:
    """Shannon entropy (natural logarithm) of the positive entries."""
    return F.aggregate(F.filter(dist, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.ln(p))


def npmi(n1: Column, n2: Column, n12: Column, n: Column, eps: float = EPS) -> Column:
    """Normalised pointwise mutual information within [-1, 1].

    -1 where any of the three probabilities is under ``eps``; 1 for a pair in every
    document, where the quotient has no value.
    """
    p1, p2, p12 = n1 / n, n2 / n, n12 / n
    some = lambda p: F.coalesce(p, F.lit(0.0)) >= eps
    value = F.ln(p12 / (p1 * p2)) / -F.ln(F.nullif(p12, F.lit(1.0)))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))
    return F.when(~(some(p12) & some(p1) & some(p2)), -1.0).when(n12 == n, 1.0).otherwise(bounded)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes l, t, r, b; 0 if the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["r"], b["r"]) - F.greatest(a["l"], b["l"]))
    h = F.greatest(F.lit(0.0), F.least(a["b"], b["b"]) - F.greatest(a["t"], b["t"]))
    area = lambda x: (x["r"] - x["l"]) * (x["b"] - x["t"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def percent_floor(x: Column, n: Column) -> Column:
    return F.floor(F.lit(100) * x / F.nullif(n, F.lit(0))).cast("long")


def heat(x: Column, most: Column) -> Column:
    """Intensity of a cell of a heat map, by the square root of its share of the largest."""
    return F.coalesce(F.sqrt(x / F.nullif(most.cast("double"), F.lit(0.0))), F.lit(0.0))


def fill(weight: Column, full: float = 0.6) -> Column:
    """Opacity of a block by a topic's weight: from 0.1 to 1, reached at ``full``."""
    return F.lit(0.1) + F.lit(0.9) * F.least(F.lit(1.0), weight / F.lit(full))


def argmax(values: Column) -> Column:
    """0-based position of the largest entry; the first of ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def upper_median(values: Column) -> Column:
    s = F.sort_array(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def padded_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: int = 4) -> list[Column]:
    """A crop box with a margin, clamped to its image."""
    return [F.greatest(F.lit(0), x - pad), F.greatest(F.lit(0), y - pad), F.least(width, x + w + pad), F.least(height, y + h + pad)]
