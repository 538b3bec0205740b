"""Column functions over `array<float>` embeddings and category sets.

All of them stay on the JVM. Sums run in double whatever the element type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, value: total + value)


def dot(left: Column, right: Column) -> Column:
    return _total(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(_total(squares))


def unit(vector: Column) -> Column:
    """L2-normalised vector; the zero vector stays zero."""
    length = F.greatest(norm(vector), F.lit(1e-12))
    return F.transform(vector, lambda x: x.cast("double") / length)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity, 0 when either side is the zero vector."""
    scale = norm(left) * norm(right)
    return F.when(scale > 0, dot(left, right) / scale).otherwise(F.lit(0.0))


def overlap_ratio(left: Column, right: Column) -> Column:
    """Jaccard of two sets; two empty sets give 0."""
    union = F.greatest(F.size(F.array_union(left, right)), F.lit(1))
    return F.size(F.array_intersect(left, right)) / union


def signature(categories: Column) -> Column:
    """Canonical form of a category set."""
    return F.array_sort(F.array_distinct(categories))
