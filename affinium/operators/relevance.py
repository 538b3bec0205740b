"""Category-overlap ground truth without the quadratic pair table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinium.functions import vectors as vec
from affinium.operators.first_shared import first_shared_weights
from affinium.operators.skew import join_totals
from affinium.operators.wide_sets import overlap_weights
from affinium.session import materialise

# Signatures up to this size are counted through their subsets (2^size - 1).
SUBSET_LIMIT = 8
# Wider ones up to this size by their first shared value, whose work grows with the square of a set's width.
FIRST_SHARED_LIMIT = 96


def _subsets(categories: Column) -> Column:
    """All non-empty subsets of a sorted set, as arrays."""
    n_subsets = F.call_function("shiftleft", F.lit(1), F.size(categories))
    masks = F.sequence(F.lit(1), n_subsets - 1)

    def members(mask):
        return F.filter(
            categories, lambda value, at: F.getbit(mask, at) == 1
        )

    return F.transform(masks, members)


def signature_counts(items: DataFrame) -> DataFrame:
    """Distinct category sets with the number of items; items without any are out."""
    signed = items.select(vec.signature(F.col("genres")).alias("sig"))
    return signed.filter(F.size("sig") > 0).groupBy("sig").agg(F.count("*").alias("n_items"))


def _narrow_overlaps(narrow: DataFrame) -> DataFrame:
    """Items overlapping each narrow signature, by inclusion and exclusion.

    The number of items sharing a category with S is the alternating sum,
    over the non-empty subsets T of S, of the items containing T. Work and
    shuffle grow with the signatures, not with their pairs.
    """
    exploded = narrow.select("sig_id", "n_items", F.explode(_subsets(F.col("sig"))).alias("subset"))
    totals = exploded.groupBy("subset").agg(
        F.sum("n_items").alias("containing"), F.count("*").alias("n_sigs")
    )
    sign = F.when(F.size("subset") % 2 == 1, 1).otherwise(-1)
    joined = join_totals(exploded.select("sig_id", "subset"), totals, "subset", "n_sigs", "sig_id")
    return joined.groupBy("sig_id").agg(F.sum(sign * F.col("containing")).alias("n"))


def overlaps_per_signature(signatures: DataFrame, subset_limit: int = SUBSET_LIMIT, **options) -> DataFrame:
    """`(sig, n_items, n_overlapping)`: items sharing at least one category, self included.

    Pairs with a signature too wide for subset counting are counted at their
    first shared value. Signatures too wide for that ask bitmaps of all
    signatures, and the others bitmaps of those. All are exact. The signatures
    are used several times, so they are written out once.
    """
    numbered = signatures.withColumn("sig_id", F.monotonically_increasing_id())
    signatures = materialise(numbered, "signatures")
    narrow = signatures.filter(F.size("sig") <= subset_limit)
    listed = signatures.filter(F.size("sig") <= FIRST_SHARED_LIMIT)
    vast = signatures.filter(F.size("sig") > FIRST_SHARED_LIMIT)
    found = F.size("sig")
    kinds = signatures.agg(
        F.min(found).alias("least"), F.max(found).alias("most"),
        F.max((found > subset_limit) & (found <= FIRST_SHARED_LIMIT)).alias("any_listed"),
    ).first()
    any_vast = (kinds["most"] or 0) > FIRST_SHARED_LIMIT

    def sets(part: DataFrame) -> DataFrame:
        return part.select(F.col("sig_id").alias("set_id"), F.col("sig").alias("members"), F.col("n_items").alias("weight"))

    def met(asking: DataFrame, held: DataFrame) -> DataFrame:
        return overlap_weights(sets(asking), sets(held), **options).withColumnRenamed("set_id", "sig_id")

    parts = [_narrow_overlaps(narrow)] if (kinds["least"] or 0) <= subset_limit else []
    if kinds["any_listed"]:
        marked = sets(listed).withColumn("wide", F.size("members") > subset_limit)
        blocks = {name: value for name, value in options.items() if name == "block_sets"}
        parts.append(first_shared_weights(marked, **blocks).withColumnRenamed("set_id", "sig_id"))
    if any_vast:
        parts.append(met(vast, signatures))
        if (kinds["least"] or 0) <= FIRST_SHARED_LIMIT:
            parts.append(met(listed, vast))
    counted = reduce(DataFrame.unionByName, parts)
    counted = counted.groupBy("sig_id").agg(F.sum("n").cast("long").alias("n_overlapping"))
    # Sized by estimates that miss the explode above, so never broadcast.
    return signatures.join(counted.hint("merge"), "sig_id").drop("sig_id")


def relevant_counts(items: DataFrame, **options) -> DataFrame:
    """`(row_id, n_relevant)`: other items sharing a category; 0 without categories."""
    signed = items.select("row_id", vec.signature(F.col("genres")).alias("sig"))
    counted = overlaps_per_signature(signature_counts(items), **options)
    found = join_totals(signed.filter(F.size("sig") > 0), counted, "sig", "n_items", "row_id")
    positive = found.select("row_id", (F.col("n_overlapping") - 1).alias("n_relevant"))
    empty = signed.filter(F.size("sig") == 0).select("row_id", F.lit(0).cast("long").alias("n_relevant"))
    return positive.unionByName(empty)


def overlapping_pairs(items: DataFrame, **options) -> DataFrame:
    """One row: ordered pairs of distinct items that share a category."""
    counted = overlaps_per_signature(signature_counts(items), **options)
    pairs = F.sum(F.col("n_items") * (F.col("n_overlapping") - 1))
    return counted.agg(F.coalesce(pairs, F.lit(0)).alias("n_pairs"))


def mark_hits(ranking: DataFrame, items: DataFrame) -> DataFrame:
    """Add `hit`: does the ranked item share a category with its query?

    Touches only the ranked rows (k per query); AQE splits popular items.
    """
    categories = items.select("row_id", "genres")
    of_query = categories.select(F.col("row_id").alias("q_id"), F.col("genres").alias("_q"))
    of_item = categories.withColumnRenamed("genres", "_c")
    return (
        ranking.join(of_query, "q_id")
        .join(of_item, "row_id")
        .withColumn("hit", F.arrays_overlap("_q", "_c"))
        .drop("_q", "_c")
    )
