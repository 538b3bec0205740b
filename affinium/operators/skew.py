"""Join of many rows with one total per key, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinium.session import materialise

# Rows of one key that a single task may handle.
ROWS_PER_TASK = 200_000


def join_totals(
    rows: DataFrame,
    totals: DataFrame,
    key: str,
    weight: str,
    spread_by: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner join on `key`, where `weight` in `totals` says how many rows share it.

    Keys heavier than `rows_per_task` are split by the hash of `spread_by` and
    their single total is copied to each part. There are at most rows /
    rows_per_task hot keys; Spark broadcasts their list or, where it is long,
    joins it by shuffle and splits what is skewed. The totals are written
    once, since three branches read them.
    """
    totals = materialise(totals, "totals")
    parts = F.ceil(F.col(weight) / rows_per_task).cast("int")
    hot = totals.filter(F.col(weight) > rows_per_task).select(key, parts.alias("_parts"))
    left = rows.join(hot, key, "left").withColumn(
        "_part", F.pmod(F.xxhash64(spread_by), F.coalesce("_parts", F.lit(1))).cast("int")
    )
    own = F.greatest(parts, F.lit(1))
    right = totals.withColumn("_part", F.explode(F.sequence(F.lit(0), own - 1))).withColumn("_parts", own)
    # Both sides often come from an explode, whose growth size estimates miss:
    # the hint keeps Spark from broadcasting a table it takes for small.
    return left.drop("_parts").join(right.drop("_parts").hint("merge"), [key, "_part"]).drop("_part")
