"""Reproducible shuffles: splits, mini-batches, samples and sorted indexes.

"Random" order is the order of `md5(seed:row_id)`, with `row_id` as the last
tie-break. It does not depend on partitioning and survives task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinium import fixed

# Hash prefix that names a bucket: 4 hex digits, so at most 65,536 buckets.
BUCKET_DIGITS = 4
# Pivots that cut a sorted index into buckets.
PIVOTS = 255


def shuffle_key(seed: int | str, row_id: Column | str = "row_id") -> Column:
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))


def _offsets(keyed: DataFrame, bucket: str) -> DataFrame:
    """Rows per bucket, rows in earlier buckets and the total.

    The window has no partition, but its input is one row per bucket.
    """
    earlier = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return (
        keyed.groupBy(bucket)
        .agg(F.count("*").alias("_n"))
        .select(
            bucket,
            "_n",
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(everything).alias("_total"),
        )
    )


def _with_bucket(df: DataFrame, seed: int | str) -> DataFrame:
    keyed = df.withColumn("_key", shuffle_key(seed))
    return keyed.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))


def shuffled_rank(df: DataFrame, seed: int | str) -> DataFrame:
    """Add `rank` (1-based position in shuffled order) and `total`.

    Exact without a global sort: the rank inside a hash bucket plus the
    number of rows in earlier buckets. Hashes of unique ids spread evenly.
    """
    keyed = _with_bucket(df, seed)
    offsets = _offsets(_with_bucket(df.select("row_id"), seed), "_bucket")
    inside = Window.partitionBy("_bucket").orderBy("_key", "row_id")
    return (
        keyed.withColumn("_inside", F.row_number().over(inside).cast("long"))
        .join(F.broadcast(offsets.select("_bucket", "_before", "_total")), "_bucket")
        .withColumn("rank", F.col("_before") + F.col("_inside"))
        .withColumnRenamed("_total", "total")
        .drop("_key", "_bucket", "_inside", "_before")
    )


def split_catalog(
    df: DataFrame,
    seed: int = fixed.SEED,
    val_frac: float = fixed.VALIDATION_FRACTION,
    test_frac: float = fixed.TEST_FRACTION,
) -> DataFrame:
    """Add `split`: the first floor(test_frac * n) shuffled rows are `test`, the
    next floor(val_frac * n) `val`, the rest `train`.

    Only the two cut keys need a rank, and each lies in one hash bucket. So
    the rows are counted per bucket, two buckets are ranked, and every row is
    then labelled where it is by comparing its key with the cuts.
    """
    ids = _with_bucket(df.select("row_id"), seed)
    n_test = F.floor(F.col("_total") * F.lit(float(test_frac)))
    n_val = F.floor(F.col("_total") * F.lit(float(val_frac)))
    cut_ranks = F.array(
        F.struct(F.lit("test").alias("cut"), n_test.alias("at")),
        F.struct(F.lit("val").alias("cut"), (n_test + n_val).alias("at")),
    )
    wanted = (
        _offsets(ids, "_bucket")
        .select("_bucket", "_n", "_before", F.inline(cut_ranks))
        .filter((F.col("at") > F.col("_before")) & (F.col("at") <= F.col("_before") + F.col("_n")))
    )
    inside = Window.partitionBy("cut").orderBy("_key", "row_id")
    # At most two rows in `wanted`, so at most two buckets of ids get ranked.
    cut_keys = (
        ids.join(F.broadcast(wanted), "_bucket")
        .withColumn("_inside", F.row_number().over(inside))
        .filter(F.col("_inside") == F.col("at") - F.col("_before"))
    )

    def cut(name: str) -> Column:
        key = F.struct("_key", "row_id")
        return F.max(F.when(F.col("cut") == name, key)).alias(name)

    cuts = cut_keys.agg(cut("test"), cut("val")).select(F.struct("test", "val").alias("cuts"))
    place = F.struct(shuffle_key(seed).alias("_key"), F.col("row_id"))
    return (
        df.withColumn("_cuts", cuts.scalar())
        .withColumn(
            "split",
            F.when(place <= F.col("_cuts.test"), "test")
            .when(place <= F.col("_cuts.val"), "val")
            .otherwise("train"),
        )
        .drop("_cuts")
    )


def assign_batches(
    df: DataFrame,
    seed: int | str = fixed.SEED,
    epoch: int = 0,
    batch_size: int = fixed.BATCH_SIZE,
    drop_last: bool = True,
) -> DataFrame:
    """Add `batch_id`: consecutive runs of the epoch's shuffled order.

    The last, partial batch is dropped for training and kept for validation.
    """
    ranked = shuffled_rank(df, f"{seed}:{epoch}")
    batched = ranked.withColumn("batch_id", F.floor((F.col("rank") - 1) / batch_size))
    if drop_last:
        batched = batched.filter(F.col("batch_id") < F.floor(F.col("total") / batch_size))
    return batched.drop("rank", "total")


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n rows without replacement; a top-n, not a full sort."""
    keyed = df.withColumn("_key", shuffle_key(seed))
    return keyed.orderBy("_key", "row_id").limit(n).drop("_key")


def sorted_index(distinct_values: DataFrame, column: str) -> DataFrame:
    """Add `idx`: 0-based position of each distinct value in sorted order.

    Pivots drawn in hash order cut the value range into at most 256 even
    buckets; the position is the rank in the bucket plus earlier buckets.
    """
    pivots = (
        distinct_values.orderBy(F.md5(column), column)
        .limit(PIVOTS)
        .agg(F.sort_array(F.collect_list(column)).alias("pivots"))
    )
    bucket = F.size(F.filter("_pivots", lambda pivot: pivot <= F.col(column)))
    bucketed = (
        distinct_values.withColumn("_pivots", pivots.scalar())
        .withColumn("_bucket", bucket)
        .drop("_pivots")
    )
    inside = Window.partitionBy("_bucket").orderBy(column)
    return (
        bucketed.withColumn("_inside", F.row_number().over(inside).cast("long"))
        .join(F.broadcast(_offsets(bucketed, "_bucket").select("_bucket", "_before")), "_bucket")
        .withColumn("idx", (F.col("_before") + F.col("_inside") - 1))
        .drop("_bucket", "_inside", "_before")
    )
