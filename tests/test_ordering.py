"""Reproducible shuffles against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

from affinium.operators import ordering


def order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n", [0, 1, 6, 7, 20, 1000])
def test_split_matches_sorted_order(spark, n):
    labelled = ordering.split_catalog(spark.range(n).withColumnRenamed("id", "row_id")).collect()
    cut = int(n * 0.15)
    expected = {row: "test" if at < cut else "val" if at < 2 * cut else "train"
                for at, row in enumerate(order(range(n), 42))}
    assert {row["row_id"]: row["split"] for row in labelled} == expected


def test_split_does_not_depend_on_partitions(spark):
    ids = spark.range(500).withColumnRenamed("id", "row_id")
    one = ordering.split_catalog(ids.coalesce(1)).collect()
    many = ordering.split_catalog(ids.repartition(13)).collect()
    assert sorted(one) == sorted(many)


def test_shuffled_rank(spark):
    ids = spark.range(3000).withColumnRenamed("id", "row_id")
    rows = ordering.shuffled_rank(ids, "7:1").collect()
    assert [row["row_id"] for row in sorted(rows, key=lambda r: r["rank"])] == order(range(3000), "7:1")
    assert {row["total"] for row in rows} == {3000}


def test_batches(spark):
    ids = spark.range(200).withColumnRenamed("id", "row_id")
    full = ordering.assign_batches(ids, 1, 2, 64).groupBy("batch_id").count().collect()
    assert sorted((row["batch_id"], row["count"]) for row in full) == [(0, 64), (1, 64), (2, 64)]
    kept = ordering.assign_batches(ids, 1, 2, 64, drop_last=False).groupBy("batch_id").count().collect()
    assert sorted(row["count"] for row in kept) == [8, 64, 64, 64]


def test_sample(spark):
    ids = spark.range(100).withColumnRenamed("id", "row_id")
    assert [row["row_id"] for row in ordering.sample_rows(ids, 10, 0).collect()] == order(range(100), 0)[:10]
    assert ordering.sample_rows(ids, 1000).count() == 100


def test_sorted_index(spark):
    words = [f"w{(i * 7919) % 5000}é" for i in range(5000)]
    df = spark.createDataFrame([(w,) for w in words], "value string")
    rows = ordering.sorted_index(df, "value").orderBy("idx").collect()
    assert [row["value"] for row in rows] == sorted(words)
    assert [row["idx"] for row in rows] == list(range(5000))


def test_split_ranks_no_whole_table(spark):
    """The label step is a projection: ranks are computed inside two hash buckets only."""
    plan = ordering.split_catalog(spark.range(1000).withColumnRenamed("id", "row_id")).withColumn("x", F.lit(1))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.splitlines()[0].startswith("Project")
