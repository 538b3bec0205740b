"""Retrieval metrics at k, averaged over the queries that have a relevant item."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinium import fixed

METRICS = ["HitRate", "MRR", "NDCG", "Precision", "Recall"]


def _ideal_gain(relevant: Column, k: int) -> Column:
    """Best possible discounted gain with min(relevant, k) hits."""
    gains, total = [], 0.0
    for rank in range(1, k + 1):
        total += 1.0 / math.log2(rank + 1)
        gains.append(F.lit(total))
    return F.get(F.array(*gains), (F.least(relevant, F.lit(k)) - 1).cast("int"))


def query_metrics(
    hits: DataFrame,
    relevant: DataFrame,
    ks: tuple[int, ...] = fixed.METRIC_CUTOFFS,
    by: list[str] | None = None,
) -> DataFrame:
    """Metrics of each query as columns `<metric>@<k>`.

    `hits(q_id, rank, hit)` holds the ranking, `relevant(row_id, n_relevant)`
    the number of relevant items. Queries without any are left out; queries
    that rank nothing relevant score 0.
    """
    by = by or []
    place = F.when(F.col("hit"), F.col("rank"))
    sums = []
    for k in ks:
        near = F.when(place <= k, place)
        sums += [
            F.count(near).alias(f"_hits{k}"),
            F.coalesce(F.sum(1.0 / F.log2(near + 1)), F.lit(0.0)).alias(f"_gain{k}"),
            F.min(near).alias(f"_first{k}"),
        ]
    asked = relevant.filter(F.col("n_relevant") > 0).select(F.col("row_id").alias("q_id"), "n_relevant")
    per_query = hits.groupBy(*by, "q_id").agg(*sums).join(asked, "q_id")
    columns = []
    for k in ks:
        found = F.col(f"_hits{k}")
        columns += [
            (found > 0).cast("double").alias(f"HitRate@{k}"),
            F.coalesce(1.0 / F.col(f"_first{k}"), F.lit(0.0)).alias(f"MRR@{k}"),
            (F.col(f"_gain{k}") / _ideal_gain(F.col("n_relevant"), k)).alias(f"NDCG@{k}"),
            (found / F.lit(k)).alias(f"Precision@{k}"),
            (found / F.col("n_relevant")).alias(f"Recall@{k}"),
        ]
    return per_query.select(*by, "q_id", *columns)


def mean_metrics(
    per_query: DataFrame,
    ks: tuple[int, ...] = fixed.METRIC_CUTOFFS,
    by: list[str] | None = None,
) -> DataFrame:
    """Long table `(by..., metric, value)`, 0 where no query was valid."""
    by = by or []
    names = [f"{metric}@{k}" for metric in METRICS for k in ks]
    means = [F.coalesce(F.avg(F.col(f"`{name}`")), F.lit(0.0)).alias(name) for name in names]
    wide = per_query.groupBy(*by).agg(*means) if by else per_query.agg(*means)
    entries = [F.struct(F.lit(name).alias("metric"), F.col(f"`{name}`").alias("value")) for name in names]
    return wide.select(*by, F.inline(F.array(*entries)))


def metrics_at_k(hits, relevant, ks=fixed.METRIC_CUTOFFS, by=None) -> DataFrame:
    return mean_metrics(query_metrics(hits, relevant, ks, by), ks, by)
