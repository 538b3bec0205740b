"""Pruned ranking: equal to the block grid on clustered, spread and tied vectors, and what it skips."""

import numpy as np
import pytest

from affinium.operators import pruned
from affinium.operators.pruned import file_items, rank_pruned
from affinium.operators.topk import rank_catalog


def frame(spark, vectors, first=0, name="row_id"):
    rows = [(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>").repartition(3)


def clustered(rng, n, dim=12, groups=10, spread=0.05):
    centres = rng.normal(size=(groups, dim))
    v = centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def same(queries, items, k, **options):
    got, skipped = rank_pruned(queries, items, k, **options)
    want = rank_catalog(queries, items, k, options.get("exclude_self", True))
    key = lambda df: sorted(map(tuple, df.select("q_id", "rank", "row_id", "score").collect()))
    assert key(got) == key(want)
    return skipped


def test_clustered_vectors_skip_most_blocks(spark):
    items = frame(spark, clustered(np.random.default_rng(1), 600))
    queries = items.withColumnRenamed("row_id", "q_id")
    # Enough pivots that each group has one.
    assert same(queries, items, 5, pivots=60, block_items=10) > 0.5


@pytest.mark.parametrize("k", [1, 30, 1000])
def test_spread_vectors_and_large_k(spark, k):
    """Nothing can be skipped, or k exceeds the catalog: still the same."""
    rng = np.random.default_rng(2)
    items = frame(spark, rng.normal(size=(200, 8)) * rng.uniform(0.1, 5, (200, 1)))
    queries = frame(spark, rng.normal(size=(20, 8)), 10_000, "q_id")
    skipped = same(queries, items, k, exclude_self=False, pivots=8, block_items=16)
    assert 0 <= skipped < 1 and (k < 200 or skipped == 0)


def test_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(pruned, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(3)
    vectors = np.r_[np.tile(clustered(rng, 1), (150, 1)), clustered(rng, 60), np.zeros((3, 12))]
    items = frame(spark, vectors)
    same(items.withColumnRenamed("row_id", "q_id"), items, 6, pivots=5, block_items=20)
    filed = file_items(items, 5, 20)
    assert filed.groupBy("block").count().agg({"count": "max"}).first()[0] < 60


def test_empty_tables(spark):
    items = frame(spark, clustered(np.random.default_rng(4), 10))
    queries = items.withColumnRenamed("row_id", "q_id")
    for q, i in ((queries.limit(0), items), (queries, items.limit(0))):
        ranked, skipped = rank_pruned(q, i, 3)
        assert ranked.collect() == [] and skipped == 0


def test_visits_send_a_query_once_per_group(spark, monkeypatch):
    """Spread vectors, where no block can be left out: a row per query and group, not per query and block."""
    written = {}
    keep = pruned.materialise

    def spy(df, name):
        written[name] = keep(df, name)
        return written[name]

    monkeypatch.setattr(pruned, "materialise", spy)
    monkeypatch.setattr(pruned, "GROUP_ITEMS", 100)
    monkeypatch.setattr(pruned, "BOUNDS_AT_ONCE", 64)
    items = frame(spark, np.random.default_rng(9).normal(size=(240, 16)))
    same(items.withColumnRenamed("row_id", "q_id"), items, 5, pivots=20, block_items=8)
    other = written["other-visits"]
    assert other.groupBy("q_id", "group").count().filter("count > 1").isEmpty()
    assert other.count() <= 240 * 4
