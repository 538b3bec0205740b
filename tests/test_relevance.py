"""Overlap counts and retrieval metrics against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinium.operators import metrics, relevance, skew, wide_sets


def genre_frame(spark, sets):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "row_id long, genres array<string>")


def random_sets(n=240, values=14, widest=6, seed=0):
    rng = np.random.default_rng(seed)
    sets = [[f"g{v}" for v in rng.integers(0, values, rng.integers(0, widest))] for _ in range(n)]
    for at in range(0, n, 3):
        sets[at] = ["g0", "g1"]  # a third of the rows share one set
    return sets


def brute_counts(sets):
    sets = [set(s) for s in sets]
    return {i: sum(bool(a & b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)}


@pytest.mark.parametrize("subset_limit,options", [(8, {}), (2, {"block_sets": 16}), (0, {"block_sets": 7, "questions": 50})])
def test_relevant_counts(spark, subset_limit, options):
    sets = random_sets()
    got = relevance.relevant_counts(genre_frame(spark, sets), subset_limit=subset_limit, **options)
    assert {r["row_id"]: r["n_relevant"] for r in got.collect()} == brute_counts(sets)


def test_wide_sets_by_lists_and_bitmaps(spark, monkeypatch):
    """One value that all share beside rare ones, sets wider than a step and a hot copy with a large weight."""
    monkeypatch.setattr(wide_sets, "VALUES_AT_ONCE", 64)
    rng = np.random.default_rng(5)
    sets = [["all"] + [f"r{v}" for v in rng.integers(0, 4000, 12)] for _ in range(300)]
    sets += [[f"r{v}" for v in rng.integers(0, 4000, 300)] for _ in range(5)]
    sets += [[f"c{v}" for v in range(20)]] * 150 + [["c3"], [], ["alone"]]
    got = relevance.relevant_counts(genre_frame(spark, sets), block_sets=512)
    assert {r["row_id"]: r["n_relevant"] for r in got.collect()} == brute_counts(sets)


@pytest.mark.parametrize("limit,block_sets", [(96, 32_768), (96, 40), (14, 64)])
def test_first_shared_value(spark, monkeypatch, limit, block_sets):
    """Narrow, wide and vast sets, hot values in several blocks, copies with a weight; no row per set, value and block."""
    monkeypatch.setattr(relevance, "FIRST_SHARED_LIMIT", limit)
    if limit == 96:
        monkeypatch.setattr(relevance, "overlap_weights", None)
    rng = np.random.default_rng(11)
    sets = [["all"] * (i % 2) + [f"v{v}" for v in rng.zipf(1.3, rng.integers(1, 22)) if v < 400] for i in range(400)]
    sets += [[f"v{v}" for v in range(12)]] * 60 + [["alone"], [], ["v1"]]
    got = relevance.relevant_counts(genre_frame(spark, sets), block_sets=block_sets)
    assert {r["row_id"]: r["n_relevant"] for r in got.collect()} == brute_counts(sets)


def test_postings_choose_the_smaller_form():
    codes = np.r_[np.zeros(1000, dtype=int), [1, 2, 2]]
    rows = np.r_[np.arange(1000), [5, 7, 999]].astype(np.int32)
    postings = wide_sets.Postings(rows, codes, 1000, 4)
    assert postings.bitmap_at.tolist() == [0, -1, -1, -1]
    united = postings.unite(np.array([0, 0, 1, 2]), np.array([1, 2, 0, 3]), 3)
    weights = np.arange(1000) + 1
    assert wide_sets._weigh(united, weights, postings).tolist() == [6 + 8 + 1000, 500_500, 0]


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(skew.join_totals, "__defaults__", (10,))
    sets = random_sets()
    got = relevance.relevant_counts(genre_frame(spark, sets))
    assert {r["row_id"]: r["n_relevant"] for r in got.collect()} == brute_counts(sets)


def test_pairs(spark):
    sets = random_sets(90)
    pairs = relevance.overlapping_pairs(genre_frame(spark, sets)).first()["n_pairs"]
    assert pairs == sum(brute_counts(sets).values())
    assert relevance.overlapping_pairs(genre_frame(spark, [[], []])).first()["n_pairs"] == 0


def brute_metrics(ranking, relevant, ks):
    """Plain-Python definition: binary gain, truncated reciprocal rank, ÷k precision."""
    out = {}
    for k in ks:
        sums = {name: [] for name in metrics.METRICS}
        for query, found in ranking.items():
            total = len(relevant[query])
            if not total:
                continue
            hits = [item in relevant[query] for item in found[:k]]
            gain = sum(1 / np.log2(r + 2) for r, hit in enumerate(hits) if hit)
            ideal = sum(1 / np.log2(r + 2) for r in range(min(total, k)))
            sums["HitRate"].append(any(hits))
            sums["Recall"].append(sum(hits) / total)
            sums["Precision"].append(sum(hits) / k)
            sums["NDCG"].append(gain / ideal)
            sums["MRR"].append(1 / (hits.index(True) + 1) if any(hits) else 0)
        out |= {f"{name}@{k}": float(np.mean(v)) if v else 0.0 for name, v in sums.items()}
    return out


@pytest.mark.parametrize("ks,depth", [((1, 5, 10), 10), ((3, 50), 20)])
def test_metrics(spark, ks, depth):
    rng = np.random.default_rng(3)
    sets = random_sets(60, values=9, widest=3, seed=3)
    ranking = {q: [int(i) for i in rng.permutation(60) if i != q][:depth] for q in range(60)}
    relevant = {q: {j for j in range(60) if j != q and set(sets[q]) & set(sets[j])} for q in range(60)}
    rows = [(q, item, at + 1) for q, found in ranking.items() for at, item in enumerate(found)]
    items = genre_frame(spark, sets)
    hits = relevance.mark_hits(spark.createDataFrame(rows, "q_id long, row_id long, rank int"), items)
    got = metrics.metrics_at_k(hits, relevance.relevant_counts(items), ks)
    assert {r["metric"]: r["value"] for r in got.collect()} == pytest.approx(brute_metrics(ranking, relevant, ks))


def test_metrics_without_valid_queries(spark):
    items = genre_frame(spark, [["a"], ["b"], []])
    rows = spark.createDataFrame([(0, 1, 1), (1, 0, 1), (2, 0, 1)], "q_id long, row_id long, rank int")
    got = metrics.metrics_at_k(relevance.mark_hits(rows, items), relevance.relevant_counts(items))
    values = [r["value"] for r in got.collect()]
    assert len(values) == 15 and set(values) == {0.0}


def test_no_hit_scores_zero(spark):
    items = genre_frame(spark, [["a"], ["a"], ["b"]])
    rows = spark.createDataFrame([(0, 2, 1), (1, 2, 1)], "q_id long, row_id long, rank int")
    got = metrics.query_metrics(relevance.mark_hits(rows, items), relevance.relevant_counts(items), (1,))
    for row in got.collect():
        assert [row[c] for c in got.columns if c != "q_id"] == [0.0] * 5


def test_join_totals_splits_hot_keys(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    totals = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    got = skew.join_totals(rows, totals, "k", "n", "id", rows_per_task=50)
    want = rows.join(totals, "k").select(got.columns)
    assert got.count() == 3000 and got.exceptAll(want).isEmpty()
