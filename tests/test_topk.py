"""Exact top-k against brute force, ties and copies included."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinium.functions import vectors as vec
from affinium.operators import lookup, topk
from affinium.operators.arrow import vector_column
from affinium.operators.blocks import MOST_BLOCKS, block_grid

SCHEMA = "row_id long, embedding array<float>"


def frame(spark, rows, ids=None):
    ids = range(len(rows)) if ids is None else ids
    data = [(int(i), [float(x) for x in row]) for i, row in zip(ids, rows, strict=True)]
    return spark.createDataFrame(data, SCHEMA)


def brute(queries, items, k, exclude_self):
    out = {}
    for q, qv in queries.items():
        scored = [(-round(float(np.dot(qv, iv)), 9), i) for i, iv in items.items() if not (exclude_self and i == q)]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def ranked(df):
    out = {}
    for row in df.orderBy("q_id", "rank").collect():
        out.setdefault(row["q_id"], []).append(row["row_id"])
    return out


def copies(rng, n=300, dim=6):
    """A third of all rows are one vector."""
    rows = rng.normal(size=(n, dim)).astype(np.float32)
    rows[rng.permutation(n)[: n // 3]] = rows[0]
    return rows


@pytest.mark.parametrize("block_rows", [None, 64])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_rank_catalog(spark, block_rows, exclude_self):
    rows = copies(np.random.default_rng(1))
    items = frame(spark, rows).repartition(5)
    queries = items.select(F.col("row_id").alias("q_id"), "embedding")
    got = topk.rank_catalog(queries, items, 7, exclude_self, block_rows=block_rows)
    table = {i: row.astype(np.float64) for i, row in enumerate(rows)}
    assert ranked(got) == brute(table, table, 7, exclude_self)


@pytest.mark.parametrize("block_rows", [None, 64])
def test_k_beyond_catalog(spark, block_rows):
    items = frame(spark, [[1, 0], [0, 1], [0, 0]])
    queries = items.select(F.col("row_id").alias("q_id"), "embedding")
    got = ranked(topk.rank_catalog(queries, items, 10, block_rows=block_rows))
    assert got == {0: [1, 2], 1: [0, 2], 2: [0, 1]}


def candidates(vectors, ids, k, exclude_self=True):
    column = pa.chunked_array([vector_column(vectors, pa.float64())])
    found = topk._block_candidates(ids, column, ids, vectors, k, exclude_self)
    return [(ids[q], -score, i) for q, i, score in zip(*found, strict=True)]


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e9, 1e16])
@pytest.mark.parametrize("k", [3, 40])
def test_block_candidates_in_steps(monkeypatch, scale, k):
    """Steps of few items, copies, tiny differences and vectors beyond single precision."""
    monkeypatch.setattr(topk, "FIRST_ITEMS", 16)
    monkeypatch.setattr(topk, "ITEM_CHUNK", 37)
    monkeypatch.setattr(topk, "QUERY_CHUNK", 50)
    rng = np.random.default_rng(6)
    vectors = rng.integers(-3, 4, (300, 5)).astype(float)
    vectors[100:200] = vectors[0] + rng.integers(0, 2, (100, 1)) * 1e-7
    vectors *= scale
    ids = rng.permutation(1000)[:300]
    want = []
    for q, vector in zip(ids, vectors, strict=True):
        scores = np.round(np.einsum("ij,ij->i", np.tile(vector, (300, 1)), vectors), topk.SCORE_DIGITS)
        want += sorted((q, -score, i) for score, i in zip(scores, ids, strict=True) if i != q)[:k]
    assert sorted(candidates(vectors, ids, k)) == sorted(want)


def test_scores_held_are_bounded():
    """512 queries against 60,000 items hold a step of the scores, not all of them (245 MB)."""
    vectors = np.random.default_rng(7).normal(size=(60_000, 4))
    column = pa.chunked_array([vector_column(vectors[:512], pa.float64())])
    tracemalloc.start()
    topk._block_candidates(np.arange(512), column, np.arange(60_000), vectors, 10, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6


def test_blocks_grow_with_the_table(spark):
    """Small block_rows must not copy a side hundreds of times."""
    rows = frame(spark, np.ones((400, 3)))
    count = lambda a, b: pa.table({"pairs": pa.array([a.num_rows * b.num_rows], pa.int64())})
    other = rows.withColumnRenamed("row_id", "q_id")
    cells = block_grid(other, rows, "q_id", "row_id", count, "pairs long", 2, vector="embedding").collect()
    assert len(cells) <= MOST_BLOCKS**2 and sum(r["pairs"] for r in cells) == 400 * 400


def test_scores_held_stay_in_cache():
    """Vectors in single precision are not copied as doubles, and only a tile of the scores is held (2 MB)."""
    vectors = np.random.default_rng(7).normal(size=(60_000, 32)).astype(np.float32)
    column = pa.chunked_array([vector_column(vectors[:512], pa.float32())])
    tracemalloc.start()
    topk._block_candidates(np.arange(512), column, np.arange(60_000), vectors, 10, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6


def test_large_query_beside_others():
    """A query beyond single precision must not make the others of its chunk see items rounded to it."""
    rng = np.random.default_rng(9)
    vectors = 1 + rng.normal(size=(400, 8)) * 1e-7
    queries = np.vstack([vectors[:50], np.full((1, 8), 1e16)])
    column = pa.chunked_array([vector_column(queries, pa.float64())])
    q_ids, ids = np.arange(51) + 1000, np.arange(400)
    places, found, _ = topk._block_candidates(q_ids, column, ids, vectors, 5, True)
    for q in range(50):
        scores = np.round(np.einsum("ij,ij->i", np.tile(queries[q], (400, 1)), vectors), topk.SCORE_DIGITS)
        assert list(found[places == q]) == list(np.lexsort((ids, -scores))[:5])


def test_few_copies_of_small_tables(spark):
    """A table of a few hundred blocks copies each side a few times, and its cells are dealt out over many tasks."""
    rows = frame(spark, np.ones((400, 3)))
    other = rows.withColumnRenamed("row_id", "q_id")
    count = lambda a, b: pa.table({"n": pa.array([a.num_rows + b.num_rows], pa.int64())})
    cells = block_grid(other, rows, "q_id", "row_id", count, "n long", 2, vector="embedding")
    found = cells.withColumn("task", F.spark_partition_id()).collect()
    assert sum(r["n"] for r in found) <= 12 * 400
    assert len({r["task"] for r in found}) >= 0.8 * len(found)


def test_single_query_ties_and_zero_vector(spark):
    items = frame(spark, [[0, 0], [1, 0], [2, 0], [-1, 0]])
    scored = topk.scores(items, topk.query_vector([1, 0]), vec.cosine)
    assert [(r["row_id"], r["score"]) for r in topk.top_k(scored, 4).collect()] == [(1, 1.0), (2, 1.0), (0, 0.0), (3, -1.0)]


def test_similar_excludes_the_item(spark):
    items = frame(spark, [[1, 0], [1, 0], [0, 1]])
    row = items.filter("row_id = 1").first()
    assert [r["row_id"] for r in topk.similar_to_row(items, row, 5).collect()] == [0, 2]


def test_find_item(spark):
    titles = ["The Ring Two", "ring", "a.c", "abc"]
    index = spark.createDataFrame(list(enumerate(titles)), "row_id long, title string")
    assert lookup.find_item(index, "RING")["row_id"] == 1
    assert lookup.find_item(index, "ring t")["row_id"] == 0
    assert lookup.find_item(index, "A.C")["row_id"] == 2
    with pytest.raises(KeyError):
        lookup.find_item(index, "x.z")


def test_title_table(spark, monkeypatch):
    """Against the rule of one title, with lists split to groups of a few pairs and every kind of query."""
    rng = np.random.default_rng(8)
    titles = [" ".join(rng.choice(["The", "ring", "Ring", "red", "ÀB", "a.c", "x", ""], rng.integers(1, 4))) for _ in range(300)]
    index = spark.createDataFrame([*enumerate(titles), (300, None)], "row_id long, title string")
    asked = {t[i : i + n] for t in titles[:80] for i, n in ((0, 99), (1, 5), (2, 3), (0, 2), (3, 1), (1, 8))}
    asked |= {t.upper() for t in titles[:40]} | {"", "zzz", "ring zz", "A.C", "%", "no such title"}
    names = [t.lower() for t in titles]
    want = {}
    for query in asked:
        found = [(n != query.lower(), i) for i, n in enumerate(names) if query.lower() in n]
        if found:
            want[query] = min(found)[1]
    df = spark.createDataFrame([(t,) for t in [*asked, None, "ring", "ring"]], "query string")
    for pairs in (lookup.PAIRS, 5):
        monkeypatch.setattr(lookup, "PAIRS", pairs)
        got = lookup.match_title_table(index, df).collect()
        assert {r["query"]: r["row_id"] for r in got} == want and len(got) == len(want)
    assert lookup.match_title_table(index.limit(0), df).collect() == []
    assert lookup.match_title_table(index, df.limit(0)).collect() == []


def test_check_index(spark):
    catalog = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, title string")
    good = frame(spark, [[1, 0], [0, 1]])
    lookup.check_index(good, catalog, 2)
    with pytest.raises(RuntimeError, match="stale"):
        lookup.check_index(good, catalog, 3)
    with pytest.raises(RuntimeError, match="stale"):
        lookup.check_index(frame(spark, [[1, 0], [0, 1]], [0, 5]), catalog, 2)
    info = {"n_rows": 2, "least_dim": 2, "most_dim": 2}
    lookup.check_dimension(info, 2)
    with pytest.raises(RuntimeError, match="stale"):
        lookup.check_dimension(info, 3)
    with pytest.raises(RuntimeError, match="stale"):
        lookup.check_dimension(info | {"most_dim": 3}, 2)
    with pytest.raises(RuntimeError, match="at least 3"):
        lookup.check_dimension(info, 2, at_least=3)
