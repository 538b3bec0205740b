"""Exact duplicates: the code's round trip, the plan, and brute force on copies, hot texts, nulls and ties."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from affinium.llm import exact
from affinium.llm.exact import drop_duplicates, golomb_decode, golomb_encode, golomb_parameter, mark_duplicates, shape_of


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, (1 << 40) - 1), max_size=200), st.integers(0, 45))
def test_round_trip(numbers, k):
    rising = np.array(sorted(numbers), np.int64)
    # A small parameter with wide gaps would make the unary part endless.
    k = max(k, golomb_parameter(len(rising), 40) - 3) if len(rising) else k
    unary, rest = golomb_encode(rising, k)
    assert golomb_decode(unary, rest, len(rising), k).tolist() == rising.tolist()


def test_code_is_short():
    rising = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 50_000))
    unary, rest = golomb_encode(rising, golomb_parameter(len(rising), 40))
    least = 40 - np.log2(len(rising)) + np.log2(np.e)
    assert (len(unary) + len(rest)) * 8 / len(rising) < least + 0.4


def test_shape_grows_slowly():
    for rows in (0, 1, 1000, 10**6, 10**9, 10**12):
        bits, owners = shape_of(rows, 200)
        assert rows <= 1 << bits <= 1 << 63 and 0 <= owners < bits
        assert 1 << owners <= max(256, 4 * rows // exact.OWNER_PRINTS)


def plain(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    out = []
    for key, text in rows:
        keys = [k for k in groups[text or ""] if k is not None]
        out.append((key, max(keys, default=None), len(groups[text or ""]), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str), groups


def compare(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = mark_duplicates(df).collect()
    want, groups = plain(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [f"text {i} " + "w" * int(rng.integers(0, 50)) for i in range(300)] + ["", None, "é\x00ü", "x" * 2_000_000]
    rows = [(int(i), texts[int(t)]) for i, t in enumerate(rng.integers(0, len(texts), 1500))]
    compare(spark, rows + [(None, None), (None, "alone"), (7, "alone"), (7, "alone"), (None, "no key"), (None, "no key")])


@pytest.mark.parametrize("parts", [1, 7])
def test_hot_text(spark, parts):
    compare(spark, [(i, "hot" if i % 3 else f"own {i}") for i in range(20_000)], parts)


def test_wrong_suspects_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact, "shape_of", lambda rows, parallel: (6, 2))
    compare(spark, [(i, f"text {i % 400}") for i in range(900)])


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK_BITS", 6)
    compare(spark, [(i, f"text {i % 777}") for i in range(2000)], 3)


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert mark_duplicates(empty).collect() == [] and drop_duplicates(empty).collect() == []
    rows = [(1, "a", "q", 5), (2, "a", None, 6), (3, None, "r", 7), (3, "", "s", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, kept int")
    got = drop_duplicates(df)
    assert got.columns == df.columns
    found = got.collect()
    assert (2, "a", None, 6) in [tuple(r) for r in found] and len(found) == 2
    assert {r.doc_id for r in found} == {2, 3}


def test_no_text_moves_for_the_bitmaps(spark, tables):
    """The join of rows and bitmaps reads buckets; texts are shuffled only by their own bytes."""
    plans = []
    real = exact.materialise

    def seen(df, name, *rest):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name, *rest)

    exact.materialise = seen
    try:
        mark_duplicates(spark.read.parquet(f"{tables}/documents.parquet"))
    finally:
        exact.materialise = real
    plan = dict(plans)["exact-flagged"]
    left = plan[plan.index("FileScan") :] if "FileScan" in plan else plan
    assert "Bucketed: true" in plan, left
    assert "Bucketed: true" in dict(plans)["exact-messages"]
