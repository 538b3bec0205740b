"""Sharding: the table filled by brute force, its balance, few moves, and whole tables."""

import hashlib
from collections import Counter

import pytest

from affinium.llm.queries import QUERIES
from affinium.llm.sharding import SHARDS, TABLE_SIZE, assign_shards, fill_table, write_shards


def number(text):
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def plain(shards, size):
    """Every shard's whole order of preference, walked in turns."""
    order = {s: [(number(f"offset:{s}") + j * (number(f"stride:{s}") % (size - 1) + 1)) % size for j in range(size)]
             for s in shards}
    owners, at = {}, {s: iter(order[s]) for s in shards}
    while len(owners) < size:
        for s in sorted(shards):
            if len(owners) == size:
                break
            owners[next(p for p in at[s] if p not in owners)] = s
    return [shards.index(owners[i]) for i in range(size)]


@pytest.mark.parametrize(("names", "size"), [(["a"], 2), (["b", "a", "c"], 7), (["x", "y", "z", "w"], 101), (SHARDS[:9], 997)])
def test_table(names, size):
    assert fill_table(names, size) == plain(names, size)
    counts = Counter(fill_table(names, size))
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move():
    old, new = fill_table(SHARDS, TABLE_SIZE), fill_table(SHARDS[:-1], TABLE_SIZE)
    moved = sum(a != b for a, b in zip(old, new) if a != len(SHARDS) - 1)
    assert moved < 0.05 * TABLE_SIZE


@pytest.mark.parametrize(("names", "size"), [([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 8, 7), (["a"], 2_097_143)])
def test_refused(names, size):
    with pytest.raises(ValueError):
        fill_table(names, size)


def test_query(spark, tables):
    owners = plain(SHARDS[:3], 11)
    got = QUERIES["op2_shard_lookup"](spark, tables).collect()
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in got) == ids and len(owners) == 11
    table = fill_table(SHARDS, TABLE_SIZE)
    for r in got:
        assert r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % TABLE_SIZE
        assert r.shard == SHARDS[table[r.slot]]


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a", "q"), (1, "b", "q"), (None, "c", "q"), (None, "d", "q"), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = assign_shards(df, "doc_id", ["x", "y", "z"], 101, prefix="new_").collect()
    assert sorted(((r.doc_id, r.text, r.shard) for r in got), key=str) == sorted(rows, key=str)
    assert len({r.new_slot for r in got if r.doc_id == 1}) == 1
    assert len({r.new_slot for r in got if r.doc_id is None}) == 2
    assert assign_shards(df.limit(0), "doc_id").collect() == []
    write_shards(df, "doc_id", str(tmp_path / "out"), shards=["x", "y"], size=101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 5 and {r.shard for r in back.collect()} <= {"x", "y"}


def test_no_shuffle(spark, tables):
    plan = QUERIES["op2_shard_lookup"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_null_ids_spread(spark, tmp_path):
    rows = [(None, f"text {i}") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op2_shard_lookup"](spark, str(tmp_path)).collect()
    assert len({r.slot for r in got}) > 40
