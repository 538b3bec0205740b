"""Every registered query next to its SQL twin, and the shape of its plan."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check_oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def db(tables):
    return check_oracle.connect(tables)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, tables, name):
    result = check_oracle.compare(spark, db, name, QUERIES[name], entry.oracle_sql().get(name), tables)
    assert not result.startswith("FAIL"), result


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(QUERIES)


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()


@pytest.mark.parametrize("name", ["win1_first_per_key", "top4_batch_ranking", "agg7_relevant_counts",
                                  "agg8_retrieval_metrics", "enc1_multi_hot", "jn1_new_records", "src5_page_records"])
def test_no_nested_loops(spark, tables, name):
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["win1_first_per_key", "win2_rank_scores"])
def test_group_limit_before_the_shuffle(spark, tables, name):
    plan = QUERIES[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("WindowGroupLimit"):]
    assert plan.count("WindowGroupLimit") == 2


def test_pruned_scan(spark, tables):
    plan = QUERIES["win1_first_per_key"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "s_acctbal" not in plan and "l_discount" not in plan
