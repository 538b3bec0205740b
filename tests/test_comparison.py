"""Settings of all runs side by side."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check_oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from affinium import fixed  # noqa: E402
from affinium.operators import comparison  # noqa: E402

NAME = "jn10_settings_table"


def written(spark, folder, sources):
    """Documents of the given sources, in languages that take turns."""
    rows = [(at, source, "en" if at % 2 else None) for at, source in enumerate(sources)]
    path = str(folder / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, source string, lang string").coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{path}/*.parquet'")
    return db


def test_one_row_per_setting_and_a_column_for_every_source(spark, tmp_path):
    names = [f"site {at}" for at in range(25)] + ["src0", None]
    db = written(spark, tmp_path, names + ["src0", "src0", None])
    table = entry.queries()[NAME](spark, str(tmp_path))
    rows = {row["setting"]: row.asDict() for row in table.collect()}
    assert table.columns == ["setting", "null"] + sorted(names[:25]) + ["src0"]
    assert table.count() == len(rows) and set(rows) == set(fixed.COMPARED_SETTINGS)
    assert (rows["epochs"]["src0"], rows["epochs"]["null"], rows["epochs"]["site 24"]) == ("3", "2", "1")
    assert (rows["data"]["site 24"], rows["data"]["null"], rows["seed"]["null"]) == ("site 24", "-", "42")
    assert check_oracle.compare(spark, db, NAME, entry.queries()[NAME], entry.oracle_sql()[NAME], str(tmp_path)).startswith("ok")


@pytest.mark.parametrize("sources, columns", [
    ([], []),
    ([None], ["null"]),
    (["a.b", "c`d"], ["a.b", "c`d"]),
    (["a", "A", None, "null"], ["1:null", "2:A", "3:a", "4:null"]),
    (["x", ""], ["1:", "2:x"]),
    (["x", "Setting"], ["1:Setting", "2:x"]),
])
def test_no_source_hides_another(spark, tmp_path, sources, columns):
    db = written(spark, tmp_path, sources)
    table = entry.queries()[NAME](spark, str(tmp_path))
    assert table.columns == ["setting"] + columns
    table.write.parquet(str(tmp_path / "out"))
    assert check_oracle.compare(spark, db, NAME, entry.queries()[NAME], entry.oracle_sql()[NAME], str(tmp_path)).startswith("ok")


def test_found_runs_as_given_ones(spark):
    configs = spark.createDataFrame([("b", 3, None), ("a", None, "x"), ("c", 5, "y")], "run string, epochs long, data string")
    found = comparison.settings_table(configs, fixed.COMPARED_SETTINGS)
    given = comparison.settings_table(configs, fixed.COMPARED_SETTINGS, ["a", "b", "c"])
    assert found.schema == given.schema
    assert sorted(found.collect()) == sorted(given.collect())
