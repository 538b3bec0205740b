"""The block-wise CSV reader against the sequential one."""

import csv

import pytest

from affinium.sources import catalog as cat
from affinium.sources import split_csv


def write_csv(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as handle:
        writer = csv.writer(handle, lineterminator=end)
        writer.writerow(["Title", "Plot\nor more", "Genre"])
        writer.writerows(rows)


def awkward_rows(n, tag):
    plots = ["plain", 'said "so"', "two\nlines", '"\n"\n""', "a\n\nb, c\n", "", "ü\n" * 40, "x" * 300]
    return [[f"{tag}{at}", plots[at * 7 % len(plots)], "A,B" if at % 3 else ""] for at in range(n)]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_rows_in_order(spark, tmp_path, small_blocks, end):
    rows = awkward_rows(90, "a") + [["long", "line\n" * 900, "C"]] + awkward_rows(20, "b")
    folder = tmp_path / "dump.csv"
    folder.mkdir()
    write_csv(folder / "part-0.csv", rows, end)
    write_csv(folder / "part-1.csv", awkward_rows(5, "c"), end)
    write_csv(folder / "part-2.csv", [], end)
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
    got = split_csv.read_records(spark, str(folder)).orderBy("row_id").collect()
    want = [tuple(value or None for value in row) for row in rows + awkward_rows(5, "c")]
    assert [row["row_id"] for row in got] == list(range(len(want)))
    assert [tuple(row)[1:] for row in got] == want
    sequential = cat.read_table(spark, str(folder))
    assert sequential.columns == got[0].__fields__[1:]
    if end == "\n":  # with \r\n the sequential reader leaves a carriage return in the last field
        assert sorted(map(repr, map(tuple, sequential.collect()))) == sorted(repr(tuple(row)[1:]) for row in got)


def test_catalog_from_blocks(spark, tmp_path, small_blocks):
    path = tmp_path / "films.csv"
    with open(path, "w", newline="", encoding="utf-8") as handle:
        writer = csv.writer(handle, lineterminator="\n")
        writer.writerow(["Title", "Year", "Genre", "Description"])
        writer.writerows([[f"t{at % 30}", str(1990 + at % 7), "A, B", f"line\nof {at}\n"] for at in range(300)])
    split = cat.load_catalog(spark, str(path), split=True)
    assert split.count() == 210 and split.exceptAll(cat.load_catalog(spark, str(path))).isEmpty()


def test_blank_lines_short_rows_and_no_rows(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('a,b,row_id\n\n1,2,9\n  \n3\n"4\n\n",5,8')
    got = split_csv.read_records(spark, str(path)).orderBy("row_id").collect()
    assert [tuple(row) for row in got] == [(0, "1", "2"), (1, "3", None), (2, "4\n\n", "5")]
    path.write_text("a,b\n")
    assert split_csv.read_records(spark, str(path)).count() == 0
