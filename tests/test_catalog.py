"""Catalog ingest from files."""

import csv

import pytest
from pyspark.sql import functions as F

from affinium.sources import catalog as cat


def write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as handle:
        writer = csv.writer(handle)
        writer.writerow(header)
        writer.writerows(rows)
    return str(path)


def test_header_priority_and_last_duplicate():
    found = cat.resolve_headers(["Plot", " TITLE ", "Genres", "Genre", "Director", "Directed by", "title"])
    assert found["title"] == "title"
    assert found["genres"] == "Genre"
    assert found["description"] == "Plot"
    assert found["director"] == "Directed by"


@pytest.mark.parametrize("missing", ["Title", "Plot", "Genre"])
def test_required_headers(missing):
    with pytest.raises(ValueError):
        cat.resolve_headers([name for name in ("Title", "Plot", "Genre") if name != missing])


def test_collected_layout(spark, tmp_path):
    path = write_csv(
        tmp_path / "small.csv", ["Title", "Year", "Genre", "Description"],
        [
            ["One", "1999", "Drama, N/A", 'Line one\nsaid "so"'],
            [" \t", "2000", "Drama", "blank title survives"],
            ["None", "2001", "Drama", "missing title goes"],
            ["Two", "2002", "Drama", " n/A "],
            ["Three", "", "", " first "],
            ["Three", "N/A", "Action", "second"],
        ],
    )
    rows = cat.load_catalog(spark, path).orderBy("row_id").collect()
    assert [row["title"] for row in rows] == ["One", "", "Three"]
    assert rows[0]["description"] == 'Line one\nsaid "so"'
    assert rows[0]["genres"] == ["Drama"]
    assert rows[2]["description"] == "first" and rows[2]["year"] is None
    assert {row["director"] for row in rows} == {"<missing>"}
    assert all(row["rating"] is None and row["cast"] == [] for row in rows)


def test_ratings_layout(spark, tmp_path):
    path = write_csv(
        tmp_path / "16k.csv",
        ["Title", "Release Date", "Description", "Rating", "No of Persons Voted", "Directed by", "Written by",
         "Duration", "Genres"],
        [["One", "Mar 22, 1996", "x", "7.5", "16,000", " Ann ", "", "1 h 30 m", "A,B"],
         ["Two", "2101", "y", "bad", "12", "Bo", "Cy", "142 min", "B"]],
    )
    one, two = cat.load_catalog(spark, path).orderBy("row_id").collect()
    assert (one["year"], one["rating"], one["votes"], one["duration"]) == (1996.0, 7.5, None, 1.0)
    assert (one["director"], one["writer"]) == (" Ann ", "<missing>")
    assert (two["year"], two["rating"], two["votes"], two["duration"]) == (None, None, 12.0, 142.0)


def test_plot_layout(spark, tmp_path):
    path = write_csv(
        tmp_path / "wiki.csv", ["Release Year", "Title", "Director", "Cast", "Genre", "Plot"],
        [["1901", "One", "Ann", "Cy, Di,N/A", "drama", "story"]],
    )
    row = cat.load_catalog(spark, path).first()
    assert (row["year"], row["director"], row["cast"]) == (1901.0, "Ann", ["Cy", "Di"])


def test_first_valid_row_wins(spark, tmp_path):
    path = write_csv(
        tmp_path / "a.csv", ["Title", "Year", "Genre", "Description"],
        [["T", "1999", "A", "  "], ["T", "1999", "B", "kept"], ["T", "1999", "C", "later"]],
    )
    assert [row["genres"] for row in cat.load_catalog(spark, path).collect()] == [["B"]]


def test_row_ids_follow_file_order(spark, tmp_path):
    """Several files and several splits per file give one dense order."""
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for part in range(3):
        write_csv(folder / f"part-{part}.csv", ["Title", "Seq"],
                  [[f"t{part}-{at}", part * 1000 + at] for at in range(400 + 100 * part)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = spark.read.csv(str(folder), header=True)
        assert raw.rdd.getNumPartitions() > 3
        rows = cat.with_row_ids(raw).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [row["row_id"] for row in rows] == list(range(1500))
    assert [int(row["Seq"]) for row in rows] == [p * 1000 + at for p in range(3) for at in range(400 + 100 * p)]


def test_row_ids_survive_another_plan(spark, tmp_path):
    """Ids come from what was stored, so a scan that is split differently later changes nothing."""
    folder = tmp_path / "again.csv"
    folder.mkdir()
    for part in range(4):
        write_csv(folder / f"part-{part}.csv", ["Title"], [[f"t{part}-{at}"] for at in range(500)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        numbered = cat.with_row_ids(spark.read.csv(str(folder), header=True))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        rows = numbered.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(row["row_id"] for row in rows) == list(range(2000))
    assert [r["Title"] for r in sorted(rows)] == [f"t{part}-{at}" for part in range(4) for at in range(500)]


def test_given_row_ids_are_checked(spark, tmp_path):
    header = ["row_id", "Title", "Genre", "Description"]
    for ids in ([1, 1], [1, "x"], [1, ""]):
        path = write_csv(tmp_path / f"ids-{ids[1]}.csv", header, [[i, "t", "g", "d"] for i in ids])
        with pytest.raises(ValueError, match="row_id"):
            cat.load_catalog(spark, path)


def test_alias_and_titles(spark, tmp_path):
    path = write_csv(tmp_path / "small.csv", ["Title", "Year"], [["A", 1], ["B", 2]])
    assert cat.resolve_dataset("small", str(tmp_path)) == path
    assert cat.resolve_dataset("other.csv") == "other.csv"
    assert sorted(row["Title"] for row in cat.read_titles(spark, path).collect()) == ["A", "B"]
    assert cat.read_titles(spark, str(tmp_path / "absent.csv")).isEmpty()


def test_json_and_parquet_agree(spark, tmp_path):
    raw = spark.createDataFrame(
        [(0, "One", "1999", "A,B", "x", 7.5)], "row_id long, Title string, Year string, Genre string, Plot string, Rating double"
    )
    raw.write.parquet(str(tmp_path / "c.parquet"))
    raw.write.json(str(tmp_path / "c.json"))
    parquet = cat.load_catalog(spark, str(tmp_path / "c.parquet")).collect()
    json = cat.load_catalog(spark, str(tmp_path / "c.json")).collect()
    assert parquet == json


def test_baseline_filter(spark):
    raw = spark.createDataFrame([("a", " "), ("b", None), ("c", ""), ("d", "x")], "Title string, Description string")
    assert [row["Title"] for row in cat.with_any_description(raw).orderBy("Title").collect()] == ["a", "d"]


def test_nan_and_infinity_are_missing(spark):
    raw = spark.createDataFrame(
        [(0, "T", "A", "x", float("nan")), (1, "U", "A", "x", float("inf")), (2, "V", "A", "x", 2.0)],
        "row_id long, Title string, Genre string, Plot string, Rating double",
    )
    ratings = cat.normalise(raw).orderBy("row_id").select(F.col("rating")).collect()
    assert [row["rating"] for row in ratings] == [None, None, 2.0]
