"""Scalar functions on literal edge cases."""

import pytest
from pyspark.sql import functions as F

from affinium.functions import text as tx
from affinium.functions import vectors as vec


def values(spark, function, inputs, kind="string"):
    rows = [(at, value) for at, value in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"at int, v {kind}").select("at", function(F.col("v")).alias("out"))
    return [row["out"] for row in df.orderBy("at").collect()]


def test_missing_tokens(spark):
    assert values(spark, tx.na_to_null, ["N/A", "None", "null", "nan", "", " N/A", "none", None]) == (
        [None] * 5 + [" N/A", "none", None]
    )


def test_year(spark):
    texts = ["Mar 22, 1996", "1996.0", "12345 1999", "0999 2101", "x1800y2100", "1799 1996", "", None]
    assert values(spark, tx.year_of, texts) == [1996.0, 1996.0, 1999.0, None, 1800.0, 1996.0, None, None]


def test_split_list(spark):
    texts = [" Drama, ,N/A,n/a,Action ", None, "A,A", " B\t,C"]
    assert values(spark, tx.split_list, texts) == [["Drama", "Action"], [], ["A", "A"], ["B", "C"]]


def test_strip_is_unicode_aware(spark):
    assert values(spark, tx.strip, [" \tx y　\n", "\x1c z", "  "]) == ["x y", "z", ""]


def test_number(spark):
    texts = ["16,000", " 12 ", "1e3", ".5", "5.", "1.5d", "0x10", "1_000", "True", "nan", "inf", "1e999", "-2.5", None]
    assert values(spark, tx.number_of, texts) == (
        [None, 12.0, 1000.0, 0.5, 5.0] + [None] * 7 + [-2.5, None]
    )


def test_duration(spark):
    assert values(spark, tx.duration_of, ["142 min", "1 h 30 m", "n", None]) == [142.0, 1.0, None, None]


def test_shorten(spark):
    assert values(spark, tx.shorten, ["a" * 500, "a" * 501]) == ["a" * 500, "a" * 500 + "..."]


def test_page_url(spark):
    expected = "https://en.wikipedia.org/wiki/A%20b/c%2A~%28x%29%C3%A9%21"
    assert values(spark, tx.page_url, ["A b/c*~(x)é!"]) == [expected]


def test_page_name(spark):
    assert values(spark, tx.page_name, ["X (film)", "A (film) B (film)", "Y (1999 film)"]) == [
        "X", "A B", "Y (1999 film)"
    ]


def test_claim_year(spark):
    assert values(spark, tx.claim_year, ["+1999-03-31T00:00:00Z", "2001-01-01", "", None]) == [
        "1999", "2001", "N/A", "N/A"
    ]


def test_primary_category(spark):
    lists = [["A", "B"], [], [" "], None]
    assert values(spark, tx.primary_category, lists, "array<string>") == ["A"] + ["Unknown"] * 3


def test_display_label(spark):
    df = spark.createDataFrame([("T", 1999.0), ("T", None)], "t string, y double")
    labels = df.select(tx.display_label(F.col("t"), F.col("y")).alias("l")).collect()
    assert [row["l"] for row in labels] == ["T (1999)", "T"]


def test_plot_attributes(spark):
    for function, expected in (
        (tx.marker_size, [8.0, 28.0, 4.0]), (tx.marker_alpha, [0.05, 1.0, 0.05]), (tx.line_alpha, [0.05, 0.7, 0.05])
    ):
        assert values(spark, function, [0.0, 1.0, -0.2], "double") == pytest.approx(expected)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    rows = df.select(vec.dot(a, b), vec.norm(a), vec.cosine(a, b), vec.unit(b)).collect()
    assert list(rows[0]) == [0.0, 5.0, 0.0, [0.0, 0.0]]
    assert list(rows[1]) == [2.0, 1.0, 1.0, [1.0, 0.0]]


def test_overlap_ratio(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    ratios = [row[0] for row in df.select(vec.overlap_ratio(F.col("a"), F.col("b"))).collect()]
    assert ratios == pytest.approx([1 / 3, 0.0])
