"""Vocabularies, statistics and encoding."""

import math

import pytest
from pyspark.sql import functions as F

from affinium.operators import encoding as enc

SCHEMA = (
    "row_id long, title string, year double, genres array<string>, description string, director string, "
    "rating double, writer string, duration double, votes double, cast array<string>"
)


def items(spark, rows):
    default = {"title": "t", "year": None, "genres": [], "description": "d", "director": "<missing>", "rating": None,
               "writer": "<missing>", "duration": None, "votes": None, "cast": []}
    names = ["title", "year", "genres", "description", "director", "rating", "writer", "duration", "votes", "cast"]
    data = [(at, *[(default | row)[name] for name in names]) for at, row in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def test_vocabularies(spark):
    train = items(spark, [
        {"genres": ["b", "a"], "director": "x", "cast": ["p", "p", "q"]},
        {"genres": ["c"], "director": "x", "cast": ["r"]},
        {"genres": ["a"], "director": "w", "writer": "z"},
        {},
    ])
    vocab = enc.fit_encoder(train).vocab.collect()
    table = {}
    for row in vocab:
        table.setdefault(row["field"], {})[row["value"]] = row["idx"]
    assert table == {
        "genres": {"a": 0, "b": 1, "c": 2}, "director": {"x": 1, "w": 2}, "writer": {"z": 1},
        "cast": {"p": 0, "q": 1, "r": 2},
    }
    assert enc.fit_encoder(train).sizes() == {"genres": 3, "director": 3, "writer": 2, "cast": 3}


def test_vocabulary_cap(spark):
    people = spark.range(2001).select(
        F.explode(F.array_repeat(F.format_string("d%05d", "id"), 2)).alias("director")
    )
    last = people.filter("director < 'd02000'").union(spark.createDataFrame([("d02000",)], "director string"))
    vocab = enc.people_vocabulary(last, "director")
    assert vocab.count() == 2000
    assert vocab.filter("value = 'd02000'").isEmpty()
    assert vocab.agg(F.min("idx"), F.max("idx")).first()[:] == (1, 2000)


def test_stats_defaults(spark):
    empty = enc.fit_stats(items(spark, [{}])).first()
    assert empty.asDict() == {
        "year_min": 1900.0, "year_max": 2025.0, "rating_mean": 6.5, "rating_std": 1.5, "duration_mean": 100.0,
        "duration_std": 40.0, "votes_log_mean": 10.0, "votes_log_std": 2.0,
    }
    single = enc.fit_stats(items(spark, [{"rating": 3.0}])).first()
    assert (single["rating_mean"], single["rating_std"]) == (3.0, 1.5)
    flat = enc.fit_stats(items(spark, [{"rating": 3.0}, {"rating": 3.0}])).first()
    assert flat["rating_std"] == 1.5


def test_null_lists_encode_as_empty(spark):
    state = enc.fit_encoder(items(spark, [{"genres": ["a"], "cast": ["p"]}]))
    one = items(spark, [{"genres": ["a"]}]).withColumns({f: F.lit(None).cast("array<string>") for f in ("genres", "cast")})
    row = enc.encode(one, state).first()
    assert (row["genre_idx"], row["cast_idx"]) == ([], [])


def test_encode(spark):
    train = items(spark, [
        {"year": 1990.0, "genres": ["a", "b"], "director": "x", "rating": 1.0, "votes": 9.0, "cast": ["p"]},
        {"year": 2000.0, "genres": ["c"], "director": "y", "rating": 3.0, "votes": 99.0, "cast": ["q", "p"]},
    ])
    state = enc.fit_encoder(train)
    test = items(spark, [
        {"year": 1980.0, "genres": ["c", "zzz", "a", "c"], "director": "y", "rating": 3.0, "cast": ["q"]},
        {"director": "nobody", "writer": "nobody", "cast": ["nobody"]},
    ])
    one, two = enc.encode(test, state).orderBy("row_id").collect()
    assert (one["genre_idx"], one["cast_idx"], one["director_idx"]) == ([0, 2], [1], 2)
    assert (one["year_n"], two["year_n"]) == (0.0, 0.5)
    assert one["rating_n"] == pytest.approx(1 / math.sqrt(2))
    assert (two["genre_idx"], two["cast_idx"], two["director_idx"], two["writer_idx"]) == ([], [], 0, 0)
    assert (two["rating_n"], two["duration_n"]) == (0.0, 0.0)
    logs = [math.log1p(9), math.log1p(99)]
    mean = sum(logs) / 2
    std = math.sqrt(sum((x - mean) ** 2 for x in logs))
    assert two["votes_n"] == pytest.approx((0 - mean) / std)


def test_state_round_trip(spark, tmp_path):
    train = items(spark, [{"genres": ["a"], "director": "x", "year": 1990.0}])
    state = enc.fit_encoder(train)
    state.save(str(tmp_path / "state"))
    loaded = enc.EncoderState.load(spark, str(tmp_path / "state"))
    assert sorted(map(tuple, loaded.vocab.collect())) == sorted(map(tuple, state.vocab.collect()))
    assert loaded.stats.first() == state.stats.first()


def test_encoding_lists_takes_one_explode(spark, tmp_path):
    """All list columns go through one explode, whatever the vocabulary's size."""
    train = items(spark, [{"genres": ["a"], "cast": ["p"], "director": "x", "writer": "y"}])
    enc.fit_encoder(train).save(str(tmp_path / "state"))
    frame = enc.encode(train, enc.EncoderState.load(spark, str(tmp_path / "state")))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "NestedLoop" not in plan
    assert "BroadcastHashJoin" in plan
