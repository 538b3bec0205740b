"""The commands end to end on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from affinium.operators.textvec import HashedTextEncoder
from affinium.plans import runs
from affinium.sources import tables as tb
from affinium.sources.store import Run, flat, from_flat

TEXT = HashedTextEncoder(32)


@pytest.fixture(scope="module")
def trained(spark, tables, tmp_path_factory):
    paths = []
    for seed in (42, 7):
        path = str(tmp_path_factory.mktemp("run") / f"seed{seed}")
        runs.train(spark, tb.catalog(spark, tables), path, TEXT, epochs=2, embed_dim=16, batch_size=32, seed=seed, rounds=1)
        runs.build_index(spark, path, encoder=TEXT)
        runs.evaluate(spark, path, TEXT)
        paths.append(path)
    return paths


def test_splits(spark, tables, trained):
    sizes = {r["split"]: r["count"] for r in Run(spark, trained[0]).splits().groupBy("split").count().collect()}
    total = tb.catalog(spark, tables).count()
    assert sizes["test"] == sizes["val"] == int(total * 0.15) and sum(sizes.values()) == total


def test_index_and_evaluation(spark, tables, trained):
    run = Run(spark, trained[0])
    assert run.index().count() == tb.catalog(spark, tables).count()
    report = run.evaluation()
    assert report.count() == 45
    rates = {r["metric"]: r["value"] for r in report.filter("variant = 'trained'").collect()}
    assert rates["HitRate@1"] <= rates["HitRate@5"] <= rates["HitRate@10"]
    assert all(0 <= v <= 1 for v in rates.values())


def test_similar_and_search(spark, trained):
    found = runs.similar(spark, trained[0], "ring", 5).collect()
    assert len(found) == 5
    scores = [r["score"] for r in found]
    assert scores == sorted(scores, reverse=True)
    assert runs.search(spark, trained[0], "the thing", 4, TEXT).count() == 4
    texts = spark.createDataFrame([(1, "the thing"), (2, "other")], "q_id long, description string")
    many = runs.search_many(spark, trained[0], texts, 4, TEXT)
    one = runs.search(spark, trained[0], "the thing", 4, TEXT).collect()
    batch = many.filter("q_id = 1").orderBy("rank").collect()
    assert [r["score"] for r in batch] == pytest.approx([r["score"] for r in one], abs=1e-6)
    with pytest.raises(KeyError):
        runs.similar(spark, trained[0], "no such title", 5)


def test_compare(spark, trained):
    tables = runs.compare(spark, trained, ["ring", "no such title"], 5)
    settings = {r["setting"]: r for r in tables["settings"].collect()}
    assert settings["seed"][trained[0]] == "42" and settings["seed"][trained[1]] == "7"
    assert settings["hidden_dim"][trained[0]] == "256"
    assert tables["comparable"].first()["comparable"] is False
    assert tables["metrics"].count() == 45
    overlap = tables["overlap"].collect()
    assert [r["query"] for r in overlap] == ["ring"] and 0 <= overlap[0]["jaccard"] <= 1
    assert runs.compare(spark, [trained[0], trained[0]])["comparable"].first()["comparable"] is True


def test_map(spark, trained):
    assert runs.map_index(spark, trained[0], 50).count() == 50


def test_missing_run(spark, tmp_path):
    for command in (runs.evaluate, runs.build_index):
        with pytest.raises(FileNotFoundError):
            command(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        Run(spark, str(tmp_path / "none")).evaluation()


def test_stale_index(spark, trained):
    run = Run(spark, trained[1])
    config = run.config()
    run.save_config(config | {"embed_dim": 99})
    with pytest.raises(RuntimeError, match="stale"):
        runs.similar(spark, trained[1], "ring")
    run.save_config(config)


def test_flat_round_trip(spark, tables):
    items = tb.catalog(spark, tables)
    back = from_flat(flat(items)).select(items.columns)
    assert back.exceptAll(items).isEmpty()


def test_titles_named_none_survive(spark, tmp_path):
    run = Run(spark, str(tmp_path / "run"))
    run.save_index(spark.createDataFrame([(0, "None", [1.0])], "row_id long, title string, embedding array<float>"))
    row = run.index().select("title", F.size("cast").alias("n")).first()
    assert tuple(row) == ("None", 0)


def test_text_model_is_bound_to_the_run(spark, trained):
    with pytest.raises(ValueError, match="text model"):
        runs.search(spark, trained[0], "the thing", 4, HashedTextEncoder(64))
    with pytest.raises(ValueError, match="text model"):
        runs.build_index(spark, trained[0], encoder=HashedTextEncoder(31))
    # Without an encoder the run's own is rebuilt.
    given = runs.search(spark, trained[0], "the thing", 4, TEXT).collect()
    assert runs.search(spark, trained[0], "the thing", 4).collect() == given
