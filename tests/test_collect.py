"""Landed responses, sequential collection semantics and incremental ingest."""

import json
import random

import pytest
from pyspark.sql import functions as F

from affinium.operators import collecting
from affinium.plans import runs
from affinium.plans.registered import gather
from affinium.plans.registered.runs import run_collect
from affinium.sources import landed as ld
from affinium.sources import tables as tb
from affinium.sources.store import append_snapshot
from affinium.streaming import ingest as st


def bodies(spark, rows, first="requested string"):
    return spark.createDataFrame([(key, json.dumps(body) if not isinstance(body, str) else body) for key, body in rows],
                                 f"{first}, body string")


def test_film_records(spark):
    landed = bodies(spark, [
        ("a", {"Response": "True", "Title": "A", "Year": "1999", "Genre": "Drama", "Plot": "p", "Ratings": [1]}),
        ("b", {"Response": "True", "Title": "B"}),
        ("c", {"Response": "False", "Error": "not found"}),
        ("d", "<html>"),
    ])
    rows = {r["requested"]: tuple(r)[1:] for r in ld.film_records(landed).collect()}
    assert rows == {"a": ("A", "1999", "Drama", "p"), "b": ("B", "N/A", "N/A", "N/A")}


def page(title, item=None, missing=False, extract="text"):
    body = {"title": title, "extract": extract}
    if missing:
        body["missing"] = ""
    if item:
        body["pageprops"] = {"wikibase_item": item, "other": "x"}
    return {"query": {"pages": {"7": body}}}


def claim(**value):
    return {"mainsnak": {"datavalue": {"value": value}}}


def test_page_records(spark):
    pages = ld.valid_pages(bodies(spark, [
        ("One (film)", page("One (film)", "Q1", extract="e" * 501)), ("One", page("One", "Q9")),
        ("Two (film)", page("Two (film)", missing=True)), ("Two", page("Two", "Q2")),
        ("Three (film)", page("Three (film)")), ("Three", page("Three", missing=True)),
        ("Four (film)", page("Four (film)", "Q4")), ("Four", page("Four", "Q44")),
        ("Five", page("Five")), ("Five (1990 film)", page("Five (1990 film)", "Q5")),
    ], "candidate string"))
    claims = ld.item_claims(bodies(spark, [
        ("Q1", {"entities": {"Q1": {"claims": {
            "P577": [claim(time="+1999-03-31T00:00:00Z"), claim(time="+2001-01-01T00:00:00Z")],
            "P57": [claim(id="D2"), claim(id="D1"), claim(id="D1"), {"mainsnak": {}}],
            "P136": [claim(id="none"), claim(id="G1")], "P18": [claim(text=["a"])]}}}}),
        ("Q2", {"entities": {}}),
        ("Q4", "{broken"), ("Q44", {"entities": {"Q44": {"claims": {}}}}), ("Q5", {"entities": {"Q5": {"claims": {}}}}),
    ], "item string"))
    labels = ld.entity_labels(bodies(spark, [
        (e, {"entities": {e: {"labels": {"en": {"value": name}}}}}) for e, name in
        (("D1", "Ann"), ("D2", "Bo"), ("G1", "drama"))
    ] + [("none", {"entities": {"none": {"labels": {}}}})], "entity string"))
    requests = spark.createDataFrame(
        [("One", None), ("Two", None), ("Three", None), ("Four", None), ("Five", 1990), ("Six", None)],
        "requested string, year int")
    rows = {r["requested"]: r for r in ld.page_records(requests, pages, claims, labels).collect()}
    assert set(rows) == {"One", "Two", "Five"}  # Four's first page decides, its claims are broken
    one = rows["One"]
    assert (one["Title"], one["Year"], one["Director"], one["Genre"]) == ("One", "1999", "Bo, Ann, Ann", "drama")
    assert one["Description"] == "e" * 500 + "..."
    assert one["Wikipedia_URL"].endswith("/One%20%28film%29")
    assert (rows["Two"]["Year"], rows["Two"]["Director"], rows["Two"]["Genre"]) == ("N/A",) * 3
    assert rows["Five"]["Title"] == "Five (1990 film)"


def sequential(records, known):
    """The one-by-one rule, spelled out."""
    known, accepted = {k.lower() for k in known}, []
    for seq, requested, title in records:
        if requested.lower() in known or title.lower() in known:
            continue
        accepted.append(seq)
        known |= {requested.lower(), title.lower()}
    return accepted


@pytest.mark.parametrize("seed", range(3))
def test_new_records(spark, seed):
    rng = random.Random(seed)
    names = [f"{c}{i}" for i in range(6) for c in "aAbB"]
    records = [(at, rng.choice(names), rng.choice(names)) for at in range(60)]
    known = rng.sample(names, 2)
    df = spark.createDataFrame(records, "seq long, requested string, Title string").repartition(4)
    titles = collecting.known_titles(spark.createDataFrame([(k,) for k in known], "t string"))
    got = collecting.new_records(df, titles).collect()
    assert sorted(r["seq"] for r in got) == sequential(records, known)


def test_new_records_chain(spark):
    """Each record conflicts with the next, so settling takes several rounds."""
    records = [(at, f"t{at}", f"t{at + 1}") for at in range(8)]
    df = spark.createDataFrame(records, "seq long, requested string, Title string")
    none = spark.createDataFrame([], "known string")
    got = sorted(r["seq"] for r in collecting.new_records(df, none).collect())
    assert got == sequential(records, []) == [0, 2, 4, 6]


def test_hot_title(spark):
    """A third of the requests name one title; one record survives."""
    df = spark.range(300).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("t"), "id")).alias("requested"),
    ).withColumn("Title", F.col("requested"))
    got = collecting.new_records(df, spark.createDataFrame([], "known string"))
    assert got.count() == 201 and got.filter("Title = 'Hot'").first()["seq"] == 0


def test_clean_and_write(spark, tmp_path):
    records = spark.createDataFrame(
        [(0, "A", "1999", "g", "x"), (1, "A", "1999", "g", "later"), (2, "B", "N/A", "g", "x"), (3, "C", "2000", "", "x"),
         (4, "D", "2000", "g", " N/A")],
        "seq long, Title string, Year string, Genre string, Description string")
    rows = collecting.clean_records(records).orderBy("seq").collect()
    assert [(r["Title"], r["Description"]) for r in rows] == [("A", "x"), ("D", " N/A")]
    requests = records.select(F.col("Title").alias("requested")).filter("requested <> 'D'")
    with_request = records.withColumn("requested", F.col("Title"))
    none = spark.createDataFrame([], "known string")
    target = str(tmp_path / "out")
    assert runs.collect(requests, with_request, none, target, str(tmp_path / "raw"))
    assert [r["Title"] for r in spark.read.csv(target, header=True).collect()] == ["A"]
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 3
    everything = collecting.known_titles(records.select("Title"))
    assert not runs.collect(requests, with_request, everything, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_failed_titles(spark):
    requests = spark.createDataFrame([("a",), ("b",)], "requested string")
    records = spark.createDataFrame([("a", "A")], "requested string, Title string")
    assert [r[0] for r in collecting.failed_titles(requests, records).collect()] == ["b"]


def test_snapshots_append(spark, tmp_path):
    records = spark.createDataFrame([("A",)], "Title string")
    for _ in range(2):
        append_snapshot(records, str(tmp_path / "s"))
    rows = spark.read.parquet(str(tmp_path / "s"))
    assert rows.count() == 2 and rows.filter("ingest_ts is null or ingest_date is null").isEmpty()


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"seq": seq, "requested": title, "body": json.dumps({"Response": "True", "Title": canonical})})
             for seq, title, canonical in rows]
    (folder / name).write_text("\n".join(lines))


def test_incremental_ingest(spark, tmp_path):
    source, target, checkpoint = tmp_path / "landed", str(tmp_path / "out"), str(tmp_path / "check")

    def run(where=checkpoint, ignore=None):
        st.ingest(st.read_landed(spark, str(source), 1), target, where, ignore).awaitTermination()
        return sorted((r["seq"], r["Title"]) for r in spark.read.parquet(target).collect())

    land(source, "a.json", [(0, "One", "One"), (1, "one", "ONE"), (2, "Known", "Known")])
    ignore = collecting.known_titles(spark.createDataFrame([("KNOWN",)], "t string"))
    assert run(ignore=ignore) == [(0, "One")]
    assert run(ignore=ignore) == [(0, "One")]
    land(source, "b.json", [(3, "ONE", "One"), (4, "Two", "Two"), (5, "deux", "Two")])
    assert run(ignore=ignore) == [(0, "One"), (4, "Two")]
    # A new stream over the same folder starts at batch 0 and adds nothing.
    assert run(str(tmp_path / "check2"), ignore) == [(0, "One"), (4, "Two")]


@pytest.fixture
def part_folder(spark, tmp_path):
    """Tables of three parts, all of which have an English description."""
    rows = {
        "part": ([(i, f"hot bolt {i}", "Brand#1", "SMALL", 3, 1.0) for i in range(3)], tb.SCHEMAS["part"]),
        "lineitem": ([], tb.SCHEMAS["lineitem"]),
        "supplier": ([(1, "S", 1, 1.0)], tb.SCHEMAS["supplier"]),
        "documents": ([(i, f"text {i}", "en", "src1", 6) for i in range(3)], tb.SCHEMAS["documents"]),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_run_collect_without_anything_new(spark, part_folder):
    """All titles are known: an empty table instead of a missing path."""
    got = run_collect(spark, part_folder)
    assert got.collect() == [] and got.columns == ["Title", "Year", "Genre", "Description"]


def test_landed_files_follow_the_rows(spark, part_folder, monkeypatch):
    """str1 deals its responses to more files as the table grows, and still takes them in two batches."""
    seen = []
    read = st.read_landed

    def spy(session, folder, files_per_batch):
        seen.append((files_per_batch, session.read.json(folder).select(F.input_file_name()).distinct().count()))
        return read(session, folder, files_per_batch)

    spark.range(40).select(F.col("id").alias("p_partkey"), F.concat(F.lit("t "), "id").alias("p_name"), F.lit("B").alias("p_brand"),
                           F.lit("SMALL").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice")
                           ).write.mode("overwrite").parquet(f"{part_folder}/part.parquet")
    monkeypatch.setattr(gather, "LANDED_ROWS", 4)
    monkeypatch.setattr(st, "read_landed", spy)
    got = gather.str1(spark, part_folder)
    assert got.count() == 37
    assert seen[0][0] == 5 and 5 <= seen[0][1] <= 10
