"""Benchmark decontamination against a plain window search."""

import hashlib
import random
import time
import re

import pytest

from affinium.llm import decontaminate as module
from affinium.llm.decontaminate import Automaton, decontaminate, find_leaks
from affinium.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(documents, items, window):
    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add("null" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for key, text in documents:
        words, hit, found = words_of(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                items_here = windows.get(tuple(words[i : i + size]))
                if items_here:
                    hit.update(range(i, i + size))
                    found |= items_here
        out.append((key, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


def of(found):
    return sorted(
        ((r[0], r.n_words, sum(s.stop - s.start for s in r.spans), list(r["items"])) for r in found.collect()), key=str
    )


def test_query(spark, tables):
    read = lambda name, *columns: [
        tuple(r) for r in spark.read.parquet(f"{tables}/{name}.parquet").select(*columns).collect()
    ]
    want = brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"), 10)
    got = QUERIES["op3_benchmark_decontamination"](spark, tables).collect()
    assert any(n for _, _, n, _ in want)
    assert sorted(map(tuple, got), key=str) == sorted(
        ((k, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for k, n, h, i in want), key=str
    )


@pytest.mark.parametrize("seed", range(20))
def test_automaton(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 2, 3, 5])
    items = [(i, [rng.choice("abc") for _ in range(rng.randint(1, 12))]) for i in range(6)]
    document = [rng.choice("abcd") for _ in range(200)]
    machine = Automaton(items, window)
    spans, found = machine.scan([machine.numbers.get(w, -1) for w in document])
    (_, _, hit, names), = brute([(0, " ".join(document))], [(i, " ".join(w)) for i, w in items], window)
    assert sum(b - a for a, b in spans) == hit
    assert sorted(str(machine.items[i]) for i in found) == names


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again today"), (2, "two words"), (3, "Ünïque"),
         (4, None), (5, ""), (6, "... !!!"), (None, "no item id here"), (2, "two words"), (7, "brown fox jumps")]
DOCUMENTS = [(1, "intro. The QUICK brown-fox jumps, over the lazy dog again; and again today! outro"), (2, "two  words"),
             (3, None), (4, ""), (5, "ünïque Ünïque"), (6, "quick brown fox"), (2, "two  words"),
             (None, "no item id here"), (7, "x " * 30_000 + "brown fox jumps"), (8, "two, Words two words")]


@pytest.mark.parametrize("chars", [1 << 19, 20])
def test_odd_rows(spark, monkeypatch, chars):
    monkeypatch.setattr(module, "BLOCK_CHARS", chars)
    documents = spark.createDataFrame([(k, t, "s", 1) for k, t in DOCUMENTS], "doc_id long, text string, spans string, key int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert of(find_leaks(documents, items)) == brute(DOCUMENTS, ITEMS, 10)


def test_cut_and_drop(spark):
    documents = spark.createDataFrame(
        [(1, "keep this part of it and two words in here", "a"), (2, "two words", "b"), (3, None, "c"), (4, "clean", None)],
        "doc_id long, text string, items string",
    )
    items = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    got = decontaminate(documents, items)
    assert got.columns == documents.columns
    assert sorted(map(tuple, got.collect())) == [
        (1, "keep this part of it and  in here", "a"), (3, None, "c"), (4, "clean", None)
    ]


def test_empty_tables(spark):
    documents = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert of(find_leaks(documents.limit(0), items)) == []
    assert of(find_leaks(documents, items.limit(0))) == [(1, 2, 0, [])]


def test_equal_words_take_linear_time():
    """An item and a document of one word, over and over: no climb per word."""
    started = time.monotonic()
    machine = Automaton([("long", ["a"] * 20_000), ("short", ["a"] * 3), ("other", ["a", "b"] * 10_000)], 10)
    spans, found = machine.scan([0] * 80_000)
    assert spans == [(0, 80_000)] and sorted(machine.items[i] for i in found) == ["long", "short"]
    assert time.monotonic() - started < 5


def test_clashing_names_and_nulls(spark):
    documents = spark.createDataFrame([(None, "two words here", 1), (None, "two words", 2), (5, None, 3)], "_row long, _text string, key int")
    items = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    got = decontaminate(documents, items, text="_text")
    assert got.columns == documents.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(5, None, 3)], key=str)
    assert sorted(r.key for r in decontaminate(documents, items, text="_text", most_covered=0.9).collect()) == [1, 3]
