"""Language identification: Viterbi against brute force, held-out accuracy, mixed and odd texts."""

import itertools

import numpy as np
import pytest

from affinium.llm.language import Model, grams_of, identify, learn, viterbi
from affinium.llm.queries import QUERIES


@pytest.mark.parametrize("seed", range(8))
def test_viterbi(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 7, 12)
    scores = rng.standard_normal((counts.sum(), 3)).astype(np.float32)
    path, at = viterbi(scores, counts, 0.7), 0
    worth = lambda s, p: s[np.arange(len(p)), p].sum() - 0.7 * (np.diff(p) != 0).sum()
    for n in counts:
        here = scores[at : at + n]
        if n:
            best = max(worth(here, np.array(p)) for p in itertools.product(range(3), repeat=int(n)))
            assert worth(here, path[at : at + n]) == pytest.approx(best, abs=1e-4)
        at += n


def test_grams():
    owners, buckets, script = grams_of(["ab", "я", "漢"])
    # a b | ^a ab b$ | ^ab ab$ | ^ab$ and for one letter: x | ^x x$ | ^x$
    assert np.bincount(owners).tolist() == [8, 4, 4]
    assert len({*script.tolist()}) == 3
    assert grams_of(["ab"])[1].tolist() == buckets[owners == 0].tolist()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op4_language_id"](spark, folder).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


@pytest.fixture(scope="module")
def model(spark):
    texts = [("the house and the garden with that thing", "en"), ("there is nothing that they think of this", "en"),
             ("und das haus ist nicht der garten sich", "de"), ("die kirche mit einem buch auf dem tisch", "de"),
             ("и это дом который стоит на берегу", "ru"), ("он не знает что это такое", "ru"), (None, "en"), ("x", None)]
    df = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(texts * 5)], "doc_id long, text string, lang string, spans int")
    return learn(df)


def test_mixed_text(spark, model):
    assert model.languages == ["de", "en", "ru"]
    text = "the garden and that house with nothing, und das buch ist nicht auf dem tisch, и это дом который стоит"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = identify(df, model, penalty=4.0).collect()
    assert [s.lang for s in row.spans] == ["en", "de", "ru"]
    assert [(s.start, s.stop) for s in row.spans] == [(0, 7), (7, 15), (15, 20)]
    assert row.lang_pred == "en" and 0.3 < row.score < 0.6


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 ... !"), (4, "the"), (4, "the"), (None, "das und"), (5, "дом " * 40_000),
            (6, "漢字"), (7, "ДОМ")]
    df = spark.createDataFrame([(k, t, "q", 3) for k, t in rows], "doc_id long, text string, lang_pred string, key int")
    got = {(r.doc_id, r.lang_pred, r.score) for r in identify(df, model).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "en", 1.0), (None, "de", 1.0), (5, "ru", 1.0),
            (7, "ru", 1.0)} <= got
    assert len(identify(df, model).collect()) == len(rows)


def test_empty_tables(spark, model):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert identify(df, model).collect() == []
    bare = learn(df)
    (row,) = identify(spark.createDataFrame([(1, "word")], "doc_id long, text string"), bare).collect()
    assert row.lang_pred == "und"


def test_unknown_script_allows_all():
    model = Model(["a", "b"], np.ones((1 << 16, 2)), np.zeros((model_scripts(), 2)))
    assert (model.barred == 0).all()


def model_scripts():
    from affinium.llm.language import SCRIPTS

    return len(SCRIPTS)


def test_one_repeated_key_does_not_fill_the_sample(spark):
    rows = [(922, f"das haus und der garten {i}", "de") for i in range(300)] * 3
    rows += [(i, f"the house and that thing {i}", "en") for i in range(60)] + [(100 + i, f"la maison et le jardin {i}", "fr") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for limit in (60, 100, 300):
        assert learn(df, rows=limit).languages == ["de", "en", "fr"]
