"""Toxicity: folding, matching, exceptions, learning and held-out accuracy."""

import math

import pytest

from affinium.llm import toxicity as module
from affinium.llm.queries import QUERIES
from affinium.llm.toxicity import Lexicon, fold, learn, score_toxicity


def test_fold():
    assert fold("Sсum! 1D10T ＦＵＬＬ") == " scum idiot full "
    assert fold(None) == fold("") == " "
    assert fold("...") == "  "


def plain(weights, exceptions, folded):
    """Longest entry at each place, without those inside an exception."""
    inside = set()
    for e in exceptions:
        at = folded.find(e)
        while at >= 0:
            inside |= set(range(at, at + len(e) - 1))
            at = folded.find(e, at + 1)
    out = []
    for i in range(len(folded)):
        here = [w for w in weights if folded.startswith(w, i)]
        if here and i not in inside:
            best = max(here, key=len)
            out.append((i, best, weights[best]))
    return out


@pytest.mark.parametrize("text", ["you idiot idiotic idiots", "mild idiot savant here idiot", "scumble scum", "", "clean words"])
def test_matches(text):
    weights = {" idiot": 1.0, " idiot ": 3.0, " scum": 2.0}
    exceptions = [" scumble ", " idiot savant "]
    lexicon = Lexicon(weights, exceptions)
    assert lexicon.matches(fold(text)) == plain(weights, exceptions, fold(text))


@pytest.fixture(scope="module")
def taught(spark):
    rows, labels = [], []
    for i in range(120):
        toxic = i % 3 == 0
        rows.append((i, f"some plain words number {i} " + ("you vile grobian there" if toxic else "a grobianism here")))
        labels.append((i, int(toxic)))
    rows += [(500, None), (None, "grobian")]
    labels += [(501, 1), (None, 1), (3, None), (0, 0)]
    return learn(spark.createDataFrame(rows, "doc_id long, text string"),
                 spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_learned(taught):
    assert " grobian " in taught.weights and " grobianism " not in taught.weights
    assert not taught.matches(fold("a grobianism"))
    assert taught.matches(fold("gr0bian"))


def test_odd_rows(spark, taught):
    rows = [(1, "a vile grobian"), (1, "a vile grobian"), (2, None), (3, ""), (None, "grobianism"), (4, "w " * 50_000)]
    df = spark.createDataFrame([(k, t, 5.0, "x") for k, t in rows], "doc_id long, text string, score double, terms string")
    got = score_toxicity(df, taught, prefix="new_")
    assert got.columns == [*df.columns, "new_score", "new_terms"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r.new_score <= 1 for r in found)
    assert [r.new_score >= 0.5 for r in found if r.doc_id == 1] == [True, True]
    assert all(r.new_score < 0.5 for r in found if r.doc_id != 1)
    assert score_toxicity(df.limit(0), taught).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        lexicon = learn(docs, some)
        (row,) = score_toxicity(docs, lexicon).collect()
        assert row.terms == [] and 0 < row.score < 0.5


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = QUERIES["op10_toxicity"](spark, folder).collect()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.93
    assert all(r.predicted == (r.score >= 0.5) and math.isfinite(r.score) for r in got)


def test_sample_is_bounded(spark, monkeypatch):
    """A repeated id brings no more rows than asked for, and repeated rows count once."""
    docs = [(1, f"text {i}") for i in range(3000)] + [(k, f"a vile grobian {k}") for k in range(2, 60)] * 20
    labels = [(1, 0)] + [(k, 1) for k in range(2, 60)]
    sizes = []
    real = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: sizes.append(df.count()) or real(df, name))
    learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), rows=100)
    learn(spark.createDataFrame(docs[3000:], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sizes == [100, 58]


def test_many_exception_phrases():
    lexicon = Lexicon({" bad ": 1.0}, [" bad apple ", " no bad "])
    assert [s for s, _, _ in lexicon.matches(" bad apple bad no bad bad bad apple ")] == [10, 21]
