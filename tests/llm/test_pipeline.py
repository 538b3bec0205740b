"""The pipeline's stages, each against a plain version over its own input."""

import re
from collections import defaultdict

import pytest
from test_decontaminate import brute as leaks_of
from test_minhash import brute as groups_of

import corpus_pipeline
from affinium.llm import secrets, toxicity
from affinium.session import materialise


@pytest.fixture(scope="module")
def stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = [("documents", docs.columns, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, tables), f"test-{name}")
        out.append((name, docs.columns, docs.collect()))
    return out


def test_columns(stages):
    assert [name for name, _, _ in stages[1:]] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    assert all(columns == stages[0][1] for _, columns, _ in stages[:-1])


def test_toxicity(spark, tables, stages):
    docs, labels = (spark.read.parquet(f"{tables}/{n}.parquet") for n in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels)
    fold = toxicity.fold
    low = [r for r in stages[0][2] if lexicon.score(fold(r.text), lexicon.matches(fold(r.text))) < 0.5]
    assert sorted(stages[1][2]) == sorted(low)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    gone = {r.doc_id for r in stages[0][2]} - {r.doc_id for r in stages[1][2]}
    assert gone and sum(truth.get(d, 1) for d in gone) >= 0.9 * len(gone)


def test_near_dedup(stages):
    kept = {k for k, _, _, own in groups_of([(r.doc_id, r.text) for r in stages[1][2]], 5, 80) if own}
    assert sorted(stages[2][2]) == sorted(r for r in stages[1][2] if r.doc_id in kept)
    assert len(stages[2][2]) < len(stages[1][2])


def test_decontamination(spark, tables, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    before = {k: (n, h) for k, n, h, _ in leaks_of([(r.doc_id, r.text) for r in stages[2][2]], items, 10)}
    after = {r.doc_id: r for r in stages[3][2]}
    assert any(h for _, h in before.values())
    assert set(after) == {k for k, (n, h) in before.items() if not h or h <= 0.5 * n}
    left = leaks_of([(r.doc_id, r.text) for r in stages[3][2]], items, 10)
    assert all(n == before[k][0] - before[k][1] and not h for k, n, h, _ in left)
    assert all(r == after[r.doc_id] for r in stages[2][2] if not before[r.doc_id][1])
    assert all(r.n_chars == len(r.text) for r in stages[3][2])


def test_secrets(stages):
    old, new = ({r.doc_id: r.text for r in stages[i][2]} for i in (3, 4))
    assert old.keys() == new.keys()
    found = re.compile(secrets.HEX)
    for key, text in new.items():
        assert all(len(m.group()) < 24 for m in found.finditer(text))
        if any(len(m.group()) >= 24 for m in found.finditer(old[key])):
            assert "[secret]" in text
        if "[secret]" not in text:
            assert text == old[key]


def test_packing(stages):
    ids = {r.doc_id for r in stages[4][2]}
    by_sequence = defaultdict(list)
    for r in stages[5][2]:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert {r.doc_id for r in stages[5][2]} == ids
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_is_all_stages(spark, tables, stages):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None
    got = entry.queries()["pipeline"](spark, tables)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got.collect())) == sorted(map(key, stages[5][2]))
