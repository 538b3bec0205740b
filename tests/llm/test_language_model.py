"""Language model: counts and base scores by hand, mixtures that sum to one, held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinium.llm import language_model as module
from affinium.llm.language_model import learn_weights, mixture, score_texts
from affinium.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = None


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


def base(rows):
    """(key, text, train) to (key, train, n, known, N, score)."""
    counts = Counter(t for _, text, train in rows if train for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    return sorted(
        ((k, bool(train), len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), total,
          round(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens(text)), 6))
         for k, text, train in rows), key=str,
    )


def of(found):
    return sorted(((r[0], r[1], r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=str)


@pytest.fixture(scope="module")
def rows(tables, spark):
    read = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in read]


def test_query(spark, tables, rows):
    got = QUERIES["op8_lm_deleted_interpolation"](spark, tables).collect()
    assert of([r for r in got]) == sorted(((k, not t, *rest) for k, t, *rest in base(rows)), key=str)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("size", [400, 1 << 20])
def test_scores_by_hand(spark, monkeypatch, order, size):
    """Every score from plain counts and the weights that were learned, over one block and over many."""
    kept = []
    plain = learn_weights
    monkeypatch.setattr(module, "learn_weights", lambda *a, **b: kept.append(plain(*a, **b)) or kept[-1])
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))), i % 5 != 0) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").coalesce(2)
    monkeypatch.setattr(module, "REDUCER_KEYS", 16 if size < 1000 else 1 << 22)
    got = {r.doc_id: r for r in score_texts(df, F.col("train"), order=order).collect()}
    grams, histories, total = Counter(), Counter(), 0
    padded = lambda text: [END] * (order - 1) + tokens(text)
    for _, text, train in rows:
        if train:
            words = padded(text)
            for i in range(order - 1, len(words)):
                for k in range(order):
                    gram = (k, *words[i - k : i + 1])
                    grams[gram] += 1
                    histories[(k, *words[i - k : i])] += 1
    distinct = sum(1 for g in grams if g[0] == 0)
    (weights,) = kept
    for key, text, _ in rows:
        words, score = padded(text), 0.0
        for i in range(order - 1, len(words)):
            p = 1 / (distinct + 1)
            for k in range(order):
                seen = histories[(k, *words[i - k : i])]
                w = weights[k][min(1 + int(math.log2(seen)), module.BUCKETS - 1)] if seen else 0.0
                p = w * grams[(k, *words[i - k : i + 1])] / max(seen, 1) + (1 - w) * p
            score += math.log10(p)
        assert got[key].score == pytest.approx(score, abs=1e-6)
    assert of(got.values()) == base(rows)


def test_weights_reach_the_best_likelihood():
    rng = np.random.default_rng(3)
    size, ratios = rng.integers(1, 50, 200).astype(float), [rng.random(200), rng.random(200)]
    buckets = [np.ones(200, int), rng.integers(1, 3, 200)]
    weights = learn_weights(size, ratios, buckets, 0.01, rounds=500)
    gain = lambda w: (size * np.log(mixture(ratios, buckets, 0.01, w))).sum()
    for k, b in [(0, 1), (1, 1), (1, 2)]:
        for step in (-0.02, 0.02):
            other = [w.copy() for w in weights]
            other[k][b] = np.clip(other[k][b] + step, 0, 1)
            # The half token on each side moves a weight that wants to be 1 a little.
            assert gain(other) <= gain(weights) + 1


def test_odd_rows(spark):
    rows = [(1, "A b a", True), (2, None, True), (3, "", False), (None, "b c", True), (1, "A b a", True),
            (4, "zz " * 3000, False), (5, "a", None)]
    df = spark.createDataFrame([(k, t, f, 1) for k, t, f in rows], "doc_id long, text string, flag boolean, train int")
    got = score_texts(df, F.col("flag")).collect()
    assert of(got) == base(rows)
    assert all(math.isfinite(r.score) for r in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (row,) = score_texts(df, F.lit(False)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert score_texts(df.limit(0), F.lit(True)).collect() == []
