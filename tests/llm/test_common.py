"""Helpers of the training-data operators."""

import random

import numpy as np
import pyarrow as pa
import pytest

from affinium.llm.common import SPACES, components, flat_words, small_slices


def test_words_of_slices():
    rng = random.Random(3)
    texts = [None if rng.random() < 0.1 else " ".join("AÉßz"[rng.randrange(4)] * rng.randint(1, 9) for _ in range(50))
             for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = []
    for part in small_slices([batch], "text", 1000):
        words, counts = flat_words(part.column("text"), SPACES)
        words.validate(full=True)
        got += np.split(np.array(words.to_pylist(), object), np.cumsum(counts)[:-1])
    assert [list(g) for g in got] == [(t or "").translate(low).split() for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(70)]
    edges += [(None, 1), (5, 5), (300, 301), (301, 300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    assert {r.id: r.component for r in got} == {x: find(x) for x in list(root)}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "test").collect() == []
