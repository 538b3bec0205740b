"""Vector links against brute force, the estimator, and recall at the threshold."""

import math

import numpy as np
import pyarrow as pa
import pytest

from affinium.llm import rabit as module
from affinium.llm.queries import QUERIES
from affinium.llm.rabit import _encode, link_vectors, padded, rotation, shape_of


def brute(rows, cosine=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
            for _, v in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = [0] * len(rows)
    for dim in {len(v) for (_, v), g in zip(rows, good) if g}:
        at = [i for i, ((_, v), g) in enumerate(zip(rows, good)) if g and len(v) == dim]
        m = np.array([rows[i][1] for i in at], np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= cosine, 1))):
            links[at[a]] += 1
            links[at[b]] += 1
            root[find(at[a])] = find(at[b])
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((k, n, least.get(find(i)) if good[i] else k, k == (least.get(find(i)) if good[i] else k))
                   for i, ((k, _), n) in enumerate(zip(rows, links))), key=str)


def test_query(spark, tables):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    got = QUERIES["op9_embedding_near_dedup"](spark, tables)
    assert got.columns[:4] == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.fixture(scope="module")
def family():
    """A tight family, a looser one around the threshold, noise, copies and odd vectors."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x)
    near = lambda c, s: unit(c + s * unit(rng.standard_normal(48)))
    a, b = unit(rng.standard_normal(48)), unit(rng.standard_normal(48))
    vectors = [near(a, 0.1) * 3 for _ in range(200)] + [near(b, 0.33) for _ in range(60)]
    vectors += [unit(rng.standard_normal(48)) for _ in range(200)] + [a, a, a * 2]
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    odd = [None, [], [0.0] * 48, [None] * 48, [float("nan")] * 48, [float("inf")] + [0.0] * 47, [1.0, 0.0],
           [1.0, 0.0], [0.9, 0.1]]
    rows = [((i * 37) % 1000, v) for i, v in enumerate([*vectors, *odd])]
    return [*rows, (None, vectors[0]), (rows[3][0], vectors[3]), (rows[5][0], vectors[250])]


@pytest.mark.parametrize("block", [2048, 40])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_family(spark, monkeypatch, family, block, kind):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "MISS", 1e-9)
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in family], f"vec_id long, embedding array<{kind}>, node int, id int")
    assert sorted(map(tuple, link_vectors(df).collect()), key=str) == brute(family)


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((2, 400, 64))
    y = 0.6 * x + 0.4 * y
    rotated, signs, factors = _encode(x)
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    true = (x / np.linalg.norm(x, axis=1, keepdims=True) * y).sum(axis=1)
    guess = (np.where(signs, 1, -1) / 8 * (y @ rotation(padded(64)))).sum(axis=1) / factors
    assert abs((guess - true).mean()) < 0.02
    margin = module.CONFIDENCE * np.sqrt(1 - factors**2) / factors / math.sqrt(63)
    assert (abs(guess - true) <= margin).mean() > 0.999


def test_recall_at_the_threshold(spark):
    """Pairs of cosine just over 0.9, alone among noise."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        x, z = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (0.902 * x + math.sqrt(1 - 0.902**2) * z).tolist())]
    got = link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = sum(r.n_links for r in got.collect()) / sum(r[1] for r in brute([(k, np.float32(v).tolist()) for k, v in rows]))
    assert found >= 0.97


@pytest.mark.parametrize("n", [0, 10, 10**4, 10**6, 10**9, 10**12])
def test_shape(n):
    bits, tables = shape_of(n, 0.9)
    same = 1 - math.acos(0.9) / math.pi
    assert (1 - same**bits) ** tables <= module.MISS and n / 2**bits <= 256


def pairs_at(cosine, n, dim=64):
    x, z = np.random.default_rng(11).standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("n", [10**4, 10**6, 10**8, 10**9])
def test_pairs_meet_whatever_the_size_of_the_table(n):
    """Share of pairs at the threshold with a common bucket, with the bits and tables that n vectors get."""
    count = 2000
    x, y = pairs_at(0.9, count)
    vectors = np.concatenate([x, y])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(2 * count)), pa.array(np.ones(2 * count, np.int64)), pa.array([v.tobytes() for v in vectors])],
        ["node", "weight", "body"],
    )
    buckets = {}
    for out in module._file(*shape_of(n, 0.9), "<f8")([batch]):
        buckets.setdefault(out.column("table")[0].as_py(), np.zeros(2 * count, np.int64))[
            out.column("node").to_numpy()
        ] = out.column("bucket").to_numpy()
    met = np.any([b[:count] == b[count:] for b in buckets.values()], axis=0)
    assert met.mean() >= 0.995


def test_links_with_the_shape_of_a_large_table(spark, monkeypatch):
    """No link is lost or counted twice over the tables that 1e6 vectors get."""
    monkeypatch.setattr(module, "shape_of", lambda vectors, cosine: shape_of(10**6, cosine))
    rows = list(enumerate(np.concatenate(pairs_at(0.902, 300)).astype(np.float32).tolist()))
    got = {r.vec_id: r.n_links for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    want = {r[0]: r[1] for r in brute(rows)}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_empty_table(spark):
    assert link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
