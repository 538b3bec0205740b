"""Whitening: the exact polynomial and its roots by other means, NumPy's eigenvectors, exact deviations, odd vectors."""

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from affinium.llm import whitening as w
from affinium.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def by_minors(matrix):
    """Characteristic polynomial by Faddeev and LeVerrier, in fractions, constant first."""
    d = len(matrix)
    a = np.array([[Fraction(v) for v in row] for row in matrix], object)
    one = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    m, out = one * 0, [Fraction(1)]
    for k in range(1, d + 1):
        m = a.dot(m) + out[-1] * one
        out.append(-(a.dot(m)).trace() / k)
    return [int(c) for c in reversed(out)]


def symmetric(d, size, seed):
    rng = np.random.default_rng(seed)
    b = rng.integers(-size, size, (d, d))
    return (b @ b.T).tolist()


@pytest.mark.parametrize(("d", "size"), [(1, 5), (2, 9), (5, 1000), (12, 1 << 20)])
def test_polynomial(spark, d, size):
    matrix = symmetric(d, size, d)
    assert w.characteristic_polynomial(spark, matrix) == by_minors(matrix)


def test_polynomial_of_sparse_and_singular_matrices(spark):
    for matrix in ([[0]], [[2, 0], [0, 2]], np.diag([3, 0, 0, 7]).tolist(), [[1, 1, 0], [1, 1, 0], [0, 0, 5]], np.ones((6, 6), int).tolist()):
        assert w.characteristic_polynomial(spark, matrix) == by_minors(matrix)


def test_primes():
    found = w.primes_for(600)
    assert len(set(found)) == len(found) and np.prod([Fraction(p) for p in found]) > 2**600
    assert all(p % q for p in found for q in range(2, 50_000) if q * q <= p)
    assert [n for n in range(60) if w._is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]


def poly(roots):
    out = [1]
    for r in roots:
        out = [(out[i - 1] if i else 0) - r * (out[i] if i < len(out) else 0) for i in range(len(out) + 1)]
    return out


def test_roots_close_and_repeated():
    roots = [10**24, 10**24 - 1, 10**24 - 2, 500, 500, 7, 0, 0]
    found = w.largest_roots(poly(roots), sum(roots), 8)
    assert [r.times for r in found] == [1, 1, 1, 2, 1]
    exact = [10**24, 10**24 - 1, 10**24 - 2, 500, 7]
    for root, value in zip(found, exact):
        assert abs(root.middle() - value) <= Decimal(value) * Decimal(2) ** -90
    assert [sum(r > a for r in roots) for a in (0, 6, 7, 499, 500)] == [w.roots_above(poly(roots), a, 0) for a in (0, 6, 7, 499, 500)]


def test_null_vectors_of_a_near_multiple_root(spark):
    """Roots that differ by one in 10 ** 12 have vectors that double precision alone cannot tell apart."""
    turn = np.array([[3, -4, 0], [4, 3, 0], [0, 0, 5]])
    matrix = (turn @ np.diag([10**12, 10**12 + 1, 17]) @ turn.T).tolist()
    roots = w.largest_roots(w.characteristic_polynomial(spark, matrix), sum(matrix[i][i] for i in range(3)), 3)
    assert [r.times for r in roots] == [1, 1, 1]
    for root, want in zip(roots, ([-4, 3, 0], [3, 4, 0], [0, 0, 5])):
        got = np.array([float(v) for v in w.null_vectors(matrix, root)[0]])
        assert min(np.abs(got - np.array(want) / 5).max(), np.abs(got + np.array(want) / 5).max()) < 1e-15


def plain(vectors, components=8):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total)) for row in x]
    return n, deviation, centred @ turn / np.sqrt(values), values / (centred**2).sum() * n


def check(rows, vectors, keys, components=8):
    n, deviation, whitened, explained = plain(vectors, components)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(keys) and len(rows) == len(keys) * whitened.shape[1]
    signs = np.sign(sum(whitened[i, :] * np.array([got[k][c + 1].whitened for c in range(whitened.shape[1])]) for i, k in enumerate(keys)))
    for i, k in enumerate(keys):
        for c in range(whitened.shape[1]):
            r = got[k][c + 1]
            assert (r.n, r.deviation) == (n, deviation[i])
            assert abs(r.whitened - signs[c] * whitened[i, c]) < 1e-8
            assert abs(r.explained / explained[c] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9


def test_query(spark, tables):
    rows = sorted(spark.read.parquet(f"{tables}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    got = QUERIES["op12_embedding_whitening"](spark, tables).collect()
    check(got, [r.embedding for r in rows], [r.vec_id for r in rows])


def query(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    return QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).collect()


def test_odd_vectors_have_no_row(spark, tmp_path):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(60, 10)).tolist()
    odd = [None, [], [None] * 10, [float("nan")] * 10, [0.0] * 9 + [float("inf")], [1.0] * 9 + [None], [1.0, 2.0]]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(100 + i, v, 2) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, SCHEMA + ", whitened int").repartition(4)
    check(query(spark, df, tmp_path), good, list(range(60)))


def test_repeated_rows_and_copies(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(20, 9)).tolist()
    rows = [(1, v) for v in good] + [(None, good[0])] * 500
    found, fitted, error = w.whiten(spark.createDataFrame(rows, SCHEMA))
    n, deviation, whitened, explained = plain([v for _, v in rows])
    assert found.count() == 520 == n and found.where("vec_id is null").select("deviation").distinct().count() == 1
    assert np.allclose(fitted.explained, explained, rtol=1e-9) and error < 1e-9
    assert sorted(int(r.deviation) for r in found.collect()) == sorted(deviation)


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_no_spread(spark, tmp_path, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], SCHEMA)
    assert query(spark, df, tmp_path) == []
    found, fitted, error = w.whiten(df)
    assert [r.deviation for r in found.collect()] == [0] * len(vectors) and fitted.values == [] and error == 0


def test_few_dimensions_and_equal_eigenvalues(spark):
    rows = [(i, [a, b, 0.0, a + b]) for i, (a, b) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)])]
    found, fitted, error = w.whiten(spark.createDataFrame(rows, SCHEMA))
    assert len(fitted.values) == 2 and error < 1e-12
    square = [(i, [a, b]) for i, (a, b) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)])]
    found, fitted, error = w.whiten(spark.createDataFrame(square, SCHEMA))
    assert len(fitted.values) == 2 and fitted.values[0] == fitted.values[1] and error < 1e-12


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.integers(-(1 << 40), 1 << 40, (30, 3)).astype(float) / 1024).tolist() + [[1e300, -1e300, 5.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(3)
    found, dim, n = w.usable(df, "vec_id", "embedding")
    sums, products = w.exact_scatter(found, dim)
    low, high = -(1 << 63) - w.SHIFT, (1 << 63) - 1 - w.SHIFT
    y = [[min(max(int(np.floor(c * 1024)) if abs(c) < 1e200 else int(np.sign(c)) << 80, low), high) for c in v] for v in vectors]
    assert sums == [sum(v[i] for v in y) for i in range(3)]
    assert products == [[sum(v[i] * v[j] for v in y) for j in range(3)] for i in range(3)]
    assert w.whiten(df)[0].count() == 31


def test_tasks_do_not_matter(spark, tables):
    df = spark.read.parquet(f"{tables}/embeddings.parquet")
    one, two = (w.whiten(df.repartition(k))[0].collect() for k in (1, 9))
    assert sorted(map(str, one)) == sorted(map(str, two))
