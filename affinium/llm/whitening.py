"""Whitening of vectors by their exact characteristic polynomial.

Components become whole numbers, so that sums and the scatter matrix of all
vectors add up exactly, in whatever order tasks deliver them. The scatter's
characteristic polynomial has whole coefficients too: modulo each of many
primes it comes from a reduction to Hessenberg form, a task taking some
primes, and Chinese remaindering puts the residues together. All roots of
that polynomial are real, so by the rule of signs the changes of sign after a
shift count the roots beyond it exactly; bisection with that count isolates
the largest ones, however close, and then signs refine them far beyond double
precision. A component is the null vector of the scatter less its root, found
by inverse iteration in decimal arithmetic of as many digits as the gaps ask.

The driver holds a matrix of the vectors' length squared, never vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium.llm.registry import query, table
from affinium.operators.arrow import vector_column
from affinium.session import materialise

# A component c becomes floor(UNIT * c) + SHIFT.
UNIT, SHIFT = 1024, 100_000
COMPONENTS = 8
# Roots closer than 2 ** -ROOT_BITS of their size are one root; digits of the null vectors beyond that.
ROOT_BITS = 96
EXTRA_DIGITS = 40
# Rows multiplied at once, and the limb in which sums travel.
SLICE_ROWS = 4096
LIMB_BITS = 48
LONG = 1 << 63


# --- whole numbers and their sums -------------------------------------------


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(UNIT * c) of each component as whole numbers, without SHIFT; kept within a long.

    Long integers where all are small enough for exact products in floating
    point, else Python's.
    """
    scaled = np.floor(values.astype(np.float64) * UNIT)
    if len(scaled) and np.abs(scaled).max() >= 1 << 20:
        low, high = -LONG - SHIFT, LONG - 1 - SHIFT
        return np.array([[min(max(int(v), low), high) if np.isfinite(v) else (low if v < 0 else high) for v in row]
                         for row in scaled], object).reshape(scaled.shape)
    return scaled.astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], column: str, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, len(batch), SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            flat = part.column(column).flatten().to_numpy(zero_copy_only=False)
            yield part, whole_numbers(flat.reshape(len(part), dim))


def _product(numbers: np.ndarray) -> np.ndarray:
    """Numbers' sums and products of a slice, exact, as Python integers."""
    if numbers.dtype == object:
        return numbers.T.dot(numbers)
    # Below 2 ** 20 each, so sums of SLICE_ROWS products stay exact in floating point.
    real = numbers.astype(np.float64)
    return (real.T @ real).astype(np.int64).astype(object)


def _scatter(dim: int):
    """A task's sums and products as (entry, limb, value); entries are numbered by (row, column), sums by column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(dim, object), np.zeros((dim, dim), object)
        for _, numbers in _slices(batches, "vector", dim):
            sums += numbers.sum(axis=0).astype(object)
            products += _product(numbers)
        entries, limbs, values = [], [], []
        upper = [i * dim + j for i in range(dim) for j in range(i, dim)]
        flat = products.reshape(-1)
        for entry, value in [*((i - dim, sums[i]) for i in range(dim)), *((e, flat[e]) for e in upper)]:
            limb = 0
            while value:
                value, part = divmod(int(value), 1 << LIMB_BITS) if not -LONG < value < LONG else (0, int(value))
                entries.append(entry)
                limbs.append(limb)
                values.append(part)
                limb += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(entries, pa.int32()), pa.array(limbs, pa.int32()), pa.array(values, pa.int64())], ["entry", "limb", "value"]
        )

    return run


def exact_scatter(vectors: DataFrame, dim: int) -> tuple[list[int], list[list[int]]]:
    """Sums and sums of products of the whole numbers of all vectors, exact at any size."""
    sent = vectors.mapInArrow(_scatter(dim), "entry int, limb int, value long")
    added = sent.groupBy("entry", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums, products = [0] * dim, [[0] * dim for _ in range(dim)]
    for entry, limb, value in added.collect():
        whole = int(value) << (LIMB_BITS * limb)
        if entry < 0:
            sums[entry + dim] += whole
        else:
            i, j = divmod(entry, dim)
            products[i][j] += whole
    for i in range(dim):
        for j in range(i):
            products[i][j] = products[j][i]
    return sums, products


# --- the characteristic polynomial --------------------------------------------


def _is_prime(n: int) -> bool:
    """Exact below 3 * 10 ** 9."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """The largest primes below 2 ** 31 whose product has more than so many bits."""
    found, n, left = [], (1 << 31) - 1, bits + 1
    while left > 0:
        if _is_prime(n):
            found.append(n)
            left -= 30
        n -= 2
    return found


def polynomial_mod(matrix: list[list[int]], p: int) -> list[int]:
    """Characteristic polynomial modulo a prime, constant first: Hessenberg reduction, then its recurrence."""
    a = np.array([[v % p for v in row] for row in matrix], np.int64)
    d = len(a)
    for c in range(d - 2):
        below = np.flatnonzero(a[c + 1 :, c])
        if not len(below):
            continue
        pivot = c + 1 + below[0]
        if pivot != c + 1:
            a[[c + 1, pivot]] = a[[pivot, c + 1]]
            a[:, [c + 1, pivot]] = a[:, [pivot, c + 1]]
        factors = a[c + 2 :, c] * pow(int(a[c + 1, c]), -1, p) % p
        a[c + 2 :] = (a[c + 2 :] - factors[:, None] * a[c + 1] % p) % p
        # The inverse operation on columns; products are reduced before they are added.
        a[:, c + 1] = (a[:, c + 1] + (a[:, c + 2 :] * factors % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[k - 1, :-1]
        weights = np.zeros(k, np.int64)
        chain = 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(a[i, k - 1]) * chain % p
            if i:
                chain = chain * int(a[i, i - 1]) % p
        polys[k] = (new - (weights[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d].tolist()


def remaindered(residues: list[list[int]], primes: list[int]) -> list[int]:
    """Whole numbers, positive or not, from their residues modulo each prime."""
    values, product = [0] * len(residues[0]), 1
    for found, p in zip(residues, primes):
        inverse = pow(product % p, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, found)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), constant first; tasks share the primes.

    A coefficient is a sum of principal minors, each within the product of
    its rows' lengths (Hadamard), so all are within the product of 1 + length.
    """
    d = len(matrix)
    bits = 1 + sum((1 + math.isqrt(sum(v * v for v in row)) + 1).bit_length() for row in matrix)
    primes = primes_for(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("p").to_pylist():
                row = pa.array([polynomial_mod(matrix, p)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), row], ["p", "residues"])

    parts = max(1, min(len(primes) * d**3 // 20_000_000, spark.sparkContext.defaultParallelism * 4, len(primes)))
    work = spark.createDataFrame([(p,) for p in primes], "p long").repartition(parts)
    found = {r["p"]: r["residues"] for r in work.mapInArrow(run, "p long, residues array<long>").collect()}
    return remaindered([found[p] for p in primes], primes)


# --- its largest roots -----------------------------------------------------------


def roots_above(polynomial: list[int], at: int, bits: int) -> int:
    """Number of roots, with multiplicity, above at / 2 ** bits; all roots are real, so the rule of signs is exact."""
    d = len(polynomial) - 1
    shifted = [c << (bits * (d - k)) for k, c in enumerate(polynomial)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            shifted[k] += at * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value_sign(polynomial: list[int], at: int, bits: int) -> int:
    value, d = 0, len(polynomial) - 1
    for k in range(d, -1, -1):
        value = value * at + (polynomial[k] << (bits * (d - k)))
    return (value > 0) - (value < 0)


@dataclass(frozen=True)
class Root:
    """A root between low and high, both over 2 ** bits, and how often it counts."""

    low: int
    high: int
    bits: int
    times: int

    def middle(self) -> Decimal:
        return Decimal(self.low + self.high) / Decimal(2 << self.bits)


def largest_roots(polynomial: list[int], bound: int, wanted: int, bits: int = ROOT_BITS) -> list[Root]:
    """The largest positive roots, falling, until `wanted` are found with multiplicity.

    A root lies in (low, high]. Intervals are halved by counting until one
    root is left in them, then by the sign of the polynomial, until they are
    narrower than 2 ** -bits of the root; what is still together then is one
    root that counts several times.
    """
    # Units fine enough for the least positive root that a whole polynomial of this size can have are not needed:
    # a root below 2 ** -bits of the bound counts as zero.
    unit = max(0, 2 * bits - bound.bit_length())
    floor = (bound << unit) >> bits
    todo = [(floor, bound << unit, roots_above(polynomial, floor, unit), 0)]
    out, found = [], 0
    while todo and found < wanted:
        low, high, above_low, above_high = todo.pop()
        times = above_low - above_high
        if not times:
            continue
        if high - low <= max(1, high >> bits):
            out.append(Root(low, high, unit, times))
            found += times
            continue
        if times == 1:
            # Above the root the sign is that of the leading coefficient, changed once for each root above.
            sign_high = -1 if above_high % 2 else 1
            while high - low > max(1, high >> bits):
                mid = (low + high) // 2
                sign = _value_sign(polynomial, mid, unit)
                low, high = (low, mid) if sign in (0, sign_high) else (mid, high)
            out.append(Root(low, high, unit, 1))
            found += 1
            continue
        mid = (low + high) // 2
        above = roots_above(polynomial, mid, unit)
        todo += [(low, mid, above_low, above), (mid, high, above, above_high)]
    return out


# --- null vectors ----------------------------------------------------------------


def _factor(a: np.ndarray, tiny: Decimal) -> tuple[np.ndarray, list[int]]:
    """LU factors of a matrix of decimals in place, rows exchanged; a vanishing pivot becomes tiny."""
    order, d = list(range(len(a))), len(a)
    for c in range(d):
        pivot = max(range(c, d), key=lambda r: abs(a[r, c]))
        a[[c, pivot]] = a[[pivot, c]]
        order[c], order[pivot] = order[pivot], order[c]
        if not a[c, c]:
            a[c, c] = tiny
        if c + 1 < d:
            a[c + 1 :, c] /= a[c, c]
            a[c + 1 :, c + 1 :] -= a[c + 1 :, c : c + 1] * a[c : c + 1, c + 1 :]
    return a, order


def _solve(lu: np.ndarray, order: list[int], right: np.ndarray) -> np.ndarray:
    x = right[order].copy()
    for i in range(1, len(x)):
        x[i] -= (lu[i, :i] * x[:i]).sum()
    for i in range(len(x) - 1, -1, -1):
        x[i] = (x[i] - (lu[i, i + 1 :] * x[i + 1 :]).sum()) / lu[i, i]
    return x


def null_vectors(matrix: list[list[int]], root: Root) -> list[np.ndarray]:
    """Orthonormal vectors that the matrix multiplies by the root, as decimals, one for each time it counts.

    The larger of two entries of equal size comes first; the largest is positive.
    """
    d = len(matrix)
    with localcontext() as context:
        context.prec = 2 * int(ROOT_BITS * 0.302) + EXTRA_DIGITS
        shift = root.middle()
        a = np.array([[Decimal(v) for v in row] for row in matrix], object)
        a[np.arange(d), np.arange(d)] -= shift
        lu, order = _factor(a, shift.scaleb(-context.prec))
        out: list[np.ndarray] = []
        for t in range(root.times):
            # Any start will do that is not orthogonal to the null space; these have no structure.
            x = np.array([Decimal((i * 2654435761 + (t + 1) * 40503) % 10007 - 5003) for i in range(d)], object)
            for _ in range(4):
                for other in out:
                    x = x - other * (other * x).sum()
                x = x / (x * x).sum().sqrt()
                x = _solve(lu, order, x)
                x = x / max(abs(v) for v in x)
            for other in out:
                x = x - other * (other * x).sum()
            x = x / (x * x).sum().sqrt()
            out.append(x if max(x, key=abs) > 0 else -x)
    return out


# --- the operator ------------------------------------------------------------------


@dataclass
class Whitening:
    """What fitting found: number of vectors, sums of y = x - SHIFT, eigenvalues of the covariance, unit components."""

    n: int
    sums: list[int]
    values: list[float]
    explained: list[float]
    components: np.ndarray


def _valid(vector: str):
    """Vectors without null or non-finite entries."""
    numbers = F.col(vector).cast("array<double>")
    good = F.forall(numbers, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """Rows (id, vector) that take part, with the vectors' length and number: the length most of them have.

    Of lengths that are equally common the larger one counts. Empty vectors do not take part.
    """
    good = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(_valid("vector"))
    sizes = good.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).where("dim > 0")
    first = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n = (first["dim"], first["n"]) if first else (0, 0)
    return good.where(F.size("vector") == dim) if dim else good.limit(0), dim, n


def fit(vectors: DataFrame, dim: int, n: int, wanted: int = COMPONENTS) -> Whitening:
    """Components of the largest eigenvalues; fewer where the vectors span fewer dimensions."""
    if not n:
        return Whitening(0, [], [], [], np.zeros((0, dim)))
    sums, products = exact_scatter(vectors, dim)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    trace = sum(matrix[i][i] for i in range(dim))
    if not trace:
        return Whitening(n, sums, [], [], np.zeros((0, dim)))
    # A common factor of all entries only lengthens the numbers.
    common = math.gcd(*(v for row in matrix for v in row))
    matrix, trace = [[v // common for v in row] for row in matrix], trace // common
    polynomial = characteristic_polynomial(vectors.sparkSession, matrix)
    values, shares, components = [], [], []
    with localcontext() as context:
        context.prec = 100
        for root in largest_roots(polynomial, trace, wanted):
            for found in null_vectors(matrix, root):
                values.append(float(root.middle() * common / (n * n)))
                shares.append(float(root.middle() / trace))
                components.append([float(v) for v in found])
    return Whitening(n, sums, values[:wanted], shares[:wanted], np.array(components[:wanted]).reshape(-1, dim))


def _project(fitted: Whitening, dim: int):
    """Whitened components and the exact squared deviation, times n squared, of each vector."""
    scale = fitted.components / np.sqrt(np.array(fitted.values))[:, None] if fitted.values else fitted.components
    mean = np.array([float(Decimal(s) / Decimal(fitted.n)) for s in fitted.sums])
    sums = np.array(fitted.sums, object)
    kind = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, numbers in _slices(batches, "vector", dim):
            real = numbers.astype(np.float64) - mean
            most = (max(int(np.abs(numbers).max()), 1) * fitted.n + max(map(abs, fitted.sums))) if len(part) else 0
            if most * most * dim < LONG:
                apart = numbers * fitted.n - sums.astype(np.int64)
                deviation = pa.array((apart * apart).sum(axis=1).astype(np.int64)).cast(kind)
            else:
                exact = ((numbers.astype(object) * fitted.n - sums) ** 2).sum(axis=1)
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in exact], kind)
            whitened = np.einsum("ij,kj->ik", real, scale)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), deviation, vector_column(whitened, pa.float64())], ["id", "deviation", "whitened"]
            )

    return run


def whiten(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> tuple[DataFrame, Whitening, float]:
    """Rows (key, deviation, whitened), what was fitted, and the largest error of the whitened covariance.

    deviation, decimal(38,0), is the exact sum of (n * x - S) ** 2, null from
    10 ** 38; whitened holds one number a component. Vectors that are null,
    empty, hold null or non-finite entries, or have another length than most
    do not take part and have no row; keys may repeat or be null. Whole
    numbers beyond a long are kept at its ends. Without spread, as with one
    vector, there are no components; an eigenvalue below 2 ** -ROOT_BITS of
    the trace counts as zero and has none. Of equal eigenvalues any
    orthonormal components are taken, always the same. An empty table gives an
    empty result; other columns are ignored.
    """
    vectors, dim, n = usable(rows, key, vector)
    fitted = fit(vectors, dim, n, components)
    kind = rows.schema[key].dataType.simpleString()
    found = vectors.mapInArrow(_project(fitted, dim), f"id {kind}, deviation decimal(38,0), whitened array<double>")
    found = materialise(found, "whitened")
    width = len(fitted.values)
    error = 0.0
    if width:
        at = [F.col("whitened")[i] for i in range(width)]
        means = found.agg(*[F.avg(c) for c in at]).first()
        apart = [c - F.lit(m) for c, m in zip(at, means)]
        pairs = [(i, j) for i in range(width) for j in range(i, width)]
        covariance = found.agg(*[F.avg(apart[i] * apart[j]) for i, j in pairs]).first()
        error = max(abs(v - (i == j)) for v, (i, j) in zip(covariance, pairs))
    return found.withColumnRenamed("id", key), fitted, error


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found, fitted, error = whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    explained = F.array(*[F.lit(v) for v in fitted.explained]).cast("array<double>")
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
