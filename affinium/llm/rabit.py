"""Near-duplicate vectors by randomised-rotation binary codes.

Unit vectors are rotated at random; the signs of the result are a vector's
code, and the inner product of code and rotated vector its correction
factor. Code times a rotated query, divided by the factor, is an unbiased
estimate of the cosine, with a bound on its error. Pairs whose upper bound
misses the threshold are settled; the others are computed exactly.

Which vectors meet is decided by hyperplanes: in each of several tables a
vector lies in the bucket of its sides of some random hyperplanes. All planes
are drawn independently, so a pair at cosine c agrees on b of them with the
probability (1 - acos(c) / pi) ** b and tables miss it independently. (Bits of
one code would not do: a pair with many differing bits fails in all tables
together.) The number of bits grows with the logarithm of the number of
vectors, so buckets keep their size, and the number of tables grows with the
bits, so that a pair at the threshold meets with a probability of 1 - MISS
however large the table is. A pair counts in the first table where it meets.
Equal vectors are one class with a weight. Buckets larger than BLOCK are cut
into blocks that meet two by two; a task gets two blocks and gives back
counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium.llm.common import components
from affinium.llm.registry import query, table
from affinium.session import materialise

COSINE = 0.9
MISS = 0.002
# Vectors an average bucket holds, and the most that meet as one block.
BUCKET_ROWS = 256
BLOCK = 2048
# Half-width of the confidence bounds, in units of the error bound's scale.
CONFIDENCE = 4.0
SEED = 42


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    """Random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def padded(dim: int) -> int:
    """Length of a code: vectors are filled up with zeros to whole 64-bit words."""
    return max(64, -(-dim // 64) * 64)


def shape_of(vectors: int, cosine: float) -> tuple[int, int]:
    """Bits per bucket and number of tables for so many vectors."""
    bits = max(4, math.ceil(math.log2(max(vectors, 1) / BUCKET_ROWS)))
    same = 1 - math.acos(cosine) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log1p(-(same**bits)))


# Whole numbers of at most this size stand for a plane's components (16 bits a unit, below 8 units).
PLANE_BITS = 19


@lru_cache(maxsize=256)
def planes(dim: int, bits: int, turn: int) -> np.ndarray:
    """Normals of one table's hyperplanes as columns of whole numbers; no two tables share one."""
    normals = np.random.default_rng([SEED, dim, bits, turn]).standard_normal((dim, bits))
    return np.rint(normals.clip(-7.99, 7.99) * (1 << (PLANE_BITS - 3)))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """Vectors as whole numbers whose products with planes add up exactly.

    So a vector has the same bucket in whichever batch it is multiplied.
    """
    top = min(24, 52 - PLANE_BITS - max(vectors.shape[1] - 1, 0).bit_length())
    return np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * (1 << top))


def buckets_of(numbers: np.ndarray, bits: int, turn: int) -> np.ndarray:
    """Bucket of each vector, given as whole numbers, in one table."""
    return (numbers @ planes(numbers.shape[1], bits, turn) > 0) @ (1 << np.arange(bits, dtype=np.int64))


def _encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their signs and their correction factors."""
    size = padded(vectors.shape[1])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rotated = np.pad(unit, ((0, 0), (0, size - vectors.shape[1]))) @ rotation(size)
    signs = rotated > 0
    return rotated, signs, np.where(signs, rotated, -rotated).sum(axis=1) / math.sqrt(size)


def _node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes and a 64-bit name for each; none for vectors that link with nothing."""
    for batch in batches:
        nodes, bodies = [], []
        for value in batch.column("vector"):
            node = body = None
            if value.is_valid and len(value) and not value.values.null_count:
                numbers = value.values.to_numpy(zero_copy_only=False) + 0.0
                if np.isfinite(numbers).all() and numbers.any():
                    body = numbers.tobytes()
                    node = int.from_bytes(blake2b(body, digest_size=8).digest(), "little", signed=True)
            nodes.append(node)
            bodies.append(body)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(nodes, pa.int64()), pa.array(bodies, pa.binary())], ["id", "node", "body"]
        )


def _file(bits: int, tables: int, kind: str):
    """A row per vector and table: its bucket, code and factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(b) for b in batch.column("body").to_pylist()])
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                for start in range(0, len(part), 1024):
                    rows = part.slice(start, 1024)
                    bodies = rows.column("body").to_pylist()
                    vectors = np.frombuffer(b"".join(bodies), kind).reshape(len(bodies), -1).astype(np.float64)
                    _, signs, factors = _encode(vectors)
                    numbers = whole_numbers(vectors)
                    codes = pa.array([c.tobytes() for c in np.packbits(signs, axis=1)], pa.binary())
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([vectors.shape[1]] * len(rows), pa.int32()),
                                pa.array([t] * len(rows), pa.int32()),
                                pa.array(buckets_of(numbers, bits, t)),
                                rows.column("node"), rows.column("weight"), rows.column("body"), codes,
                                pa.array(factors),
                            ],
                            ["dim", "table", "bucket", "node", "weight", "body", "code", "factor"],
                        )

    return run


def _linked(x: np.ndarray, y: np.ndarray, sx: np.ndarray, fx: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y reach the cosine: settled by the codes of x, else exactly."""
    size = sx.shape[1]
    rotated = np.pad(y, ((0, 0), (0, size - y.shape[1]))) @ rotation(size)
    code = np.where(sx, 1.0, -1.0) / math.sqrt(size)
    estimate = (code @ rotated.T) / fx[:, None]
    margin = CONFIDENCE * np.sqrt(np.maximum(1 - fx**2, 0)) / fx / math.sqrt(size - 1)
    open_ = estimate + margin[:, None] >= cosine
    out = np.zeros(open_.shape, bool)
    for start in range(0, len(x), 256):
        rows = slice(start, start + 256)
        here = open_[rows]
        if here.mean() > 0.1:
            out[rows] = here & (x[rows] @ y.T >= cosine)
            continue
        a, b = np.nonzero(here)
        for at in range(0, len(a), 1 << 15):
            p, q = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
            good = np.einsum("ij,ij->i", x[start + p], y[q]) >= cosine
            out[start + p[good], q[good]] = True
    return out


def _forest(adjacent: np.ndarray) -> np.ndarray:
    """For a symmetric matrix, the first member of each row's component; -1 for rows without links."""
    root = np.full(len(adjacent), -1)
    for start in np.flatnonzero(adjacent.any(axis=1)):
        if root[start] < 0:
            front = np.zeros(len(adjacent), bool)
            front[start] = True
            while front.any():
                root[front] = start
                front = adjacent[front].any(axis=0) & (root < 0)
    return root


def _meet(cosine: float, bits: int, kind: str):
    """Link counts and a spanning forest of one bucket, or of two blocks of it."""

    def run(met: pa.Table) -> pa.Table:
        bodies = met.column("body").to_pylist()
        vectors = np.frombuffer(b"".join(bodies), kind).reshape(len(bodies), -1).astype(np.float64)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        codes = np.frombuffer(b"".join(met.column("code").to_pylist()), np.uint8).reshape(len(bodies), -1)
        signs = np.unpackbits(codes, axis=1).astype(bool)
        factors, weights = met.column("factor").to_numpy(), met.column("weight").to_numpy()
        nodes, side = met.column("node").to_numpy(), met.column("side").to_numpy()
        turn = met.column("table")[0].as_py()
        split = side.min() != side.max()
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if split else [np.arange(len(nodes))] * 2
        links = _linked(unit[left], unit[right], signs[left], factors[left], cosine)
        if split:
            adjacent = np.zeros((len(nodes), len(nodes)), bool)
            adjacent[np.ix_(left, right)] = links
            adjacent |= adjacent.T
        else:
            # The estimate is not symmetric, the link is.
            adjacent = links | links.T
            np.fill_diagonal(adjacent, False)
        root = _forest(adjacent)
        some = np.flatnonzero(root >= 0)
        fresh, numbers = adjacent[np.ix_(some, some)], whole_numbers(vectors[some])
        for t in range(turn):
            if not fresh.any():
                break
            found = buckets_of(numbers, bits, t)
            fresh &= found[:, None] != found[None, :]
        counts = fresh @ weights[some]
        return pa.table(
            {
                "node": pa.array(nodes[some]),
                "links": pa.array(counts.astype(np.int64)),
                "root": pa.array(nodes[root[some]]),
            }
        )

    return run


def link_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """Rows (key, n_links, component_id, kept), one per vector.

    Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing; so do vectors of different lengths.
    component_id is the smallest key reachable by links, itself included.
    Rows that repeat a key are vectors of their own that share its name; a
    null key stays and lends no name. An empty table gives an empty result;
    other columns are ignored. A class of equal vectors is named by 64 bits
    of a hash.
    """
    kind = "<f4" if rows.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    vectors = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    named = rows.select(F.col(key).cast("long").alias("id"), vectors.alias("vector")).mapInArrow(
        _node, "id long, node long, body binary"
    )
    named = materialise(named, "rabit-nodes")
    classes = named.where("node is not null").groupBy("node", "body").agg(F.count("*").alias("weight"))
    classes = materialise(classes, "rabit-classes")
    bits, tables = shape_of(classes.count(), cosine)
    filed = classes.mapInArrow(
        _file(bits, tables, kind),
        "dim int, table int, bucket long, node long, weight long, body binary, code binary, factor double",
    )
    filed = materialise(filed, "rabit-filed")
    place = ["dim", "table", "bucket"]
    sizes = filed.groupBy(*place).agg(F.count("*").alias("size")).where("size > 1")
    blocks = sizes.select(*place, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = filed.join(blocks, place).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(
            F.least("mine", j).alias("low"), F.greatest("mine", j).alias("high"),
            (F.col("mine") > j).cast("int").alias("side"),
        ),
    )
    pairs = placed.withColumn("pair", F.explode(others)).select(
        *place, F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), F.col("pair.side").alias("side"),
        "node", "weight", "body", "code", "factor",
    )
    met = pairs.groupBy(*place, "low", "high").applyInArrow(
        _meet(cosine, bits, kind), "node long, links long, root long"
    )
    met = materialise(met, "rabit-links")
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    forest = met.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    labels = components(forest, "rabit").select(F.col("id").alias("node"), "component")
    whole = (
        named.groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least")).where("node is not null")
        .join(counts, "node", "left").join(labels, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    whole = materialise(whole, "rabit-whole")
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    known = whole.join(least, "component").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    out = named.select("id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )


@query("op9_embedding_near_dedup")
def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return link_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))
