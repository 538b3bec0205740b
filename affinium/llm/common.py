"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinium.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters that end a word: white space, or everything ASCII but digits and lower-case letters.
SPACES = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Text bytes handled at once inside a task.
CHUNK_BYTES = 4 << 20


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key counts as empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def small_slices(batches, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of `column`; one long text stays whole."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // limit
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else [0]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(int(start), int(stop - start))


def flat_words(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """Words of lower-cased texts, one after the other, and how many each text has."""
    # A copy that starts at offset 0: lower-casing a slice of a batch can give wrong offsets.
    whole = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    split = pc.split_pattern_regex(pc.ascii_lower(whole), pattern=pattern)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    words = split.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)[full]
    return words.filter(pa.array(full)), np.bincount(owner, minlength=len(counts))


def components(links: DataFrame, name: str) -> DataFrame:
    """Connected components: links (a, b) between longs to rows (id, component), component = smallest id.

    Each round hangs every component under its smallest neighbour, follows
    the pointers to their roots by doubling, and rewrites the links between
    roots. Rounds and doublings grow with the logarithm of the longest chain.
    Links with a null end, and of an id with itself, are ignored.
    """
    spark = links.sparkSession
    edges = materialise(links.select("a", "b").where("a <> b").distinct(), f"{name}-links")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b"))).distinct()
    labels = nodes.withColumn("component", F.col("id"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("least"))
        parents = materialise(up.select(F.col("a").alias("id"), F.least("a", "least").alias("parent")), f"{name}-up")
        while True:
            higher = parents.select(F.col("id").alias("parent"), F.col("parent").alias("root"))
            jumped = parents.join(higher, "parent").select("id", "parent", "root")
            step = materialise(jumped, f"{name}-jump")
            parents = step.select("id", F.col("root").alias("parent"))
            if step.where("parent <> root").isEmpty():
                break
        root = parents.select(F.col("id").alias("component"), F.col("parent").alias("root"))
        labels = materialise(
            labels.join(root, "component", "left").select("id", F.coalesce("root", "component").alias("component")),
            f"{name}-labels",
        )
        left = parents.select(F.col("id").alias("a"), F.col("parent").alias("ra"))
        right = parents.select(F.col("id").alias("b"), F.col("parent").alias("rb"))
        edges = materialise(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(),
            f"{name}-links",
        )
    return labels if not labels.isEmpty() else spark.createDataFrame([], "id long, component long")
