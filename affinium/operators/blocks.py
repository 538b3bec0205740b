"""Block grid: exact many-to-many computation in tasks of bounded size.

Both sides are hashed by their unique id into blocks of about the same size,
and every pair of blocks becomes one group. A group never depends on values
(copies, popular categories), so no key can be hot, and each group emits a
reduced result instead of its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384
# Bytes of vectors, as doubles, in a block of a side. Fewer and larger blocks mean fewer copies and fewer results to merge.
BLOCK_BYTES = 32 << 20
# Pairs of blocks that a table of a few blocks is cut into, so that all cores have some, of no fewer left rows than this.
CELLS = 24
LEAST_ROWS = 1024
# Blocks of a side with given block_rows, after which blocks grow to their bytes; each copies the other side once.
MOST_BLOCKS = 6
# Partitions per pair of blocks: with one, hashing puts three or four pairs into some tasks and none into others.
SPREAD = 4


def block_count(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(1, -(-rows // block_rows))


def rows_of(df: DataFrame, vector: str) -> tuple[int, int]:
    """Number of rows and of vectors' components per block, from one pass."""
    found = df.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dim")).first()
    return found["n"], max(1, BLOCK_BYTES // (8 * max(1, found["dim"] or 1)))


def block_grid(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    right_id: str,
    reduce_cell: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    block_rows: int | None = BLOCK_ROWS,
    left_rows: int | None = None,
    right_rows: int | None = None,
    vector: str | None = None,
) -> DataFrame:
    """Apply `reduce_cell` to every (left block, right block) pair.

    Without block_rows, blocks are sized by the bytes of the `vector` column.
    With both, block_rows holds for small tables only, as each side is copied
    once per block of the other.
    """
    left_block = right_block = block_rows
    if vector is not None:
        left_rows, left_most = rows_of(left, vector)
        right_rows, right_most = rows_of(right, vector)
        if block_rows is None:
            right_block = right_most
            per_side = -(-CELLS // block_count(right_rows, right_block))
            left_block = min(left_most, max(LEAST_ROWS, block_count(left_rows, per_side)))
        else:
            left_block = max(block_rows, min(left_most, block_count(left_rows, MOST_BLOCKS)))
            right_block = max(block_rows, min(right_most, block_count(right_rows, MOST_BLOCKS)))
    n_left = block_count(left.count() if left_rows is None else left_rows, left_block)
    n_right = block_count(right.count() if right_rows is None else right_rows, right_block)

    def spread(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        # Fresh aliases: both sides may stem from one table.
        own_side = df.select(*[F.col(name).alias(name) for name in df.columns])
        placed = own_side.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int"))
        # A given number of partitions: few bytes can be much work, so none are merged, and few hold two cells.
        return placed.withColumn(other, copies).repartition(SPREAD * n_left * n_right, "_lb", "_rb")

    left_cells = spread(left, left_id, "_lb", n_left, "_rb", n_right)
    right_cells = spread(right, right_id, "_rb", n_right, "_lb", n_left)
    return (
        left_cells.groupBy("_lb", "_rb")
        .cogroup(right_cells.groupBy("_lb", "_rb"))
        .applyInArrow(reduce_cell, schema)
    )
