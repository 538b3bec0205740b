"""Overlap counts of wide sets by bitmaps of set ids per value.

The sets to be counted are dealt to blocks, and a block keeps, for every value
in it, which of its sets hold the value: as a list where few do, as a bitmap
otherwise. A set that asks visits only the blocks that hold
one of its values, ORs their bitmaps and adds up the weights of the bits that
are set, so work follows the sizes of the sets and nothing is paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinium.operators.arrow import one_array, ragged_arrow
from affinium.operators.blocks import block_count
from affinium.operators.skew import join_totals
from affinium.session import materialise

# Sets of a block, and (set, value) questions that one task answers.
BLOCK_SETS = 32_768
QUESTIONS = 1 << 18
# Asking sets and their values per step inside a task: both bound its working memory.
SETS_AT_ONCE = 256
# A bitmap may be this many times larger than its list, as it is united so much faster.
BITMAP_FACTOR = 8
VALUES_AT_ONCE = 4096
# Flags that become bitmaps in one step.
FLAGS_AT_ONCE = 1 << 24


class Postings:
    """Which rows of a block hold each value code, as lists or, where many do, bitmaps."""

    def __init__(self, rows: np.ndarray, codes: np.ndarray, n_rows: int, n_codes: int):
        self.n_bytes = -(-n_rows // 64) * 8
        order = np.argsort(codes, kind="stable")
        self.rows = rows[order]
        self.starts = np.searchsorted(codes[order], np.arange(n_codes + 1))
        lengths = np.diff(self.starts)
        common = np.flatnonzero(lengths * self.rows.itemsize * BITMAP_FACTOR > self.n_bytes)
        self.bitmap_at = np.full(n_codes, -1)
        self.bitmap_at[common] = np.arange(len(common))
        self.bitmaps = np.zeros((len(common), self.n_bytes), dtype=np.uint8)
        step = max(1, FLAGS_AT_ONCE // max(1, self.n_bytes * 8))
        for start in range(0, len(common), step):
            part = common[start : start + step]
            ends = np.cumsum(lengths[part])
            places = np.arange(lengths[part].sum()) + np.repeat(self.starts[part] - (ends - lengths[part]), lengths[part])
            flags = np.zeros((len(part), self.n_bytes * 8), dtype=bool)
            flags[np.repeat(np.arange(len(part)), lengths[part]), self.rows[places]] = True
            self.bitmaps[start : start + step] = np.packbits(flags, axis=1)

    def bits(self, rows: np.ndarray) -> np.ndarray:
        flags = np.zeros(self.n_bytes * 8, dtype=bool)
        flags[rows] = True
        return np.packbits(flags)

    def unite(self, asking: np.ndarray, codes: np.ndarray, n_asking: int) -> np.ndarray:
        """Bitmap of the rows holding any of an asker's codes; `asking` is sorted."""
        united = np.zeros((n_asking, self.n_bytes), dtype=np.uint8)
        flags = None
        for start in range(0, len(codes), VALUES_AT_ONCE):
            who, what = asking[start : start + VALUES_AT_ONCE], codes[start : start + VALUES_AT_ONCE]
            at = self.bitmap_at[what]
            if (at >= 0).any():
                owners, firsts = np.unique(who[at >= 0], return_index=True)
                united[owners] |= np.bitwise_or.reduceat(self.bitmaps[at[at >= 0]], firsts, axis=0)
            listed = what[at < 0]
            if not len(listed):
                continue
            if flags is None:
                flags = np.zeros((n_asking, self.n_bytes * 8), dtype=bool)
            lengths = self.starts[listed + 1] - self.starts[listed]
            # Positions of all entries of the asked lists, one after the other.
            ends = np.cumsum(lengths)
            places = np.arange(lengths.sum()) + np.repeat(self.starts[listed] - (ends - lengths), lengths)
            flags[np.repeat(who[at < 0], lengths), self.rows[places]] = True
        return united if flags is None else united | np.packbits(flags, axis=1)


def _weigh(bitmaps: np.ndarray, weights: np.ndarray, postings: Postings) -> np.ndarray:
    """Sum of the weights of the bits set in each row, by the binary digits of the weights."""
    words = bitmaps.view(np.uint64)
    total = np.zeros(len(bitmaps), dtype=np.int64)
    for digit in range(int(weights.max()).bit_length()):
        plane = postings.bits(np.flatnonzero(weights >> digit & 1)).view(np.uint64)
        total += np.bitwise_count(words & plane).sum(axis=1, dtype=np.int64) << digit
    return total


def _answer(questions: pa.Table, block: pa.Table) -> pa.Table:
    """`(set_id, n)` for the asking sets of one task against one block."""
    schema = pa.schema([("set_id", pa.int64()), ("n", pa.int64())])
    if not questions.num_rows or not block.num_rows:
        return schema.empty_table()
    rows, held = ragged_arrow(block["members"])
    asked = one_array(questions["value"])
    coded = pa.concat_arrays([held.cast(pa.string()), asked.cast(pa.string())]).dictionary_encode()
    codes = coded.indices.to_numpy()
    postings = Postings(rows.astype(np.int32), codes[: len(held)], block.num_rows, len(coded.dictionary))
    weights = block["weight"].to_numpy()
    ids, inverse = np.unique(questions["set_id"].to_numpy(), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    asking, codes = inverse[order], codes[len(held) :][order]
    found = np.zeros(len(ids), dtype=np.int64)
    for start in range(0, len(ids), SETS_AT_ONCE):
        end = min(start + SETS_AT_ONCE, len(ids))
        low, high = np.searchsorted(asking, [start, end])
        united = postings.unite(asking[low:high] - start, codes[low:high], end - start)
        found[start:end] = _weigh(united, weights, postings)
    return pa.table([pa.array(ids), pa.array(found)], schema=schema)


def _visits(asked: DataFrame, blocked: DataFrame) -> DataFrame:
    """`(set_id, value, block)`: the blocks that hold a value someone asks for."""
    places = blocked.select("block", F.explode("members").alias("value")).groupBy("value").agg(
        F.collect_set("block").alias("blocks")
    )
    counts = asked.groupBy("value").agg(F.count("*").alias("n_asked"))
    directory = counts.join(places.hint("merge"), "value")
    # A value that many ask for is split.
    found = join_totals(asked, directory, "value", "n_asked", "set_id")
    return found.select("set_id", "value", F.explode("blocks").alias("block"))


def overlap_weights(
    asking: DataFrame, held: DataFrame, block_sets: int = BLOCK_SETS, questions: int = QUESTIONS
) -> DataFrame:
    """`(set_id, n)` partial sums: weight of the `held` sets sharing a value with each asking set.

    Both are `(set_id, members, weight)` with distinct, non-null members and
    unique ids; read from stored tables, since they are used several times.
    Add up n per set_id; sets that share no value with any have no row. An
    asking set meets each block in one task, whatever its values.
    """
    asked = asking.select("set_id", F.explode("members").alias("value"))
    n_blocks, n_asked = block_count(held.count(), block_sets), asked.count()
    blocked = held.withColumn("block", F.pmod(F.xxhash64("set_id"), F.lit(n_blocks)).cast("int"))
    visits, n_visits = asked.withColumn("block", F.lit(0)), n_asked
    if n_blocks > 1:
        visits = materialise(_visits(asked, blocked), "visits")
        n_visits = visits.count()
    cores = asking.sparkSession.sparkContext.defaultParallelism
    n_parts = max(block_count(n_visits, questions * n_blocks), block_count(cores, n_blocks))
    part = F.pmod(F.xxhash64("set_id", F.lit("part")), F.lit(n_parts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)))
    return (
        visits.withColumn("part", part).groupBy("block", "part")
        .cogroup(blocked.select("block", "members", "weight", copies.alias("part")).groupBy("block", "part"))
        .applyInArrow(_answer, "set_id long, n long")
    )
