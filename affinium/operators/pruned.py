"""Exact top-k by dot product with pruning: blocks of alike items, and a bound that skips them.

Items are filed by their nearest pivot, and a pivot's items in blocks of
bounded size. A block knows its mean c and the largest distance r of an item
from it, so that no item of it scores above q.c + |q| r. A query first visits
the blocks with the highest bounds until they hold k items, which gives it a
score to beat, and then only the blocks whose bound reaches that score. For
that a query is sent once to each group of blocks that holds one of those, so
that what is sent stays a grid's where no block can be left out. The
result is that of `topk.rank_catalog` whatever the pivots are; where no block
can be left out, all are visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinium.operators.arrow import matrix, one_array, vector_column
from affinium.operators.topk import CANDIDATES, QUERY_CHUNK, SCORE_DIGITS, _best, _block_candidates, _candidate_table
from affinium.session import materialise

# Pivots at most, items of a block on average, and queries that meet a block at once on average.
PIVOTS = 256
BLOCK_ITEMS = 2048
BLOCK_QUERIES = 4096
# Bounds of queries and blocks that a task holds at once.
BOUNDS_AT_ONCE = 1 << 20
# Items of a group of blocks, queries that meet a group in one task, and tasks that a small table is cut into.
GROUP_ITEMS = 32_768
GROUP_QUERIES = 65_536
GROUP_TASKS = 24
LEAST_QUERIES = 1024
# Tasks of the first visits.
FIRST_TASKS = 64
# Bounds and rounded scores may differ by this much.
SLACK = 2 * 10.0**-SCORE_DIGITS


def choose_pivots(catalog: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """A bounded sample of the items' vectors, the first by a hash of their ids."""
    rows = catalog.orderBy(F.xxhash64("row_id"), "row_id").limit(count).select("embedding")
    return matrix(rows.toArrow()["embedding"]) if rows.columns else np.zeros((0, 0))


def file_items(catalog: DataFrame, pivots: int = PIVOTS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Items with the block they belong to: `(row_id, embedding, block)`, written once.

    `block` numbers (pivot, part); ids, not values, decide the part, so
    copies cannot make a block large.
    """
    total = catalog.count()
    centres = choose_pivots(catalog, min(pivots, max(1, total // block_items)))
    shared = catalog.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, points = matrix(batch.column("embedding")), shared.value
            # |x - p|^2 without |x|^2, which is the same for all pivots.
            apart = (points**2).sum(axis=1) - 2 * vectors @ points.T
            yield batch.append_column("pivot", pa.array(apart.argmin(axis=1).astype(np.int32)))

    filed = catalog.select("row_id", "embedding")
    kind = filed.schema["embedding"].dataType.simpleString()
    filed = materialise(filed.mapInArrow(nearest, f"row_id long, embedding {kind}, pivot int"), "filed")
    sizes = filed.groupBy("pivot").agg(F.ceil(F.count("*") / block_items).cast("int").alias("parts"))
    # A row per pivot at most.
    placed = filed.join(F.broadcast(sizes), "pivot")
    part = F.pmod(F.xxhash64("row_id"), F.col("parts"))
    return materialise(placed.select("row_id", "embedding", F.shiftleft("pivot", 32).cast("long").alias("_p"), part.alias("_q"))
                       .select("row_id", "embedding", (F.col("_p") + F.col("_q")).alias("block")), "filed-items")


def _summaries(filed: DataFrame) -> DataFrame:
    """Per block its mean, radius and number of items."""

    def summary(block: pa.Table) -> pa.Table:
        vectors = matrix(block["embedding"])
        centre = vectors.mean(axis=0)
        radius = float(np.sqrt(((vectors - centre) ** 2).sum(axis=1).max()))
        return pa.table(
            {"block": block["block"].slice(0, 1), "centre": vector_column(centre[None, :], pa.float64()),
             "radius": pa.array([radius]), "items": pa.array([len(vectors)], pa.int64())}
        )

    return filed.groupBy("block").applyInArrow(summary, "block long, centre array<double>, radius double, items long")


def _bounds(queries: np.ndarray, blocks: pa.Table) -> np.ndarray:
    """Highest score that an item of each block can have with each query."""
    norms = np.linalg.norm(queries, axis=1, keepdims=True)
    # The bound is no smaller than the score for rounding's sake.
    return queries @ matrix(blocks["centre"]).T + norms * blocks["radius"].to_numpy()[None, :] * (1 + 1e-12) + SLACK


def _slices(batch: pa.RecordBatch, n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of queries whose bounds fit."""
    size = max(1, BOUNDS_AT_ONCE // max(1, n_blocks))
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def _first_visits(shared, k: int):
    """Per query the blocks with the highest bounds until they hold k items besides the query itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        items, numbers = blocks["items"].to_numpy(), blocks["block"].to_numpy()
        for batch in batches:
            if not batch.num_rows or not len(numbers):
                continue
            for part in _slices(batch, len(numbers)):
                order = np.argsort(-_bounds(matrix(part.column("embedding")), blocks), axis=1, kind="stable")
                held = np.cumsum(items[order], axis=1)
                # A block is visited where those before it hold too few.
                rows, cols = np.nonzero(np.c_[np.zeros(len(held), np.int64), held[:, :-1]] < k + 1)
                for start in range(0, len(rows), BLOCK_QUERIES):
                    at = slice(start, start + BLOCK_QUERIES)
                    out = part.take(pa.array(rows[at]))
                    yield out.append_column("block", pa.array(numbers[order[rows[at], cols[at]]]))

    return run


def _open(queries: pa.Table | pa.RecordBatch, blocks: pa.Table) -> np.ndarray:
    """Which blocks can hold a better item for each query `(embedding, beat, seen)` than it has, seen ones not."""
    beat = one_array(queries["beat"]).to_numpy(zero_copy_only=False)
    open_ = _bounds(matrix(queries["embedding"]), blocks) >= np.where(np.isnan(beat), -np.inf, beat)[:, None]
    places = {n: i for i, n in enumerate(blocks["block"].to_pylist())}
    for row, known in enumerate(queries["seen"].to_pylist()):
        open_[row, [places[b] for b in known if b in places]] = False
    return open_


def _group_visits(shared, groups: np.ndarray):
    """Per query with a score to beat the groups with a block whose bound reaches it, and the items of such blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        items = blocks["items"].to_numpy()
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else groups
        for batch in batches:
            if not batch.num_rows or not len(groups):
                continue
            for part in _slices(batch, len(groups)):
                open_items = np.add.reduceat(_open(part, blocks) * items, starts, axis=1)
                rows, cols = np.nonzero(open_items)
                for start in range(0, len(rows), BLOCK_QUERIES):
                    at = slice(start, start + BLOCK_QUERIES)
                    out = part.take(pa.array(rows[at]))
                    out = out.append_column("group", pa.array(cols[at], pa.int32()))
                    yield out.append_column("items", pa.array(open_items[rows[at], cols[at]], pa.int64()))

    return run


def _visit_groups(visits: DataFrame, filed: DataFrame, shared, groups: np.ndarray, k: int, exclude_self: bool) -> DataFrame:
    """Top k, no worse than the score to beat, of the open blocks of each visited group per query."""
    spark = visits.sparkSession
    numbers = shared.value["block"].to_numpy()
    n_groups = int(groups.max(initial=-1)) + 1

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids = left["q_id"].to_numpy()
        nothing = np.zeros(0, np.int64)
        kept = [(nothing, nothing, np.zeros(0))]
        if left.num_rows and right.num_rows:
            blocks = shared.value.filter(pa.array(groups == left["group"][0].as_py()))
            right = right.sort_by("block")
            of, ids, items = right["block"].to_numpy(), right["row_id"].to_numpy(), matrix(right["embedding"])
            edges = np.searchsorted(of, blocks["block"].to_numpy(), "left"), np.searchsorted(of, blocks["block"].to_numpy(), "right")
            for start in range(0, left.num_rows, QUERY_CHUNK):
                part = left.slice(start, QUERY_CHUNK).combine_chunks()
                open_ = _open(part, blocks)
                beat = one_array(part["beat"]).to_numpy(zero_copy_only=False)
                own = [kept[0]]
                for at, (low, high) in enumerate(zip(*edges, strict=True)):
                    asking = np.flatnonzero(open_[:, at])
                    if not len(asking) or low == high:
                        continue
                    column = part["embedding"].take(pa.array(asking))
                    q_pos, found_ids, found = _block_candidates(
                        q_ids[start + asking], column, ids[low:high], items[low:high], k, exclude_self,
                        np.where(np.isnan(beat[asking]), -np.inf, beat[asking]),
                    )
                    own.append((asking[q_pos] + start, found_ids, found))
                kept.append(_best(*(np.concatenate(parts) for parts in zip(*own, strict=True)), k))
        return _candidate_table(q_ids, tuple(np.concatenate(parts) for parts in zip(*kept, strict=True)))

    n = F.count("*")
    least = F.least(F.ceil(n / LEAST_QUERIES), F.lit(-(-GROUP_TASKS // max(1, n_groups))))
    parts = visits.groupBy("group").agg(F.greatest(F.ceil(n / GROUP_QUERIES), least).cast("int").alias("parts"))
    parts = materialise(parts, "group-parts")
    tasks = max(1, parts.agg(F.sum("parts")).first()[0] or 0)
    of_block = spark.createDataFrame([*zip(numbers.tolist(), groups.tolist(), strict=True)], "block long, group int")
    asks = visits.join(F.broadcast(parts), "group").withColumn("part", F.pmod(F.xxhash64("q_id"), F.col("parts")).cast("int"))
    # A row per block, a row per group.
    items = filed.join(F.broadcast(of_block), "block").join(F.broadcast(parts), "group")
    items = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # A given number of partitions: few bytes can be much work, so none are merged.
    asks, items = (side.repartition(tasks, "group", "part") for side in (asks.drop("parts", "items"), items))
    return asks.groupBy("group", "part").cogroup(items.groupBy("group", "part")).applyInArrow(cell, CANDIDATES)


def _visit(visits: DataFrame, filed: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Top k of each visited block per query; a block's queries are split, its items copied to each part."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids = left["q_id"].to_numpy()
        if not left.num_rows or not right.num_rows:
            nothing = np.zeros(0, np.int64)
            return _candidate_table(nothing, (nothing, nothing, np.zeros(0)))
        best = _block_candidates(q_ids, left["embedding"], right["row_id"].to_numpy(), matrix(right["embedding"]), k, exclude_self)
        return _candidate_table(q_ids, best)

    parts = visits.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("parts"))
    asks = visits.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("q_id"), F.col("parts")).cast("int")).drop("parts")
    items = filed.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    # A given number of partitions: few bytes can be much work, so none are merged.
    asks, items = (side.repartition(FIRST_TASKS, "block", "part") for side in (asks, items))
    return asks.groupBy("block", "part").cogroup(items.groupBy("block", "part")).applyInArrow(cell, CANDIDATES)


def rank_pruned(
    queries: DataFrame, catalog: DataFrame, k: int, exclude_self: bool = True, pivots: int = PIVOTS,
    block_items: int = BLOCK_ITEMS, filed: DataFrame | None = None,
) -> tuple[DataFrame, float]:
    """`rank_catalog` with pruning: `(q_id, row_id, score, rank)`, and the share of pairs that were not multiplied.

    `filed` is what `file_items` wrote for the catalog, if it is there
    already. Query ids are unique. Block summaries, a vector per BLOCK_ITEMS
    items, are broadcast.
    """
    spark = queries.sparkSession
    filed = file_items(catalog, pivots, block_items) if filed is None else filed
    blocks = _summaries(filed).orderBy("block").toArrow()
    shared = spark.sparkContext.broadcast(blocks)
    asked = queries.select("q_id", "embedding")
    kind = asked.schema["embedding"].dataType.simpleString()
    visits = f"q_id long, embedding {kind}, block long"
    first = materialise(asked.mapInArrow(_first_visits(shared, k), visits), "first-visits")
    found = materialise(_visit(first, filed, k, exclude_self), "first-found")
    best_first = Window.partitionBy("q_id").orderBy(F.desc("score"), "row_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    beat = ranked.filter(F.col("rank") == k).select("q_id", F.col("score").alias("beat"))
    seen = first.groupBy("q_id").agg(F.collect_set("block").alias("seen"))
    again = asked.join(seen, "q_id").join(beat, "q_id", "left").select("q_id", "embedding", "beat", "seen")
    counts = blocks["items"].to_numpy().astype(np.int64)
    groups = (np.cumsum(counts) - counts) // GROUP_ITEMS
    # Numbered without gaps, in the order of the blocks.
    groups = np.unique(groups, return_inverse=True)[1]
    visits = f"q_id long, embedding {kind}, beat double, seen array<long>, group int, items long"
    other = materialise(again.mapInArrow(_group_visits(shared, groups), visits), "other-visits")
    more = _visit_groups(other, filed, shared, groups, k, exclude_self)
    whole = ranked.drop("rank").unionByName(more)
    best = whole.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    sizes = spark.createDataFrame(blocks.select(["block", "items"]).to_pylist() or [], "block long, items long")
    at_first = first.join(F.broadcast(sizes), "block").agg(F.sum("items")).first()[0]
    done = (at_first or 0) + (other.agg(F.sum("items")).first()[0] or 0)
    total = asked.count() * int(counts.sum())
    return best, 1 - done / total if total else 0.0
