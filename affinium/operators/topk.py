"""Exact top-k by dot product: one query, or a whole table of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinium.functions import vectors as vec
from affinium.operators.arrow import matrix
from affinium.operators.blocks import block_grid

# Queries and items multiplied at once, so that their scores stay in a core's cache.
QUERY_CHUNK = 512
TILE_ITEMS = 1024
# Items between two updates of the scores to beat: at first so many, then as many as were seen, at most so many.
FIRST_ITEMS = 1024
ITEM_CHUNK = 8192
# Pairs scored in double precision at once.
PAIRS_AT_ONCE = 1 << 16
# Vectors with larger entries are not multiplied in single precision.
SINGLE_LIMIT = 1e15
# Equal vectors must tie whatever kernel multiplied them.
SCORE_DIGITS = 9

CANDIDATES = "q_id long, row_id long, score double"
RESULT_COLUMNS = ["title", "year", "genres", "rating", "score"]


def scores(catalog: DataFrame, query: Column, similarity=vec.dot) -> DataFrame:
    """Catalog with the score of every item against one query vector."""
    return catalog.withColumn("score", F.round(similarity(F.col("embedding"), query), SCORE_DIGITS))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best k rows; each task keeps k rows, the driver merges them."""
    return scored.orderBy(F.desc("score"), "row_id").limit(k)


def query_vector(values) -> Column:
    """A single query vector as a plan constant."""
    return F.array(*[F.lit(float(value)) for value in values])


def similar_to_row(index: DataFrame, row, k: int) -> DataFrame:
    """Items most similar to a known item, the item itself excluded."""
    others = index.filter(F.col("row_id") != row["row_id"])
    return top_k(scores(others, query_vector(row["embedding"])), k)


def present(result: DataFrame) -> DataFrame:
    return result.select(*RESULT_COLUMNS)


# --- many queries ---------------------------------------------------------


def _best(q_pos: np.ndarray, ids: np.ndarray, found: np.ndarray, k: int):
    """Keep k candidates per query, by score and then by the lower id."""
    order = np.lexsort((ids, -found, q_pos))
    q_pos, ids, found = q_pos[order], ids[order], found[order]
    starts = np.flatnonzero(np.r_[True, q_pos[1:] != q_pos[:-1]]) if len(q_pos) else np.zeros(0, int)
    nth = np.arange(len(q_pos)) - np.repeat(starts, np.diff(np.r_[starts, len(q_pos)]))
    kept = nth < k
    return q_pos[kept], ids[kept], found[kept]


def _exact_scores(queries: np.ndarray, items: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Rounded scores of single pairs."""
    found = np.empty(len(rows))
    for start in range(0, len(rows), PAIRS_AT_ONCE):
        part = slice(start, start + PAIRS_AT_ONCE)
        found[part] = np.einsum("ij,ij->i", queries[rows[part]], items[cols[part]].astype(np.float64, copy=False))
    return np.round(found, SCORE_DIGITS)


def _marked(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few true entries of a mask, eight looked at together."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    places = (np.flatnonzero(flat.view(np.uint64) != 0)[:, None] * 8 + np.arange(8)).reshape(-1)
    return places[flat[places]]


def _longest(rows: np.ndarray) -> float:
    """Length of the longest vector; not a number if one holds such an entry."""
    found = [0.0]
    for start in range(0, len(rows), ITEM_CHUNK):
        part = rows[start : start + ITEM_CHUNK].astype(np.float64)
        found.append(np.sqrt((part**2).sum(axis=1).max()))
    return np.max(found)


def _block_candidates(q_ids, queries, ids, items, k, exclude_self, beat=None):
    """Top k of one block of items for every query, by score and then by the lower id.

    `queries` is a list column, `items` a matrix in single or double precision.
    Products in single precision, with a margin for their error, only tell
    which pairs can beat the k-th score so far; those are scored in double
    precision. Items come by rising id, so that an equal score never beats a
    kept one. Scores below `beat`, one per query, do not matter.
    """
    order = np.argsort(ids, kind="stable")
    ids, items = ids[order], items[order]
    longest = _longest(items)
    kind = np.float32 if longest < SINGLE_LIMIT else np.float64
    rough_items = items.astype(kind, copy=False)
    kept = []
    for start in range(0, len(q_ids), QUERY_CHUNK):
        own = q_ids[start : start + QUERY_CHUNK]
        asked = matrix(queries.slice(start, QUERY_CHUNK))
        norms = np.sqrt((asked**2).sum(axis=1))
        # Too long or not a number: no single precision for these queries.
        rough_kind = kind if norms.max() < SINGLE_LIMIT else np.float64
        rough, held = asked.astype(rough_kind), rough_items if rough_kind is kind else items.astype(rough_kind)
        margin = (items.shape[1] + 2) * np.finfo(rough_kind).eps * norms * longest + 2 * 10.0**-SCORE_DIGITS
        best = (np.zeros(0, np.int64), ids[:0], np.zeros(0))
        edge = np.full(len(own), -np.inf)
        if beat is not None:
            edge = np.nextafter(beat[start : start + QUERY_CHUNK], -np.inf)
        space, marks = np.empty(len(own) * TILE_ITEMS, rough_kind), np.empty(len(own) * TILE_ITEMS, bool)
        at = 0
        while at < len(ids):
            step = min(at + min(max(at, FIRST_ITEMS), ITEM_CHUNK), len(ids))
            open_ = np.isneginf(edge).any()
            new = [best]
            for first in range(at, step, TILE_ITEMS):
                last = min(first + TILE_ITEMS, step)
                wide = last - first
                sims = np.matmul(rough, held[first:last].T, out=space[: len(own) * wide].reshape(-1, wide))
                low = edge - margin
                if wide > k and open_:
                    if exclude_self:
                        sims[own[:, None] == ids[None, first:last]] = -np.inf
                    low = np.fmax(low, np.partition(sims, wide - k, axis=1)[:, wide - k] - 2 * margin)
                low = np.nextafter(low.astype(rough_kind), rough_kind(-np.inf))
                mask = np.greater_equal(sims, low[:, None], out=marks[: len(own) * wide].reshape(-1, wide))
                rows, cols = np.divmod(_marked(mask), wide)
                cols += first
                if exclude_self:
                    others = own[rows] != ids[cols]
                    rows, cols = rows[others], cols[others]
                found = _exact_scores(asked, items, rows, cols)
                better = found > edge[rows]
                new.append((rows[better], ids[cols[better]], found[better]))
            if any(len(part[0]) for part in new[1:]):
                best = _best(*(np.concatenate(parts) for parts in zip(*new, strict=True)), k)
                last_of = np.flatnonzero(np.r_[best[0][1:] != best[0][:-1], True])
                full = last_of[np.diff(np.r_[-1, last_of]) == k]
                edge[best[0][full]] = best[2][full]
            at = step
        kept.append((best[0] + start, *best[1:]))
    return tuple(np.concatenate(parts) for parts in zip(*kept, strict=True))


def _candidate_table(q_ids: np.ndarray, best) -> pa.Table:
    q_pos, ids, found = best
    return pa.table(
        {"q_id": pa.array(q_ids[q_pos], pa.int64()), "row_id": pa.array(ids, pa.int64()),
         "score": pa.array(found, pa.float64())}
    )


def rank_catalog(
    queries: DataFrame,
    catalog: DataFrame,
    k: int,
    exclude_self: bool = True,
    block_rows: int | None = None,
    query_rows: int | None = None,
    catalog_rows: int | None = None,
) -> DataFrame:
    """Exact top-k of `catalog(row_id, embedding)` for each of `queries(q_id, embedding)`.

    Returns `(q_id, row_id, score, rank)`. Blocks of queries meet blocks of
    items, each of bounded bytes; only k rows per query leave a pair of blocks.
    With block_rows a table has at least as many blocks as rows / block_rows,
    up to `blocks.MOST_BLOCKS`.
    """

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids = left["q_id"].to_numpy()
        if not left.num_rows or not right.num_rows:
            nothing = np.zeros(0, np.int64)
            return _candidate_table(nothing, (nothing, nothing, np.zeros(0)))
        best = _block_candidates(
            q_ids, left["embedding"], right["row_id"].to_numpy(), matrix(right["embedding"], None), k, exclude_self,
        )
        return _candidate_table(q_ids, best)

    candidates = block_grid(
        queries.select("q_id", "embedding"), catalog.select("row_id", "embedding"), "q_id", "row_id",
        cell, CANDIDATES, block_rows, query_rows, catalog_rows, "embedding",
    )
    best_first = Window.partitionBy("q_id").orderBy(F.desc("score"), "row_id")
    return candidates.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def rank_by_score(scored: DataFrame, k: int) -> DataFrame:
    """Rank rows of `(q_id, row_id, score)` within each query."""
    best_first = Window.partitionBy("q_id").orderBy(F.desc("score"), "row_id")
    return scored.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
