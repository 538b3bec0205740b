"""Language-model scores by deleted interpolation.

Documents are tokenised once into blocks of bounded size, each one row:
token ids within the block, and a 64-bit hash per distinct token. Every
block asks for the counts of its distinct n-grams: their hashes, sorted and
cut by range, go to as many reducers as the corpus needs, with how often
the block's training documents hold them. A reducer adds up and sends each
block the totals back in its own order. An n-gram, however frequent, is one
number per block, so nothing is skewed, and no table of the corpus ever
stands in one place.

An n-gram's maximum-likelihood estimate given its history is mixed with the
estimate of the next lower order, down to a uniform one; the weights depend
on how often the history was seen, in buckets of powers of two. They are
learned by expectation-maximisation on counts from which the token at hand
is held out: its own occurrence is deleted. Tokens whose estimates agree in
bucket and in half-octave steps share a cell, so learning reads one small
table of cells that all training tokens went into.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium.llm.common import SPACES, flat_words, fold_of, small_slices
from affinium.llm.registry import query, table
from affinium.session import materialise

ORDER = 2
MOST_ORDER = 3
BLOCK_BYTES = 4 << 20
# Distinct n-grams a reducer is meant to hold.
REDUCER_KEYS = 1 << 20
BUCKETS = 32
LEVELS = 64
EM_ROUNDS = 60

END = np.uint64(0x9AE16A3B2F90404F)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _pack(values: np.ndarray, kind: str) -> bytes:
    """Bytes of equal rank next to each other, compressed."""
    values = np.ascontiguousarray(values.astype(kind))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    size, width = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    raw = pa.decompress(blob[8:], decompressed_size=size * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, size).T).reshape(-1).view(kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)), "<u8")


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, "<u8"), dtype=np.uint64)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (key, text, train) to blocks."""
    for batch in small_slices(batches, "text", BLOCK_BYTES):
        words, counts = flat_words(batch.column("text"), SPACES)
        coded = words.dictionary_encode()
        known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # The end of each document is one more token; ids in order of frequency pack well.
        ids = np.insert(ids, np.cumsum(counts), len(known))
        known = np.append(known, END)
        often = np.bincount(ids, minlength=len(known))
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([uuid.uuid4().int >> 65], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.array([_pack(rank[ids], "<u4")], pa.binary()),
                pa.array([known[order].astype("<u8").tobytes()], pa.binary()),
                pa.array([_pack(counts + 1, "<u4")], pa.binary()),
                pa.array([_pack(batch.column("train").to_numpy(zero_copy_only=False), "u1")], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column("key")),
            ],
            ["block", "n_tokens", "tokens", "words", "sizes", "train", "keys"],
        )


class Block:
    """A block's tokens and n-gram keys; `grams[k]` holds (sorted distinct keys, place of each token's key)."""

    def __init__(self, row: dict, order: int):
        words = np.frombuffer(row["words"], "<u8")
        hashes = words[_unpack(row["tokens"], "<u4")]
        self.sizes = _unpack(row["sizes"], "<u4").astype(np.int64)
        self.train = _unpack(row["train"], "u1").astype(bool)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.grams, keys = [], hashes
        for k in range(order):
            if k:
                history = np.roll(keys, 1)
                history[self.first] = END + np.uint64(k)
                keys = _mix(history * _FACTOR + hashes + np.uint64(k))
            self.grams.append(np.unique(keys, return_inverse=True))

    def estimates(self, counts: list[np.ndarray], total: float, documents: float, delete: int):
        """Per order: (estimate, count of the history), with `delete` occurrences of each token taken out."""
        history = np.full(len(self.owner), max(total - delete, 0.0))
        out, mine = [], None
        for (_, place), found in zip(self.grams, counts):
            if mine is not None:
                history = np.roll(mine, 1)
                history[self.first] = documents
                history = np.maximum(history - delete, 0)
            mine = found[place].astype(np.float64)
            out.append((np.maximum(mine - delete, 0) / np.maximum(history, 1), history))
        return out


def _ask(order: int, bits: int):
    """Requests for counts: a row per block, order and range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, order)
                weight = block.train[block.owner].astype(np.float64)
                for k, (keys, place) in enumerate(block.grams):
                    here = np.bincount(place, weights=weight, minlength=len(keys)).astype(np.int64)
                    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
                    spans = list(zip(cuts[:-1], cuts[1:]))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([row["block"]] * len(spans), pa.int64()),
                            "level": pa.array([k] * len(spans), pa.int32()),
                            "part": pa.array([part[a] for a, _ in spans], pa.int64()),
                            "grams": pa.array([_pack_sorted(keys[a:b]) for a, b in spans], pa.binary()),
                            "here": pa.array([_pack(here[a:b], "<u8") for a, b in spans], pa.binary()),
                        }
                    )

    return run


ANSWER = "block long, level int, part long, counts binary, n_distinct long, n_total long"


def _answer(asked: pa.Table) -> pa.Table:
    """Totals of one range, for each block in its own order, and one row (block -1) with the range's sizes."""
    blocks = asked.column("block").to_pylist()
    keys = [_unpack_sorted(b) for b in asked.column("grams").to_pylist()]
    here = np.concatenate([_unpack(b, "<u8") for b in asked.column("here").to_pylist()])
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, weights=here, minlength=len(distinct)).astype(np.int64)
    stops = np.cumsum([len(k) for k in keys])
    counts = [_pack(totals[place[b - len(k) : b]], "<u8") for k, b in zip(keys, stops)]
    n = len(blocks)
    return pa.table(
        {
            "block": pa.array([*blocks, -1], pa.int64()),
            "level": pa.array([asked.column("level")[0].as_py()] * (n + 1), pa.int32()),
            "part": pa.array([asked.column("part")[0].as_py()] * (n + 1), pa.int64()),
            "counts": pa.array([*counts, None], pa.binary()),
            "n_distinct": pa.array([None] * n + [int((totals > 0).sum())], pa.int64()),
            "n_total": pa.array([None] * n + [int(totals.sum())], pa.int64()),
        }
    )


def _bucket(history: np.ndarray) -> np.ndarray:
    """0 for a history never seen, else 1 + floor(log2) of its count."""
    return np.minimum(np.frexp(np.maximum(history, 0.5))[1], BUCKETS - 1)


def _meet(order: int, total: int, documents: int):
    """Blocks with their answers: the counts, and the cells of their training tokens."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        block = Block(row, order)
        found = sorted(
            zip(answers.column("level").to_pylist(), answers.column("part").to_pylist(),
                answers.column("counts").to_pylist()),
            key=lambda x: x[:2],
        )
        counts = [np.concatenate([_unpack(b, "<u8") for level, _, b in found if level == k]) for k in range(order)]
        taken = block.train[block.owner]
        cell, ratios = np.zeros(int(taken.sum()), np.int64), []
        for ratio, history in block.estimates(counts, total, documents, 1):
            ratio, history = ratio[taken], history[taken]
            level = np.where(ratio > 0, np.clip(1 - np.floor(2 * np.log2(np.maximum(ratio, 1e-300))), 1, LEVELS - 1), 0)
            cell = (cell * BUCKETS + _bucket(history)) * LEVELS + level.astype(np.int64)
            ratios.append(ratio)
        names, place = np.unique(cell, return_inverse=True)
        sums = [np.bincount(place, weights=r, minlength=len(names)) for r in ratios]
        columns = {n: blocks.column(n) for n in blocks.column_names}
        columns["counts"] = pa.array([[_pack(c, "<u8") for c in counts]], pa.list_(pa.binary()))
        columns["cells"] = pa.array([names.tolist()], pa.list_(pa.int64()))
        columns["sizes_of_cells"] = pa.array(
            [np.bincount(place, minlength=len(names)).astype(float).tolist()], pa.list_(pa.float64())
        )
        columns["ratios"] = pa.array(
            [np.stack(sums, axis=1).reshape(-1).tolist() if sums else []], pa.list_(pa.float64())
        )
        return pa.table(columns)

    return run


def mixture(ratios: list, buckets: list, floor: float, weights: list[np.ndarray]) -> np.ndarray:
    """Interpolated probability, lowest order first."""
    p = np.full(len(ratios[0]), floor)
    for ratio, bucket, weight in zip(ratios, buckets, weights):
        w = weight[bucket]
        p = w * ratio + (1 - w) * p
    return p


def learn_weights(
    size: np.ndarray, ratios: list[np.ndarray], buckets: list[np.ndarray], floor: float, rounds: int = EM_ROUNDS
) -> list[np.ndarray]:
    """Weight of each order by bucket, by expectation-maximisation over cells."""
    weights = [np.where(np.arange(BUCKETS) > 0, 0.5, 0.0) for _ in ratios]
    for _ in range(rounds):
        below = [np.full(len(size), floor)]
        for ratio, bucket, weight in zip(ratios, buckets, weights):
            w = weight[bucket]
            below.append(w * ratio + (1 - w) * below[-1])
        reach = size.astype(float)
        fresh = []
        for k in reversed(range(len(ratios))):
            w = weights[k][buckets[k]]
            mine = reach * w * ratios[k] / below[k + 1]
            seen = np.bincount(buckets[k], weights=reach, minlength=BUCKETS)
            hits = np.bincount(buckets[k], weights=mine, minlength=BUCKETS)
            # Half a token for each side keeps every weight off 0 and 1.
            fresh.insert(0, np.where(np.arange(BUCKETS) > 0, (hits + 0.5) / (seen + 1), 0.0))
            reach = reach - mine
        weights = fresh
    return weights


def _score(order: int, total: int, distinct: int, documents: int, weights: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.to_pylist()):
                block = Block(row, order)
                counts = [_unpack(b, "<u8") for b in row["counts"]]
                single = counts[0][block.grams[0][1]].astype(np.float64)
                found = block.estimates(counts, total, documents, 0)
                p = mixture([r for r, _ in found], [_bucket(h) for _, h in found], 1 / (distinct + 1), weights)
                add = lambda x: np.bincount(block.owner, weights=x, minlength=len(block.sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("keys").slice(at, 1).flatten(),
                        pa.array(block.train),
                        pa.array(block.sizes),
                        pa.array(add(single > 0).astype(np.int64)),
                        pa.array(add(np.log10((single + 1) / (total + distinct + 1)))),
                        pa.array(add(np.log10(p))),
                    ],
                    ["key", "train", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def score_texts(
    documents: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER
) -> DataFrame:
    """Rows (key, train, n_tokens, n_known, train_tokens, base_score, score), one per document.

    Tokens are lower-cased words and one end per text; a null or empty text
    is its end alone. The model learns from rows for which `train` holds
    (null: not). base_score adds one to every token count. Repeated rows are
    documents of their own and count as often as they occur; a null key
    stays. Without training documents every token is as likely as any
    other. An empty table gives an empty result.
    """
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"order must be between 1 and {MOST_ORDER}")
    rows = documents.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    kind = rows.schema["key"].dataType.simpleString()
    schema = (
        "block long, n_tokens long, tokens binary, words binary, sizes binary, train binary, " f"keys array<{kind}>"
    )
    blocks = materialise(rows.mapInArrow(_read, schema), "lm-blocks")
    tokens = blocks.agg(F.sum("n_tokens").alias("n")).first().n or 0
    bits = max(0, int(np.ceil(np.log2(max(tokens, 1) / REDUCER_KEYS))))
    asked = blocks.drop("keys").mapInArrow(
        _ask(order, bits), "block long, level int, part long, grams binary, here binary"
    )
    answers = materialise(asked.groupBy("level", "part").applyInArrow(_answer, ANSWER), "lm-answers")
    sizes = answers.where("block = -1 and level = 0").agg(
        F.sum("n_distinct").alias("v"), F.sum("n_total").alias("n")
    ).first()
    total, distinct = sizes.n or 0, sizes.v or 0
    # Every training document has one end, and one start with the same history.
    flags = rows.where("train").agg(F.count("*").alias("n")).first().n
    met = blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(
        _meet(order, total, flags),
        f"{schema}, counts array<binary>, cells array<long>, sizes_of_cells array<double>, ratios array<double>",
    )
    met = materialise(met, "lm-counted")
    cells = met.select(
        F.explode(F.arrays_zip("cells", "sizes_of_cells", F.transform(
            "cells", lambda _, i: F.slice("ratios", i * order + 1, F.lit(order))).alias("r"))).alias("c")
    ).groupBy(F.col("c.cells").alias("cell")).agg(
        F.sum("c.sizes_of_cells").alias("size"), *[F.sum(F.col("c.r")[k]).alias(f"r{k}") for k in range(order)]
    )
    # Cells number (BUCKETS * LEVELS) ** order at most, whatever the corpus holds.
    learned = cells.orderBy("cell").toArrow()
    size, name = (learned.column(c).to_numpy() for c in ("size", "cell"))
    ratios = [learned.column(f"r{k}").to_numpy() / size for k in range(order)]
    buckets = [name // (BUCKETS * LEVELS) ** (order - 1 - k) // LEVELS % BUCKETS for k in range(order)]
    weights = learn_weights(size, ratios, buckets, 1 / (distinct + 1))
    scored = met.select("block", "tokens", "words", "sizes", "train", "keys", "counts").mapInArrow(
        _score(order, total, distinct, flags, weights),
        f"key {kind}, train boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.select(
        F.col("key").alias(key), "train", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


@query("op8_lm_deleted_interpolation")
def op8_lm_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_texts(documents, fold_of("doc_id", 7) != 2)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
