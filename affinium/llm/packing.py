"""Best-fit packing of tokenised documents by linear grouping.

Documents are cut into pieces of at most `capacity` tokens. Lengths are
small integers, so the plan is made from the number of pieces of each
length, at most `capacity` numbers, whatever the corpus holds:

1. Large lengths, in falling order, are cut into groups of equal
   cardinality and rounded up to the largest of their group.
2. Configurations, multisets of group sizes that fit one sequence, are
   chosen by a linear program over the few sizes, solved by column
   generation: a knapsack proposes the next configuration from the prices.
3. The whole part of the solution is filled with the actual pieces.
4. What is left, and all small pieces, goes largest first to the fullest
   sequence it fits in.

The plan is a table of runs: pieces of one length whose ranks lie in a range
go to consecutive sequences at one offset. Pieces are ranked within their
length by totals per block of documents, so no length, however common, is
collected in one task.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinium.llm.common import small_slices
from affinium.llm.registry import query, table
from affinium.session import materialise

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.tiktoken"
GROUPS = 100
# Lengths of at most this share of the capacity count as small.
SMALL_SHARE = 1 / 16


def added_tokens(path: str) -> dict[str, int]:
    """Tokens that the JSON file beside a file of ranks adds to the vocabulary; none without such a file."""
    beside = Path(path).with_suffix(".json")
    if not beside.exists():
        return {}
    found = json.loads(beside.read_text())["added_tokens"]
    odd = [t["content"] for t in found if any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if odd:
        raise ValueError(f"{beside}: only added tokens that stand for their exact text are known, not {odd}")
    return {t["content"]: t["id"] for t in found}


def open_tokenizer(path: str):
    """Byte-level BPE from a file of ranks: the ids of the JSON file of the same vocabulary.

    Texts are split at the tokens which that file adds, as a plain call of it
    does. Where a text has a run too long for the pattern's matcher, as a
    million spaces are, the JSON file is used itself.
    """
    import public_tokenizers
    import tiktoken
    import tokenizers

    with open(path) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    added = added_tokens(path)
    encoding = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added
    )
    fast = partial(encoding.encode, allowed_special=set(added), disallowed_special=())
    plain: list = []

    def encode(text: str) -> list[int]:
        try:
            return fast(text)
        except ValueError:
            if not plain:
                plain.append(tokenizers.Tokenizer.from_file(str(Path(path).with_suffix(".json"))))
            return plain[0].encode(text, add_special_tokens=False).ids

    return encode


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


_OPEN: dict[str, object] = {}


def _cut(path: str | None, capacity: int, keep_ids: bool):
    """Pieces of documents, numbered within block and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = path or default_vocabulary()
        encode = _OPEN.get(name) or _OPEN.setdefault(name, open_tokenizer(name))
        for batch in small_slices(batches, "text"):
            rows, pieces, starts, lengths, sums, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                # Only the first piece may be shorter.
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (start, stop) in enumerate(zip(cuts[:-1], cuts[1:])):
                    part = ids[start:stop]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(stop - start)
                    sums.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            size = np.array(lengths, np.int64)
            order = np.argsort(size, kind="stable")
            place = np.empty(len(size), np.int64)
            place[order] = np.arange(len(size)) - np.searchsorted(size[order], size[order])
            columns = {
                "key": batch.column("key").take(pa.array(rows, pa.int64())),
                "piece": pa.array(pieces, pa.int32()),
                "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()),
                "block": pa.array([uuid.uuid4().int >> 65] * len(rows), pa.int64()),
                "place": pa.array(place),
            }
            if keep_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _fill(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the capacity."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    ordered = sizes[order]
    for room in range(int(ordered[0]), capacity + 1):
        fits = np.searchsorted(ordered, room, side="right")
        gains = best[room - ordered[:fits]] + prices[order[:fits]]
        at = int(gains.argmax())
        if gains[at] > best[room - 1] + 1e-12:
            best[room], take[room] = gains[at], order[at]
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if take[room] >= 0:
            counts[take[room]] += 1
            room -= int(sizes[take[room]])
        else:
            room -= 1
    return float(best[capacity]), counts


def configurations(sizes: np.ndarray, demands: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many sequences take each: the linear optimum, rounded down."""
    n = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    amounts = demands / np.diag(columns)
    inverse = np.linalg.inv(columns)
    for turn in range(50 * n):
        prices = inverse.sum(axis=0)
        value, counts = _fill(prices, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ counts
        up = direction > 1e-9
        ratios = np.full(n, np.inf)
        ratios[up] = amounts[up] / direction[up]
        leave = int(ratios.argmin())
        amounts = np.maximum(amounts - ratios[leave] * direction, 0)
        amounts[leave] = ratios[leave]
        columns[:, leave] = counts
        # Product form of the inverse; a fresh one now and then keeps it exact.
        pivot = inverse[leave] / direction[leave]
        inverse = inverse - np.outer(direction, pivot)
        inverse[leave] = pivot
        if turn % 50 == 49:
            inverse = np.linalg.inv(columns)
    return [(columns[:, i].astype(np.int64), int(amounts[i] + 1e-6)) for i in range(n) if amounts[i] >= 1 - 1e-6]


class Plan:
    """Runs (length, low, high, sequence, offset, per): ranks low..high-1 of a length.

    The piece of rank r goes to `sequence + (r - low) // per`, at
    `offset + (r - low) % per * length`.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self._open: dict[int, list[tuple[int, int]]] = {}
        self._rooms: list[int] = []
        small = int(capacity * SMALL_SHARE)
        large = [[size, 0, n] for size, n in sorted(counts.items(), reverse=True) if size > small and n]
        rest = [(size, 0, n) for size, n in counts.items() if size <= small and n]
        total = sum(n for _, _, n in large)
        if total:
            rest += self._pack_large(large, total, groups)
        for size, low, high in sorted(rest, reverse=True):
            self._best_fit(size, low, high)

    def _pack_large(self, large: list[list[int]], total: int, groups: int) -> list[tuple[int, int, int]]:
        grouped: list[list[tuple[int, int, int]]] = []
        share, runs = -(-total // groups), iter(large)
        run, wanted = next(runs), share
        grouped.append([])
        while run:
            size, low, high = run
            take = min(wanted, high - low)
            grouped[-1].append((size, low, low + take))
            wanted -= take
            run = [size, low + take, high] if low + take < high else next(runs, None)
            if not wanted and run:
                grouped.append([])
                wanted = share
        # Groups of one rounded size are one size.
        merged: dict[int, list[tuple[int, int, int]]] = {}
        for group in grouped:
            merged.setdefault(group[0][0], []).extend(group)
        sizes = np.array(list(merged), np.int64)
        demands = np.array([sum(h - lo for _, lo, h in g) for g in merged.values()], np.float64)
        queues = [list(reversed(g)) for g in merged.values()]
        for counts, times in configurations(sizes, demands, self.capacity):
            slots = [int(i) for i in np.repeat(np.arange(len(sizes)), counts)]
            done = 0
            # A slot takes the next pieces of its group; where their length changes, a new stretch begins.
            taken = [self._take(queues[i], times) for i in slots]
            while done < times:
                live = [t for t in taken if t]
                if not live:
                    break
                width = min(t[-1][2] - t[-1][1] for t in live)
                first, used = self.sequences, 0
                for t in live:
                    size, low, high = t.pop()
                    self.runs.append((size, low, low + width, first, used, 1))
                    used += size
                    if low + width < high:
                        t.append((size, low + width, high))
                self.sequences += width
                self._free(self.capacity - used, first, width)
                done += width
        return [run for queue in queues for run in queue]

    @staticmethod
    def _take(queue: list[tuple[int, int, int]], wanted: int) -> list[tuple[int, int, int]]:
        """Up to `wanted` pieces from the end of a queue, next ones last."""
        out = []
        while wanted and queue:
            size, low, high = queue.pop()
            take = min(wanted, high - low)
            out.append((size, low, low + take))
            wanted -= take
            if low + take < high:
                queue.append((size, low + take, high))
        return out[::-1]

    def _free(self, room: int, first: int, count: int) -> None:
        if room and count:
            if not self._open.get(room):
                insort(self._rooms, room)
                self._open[room] = []
            self._open[room].append((first, count))

    def _best_fit(self, size: int, low: int, high: int) -> None:
        while low < high:
            at = bisect_left(self._rooms, size)
            if at == len(self._rooms):
                per = self.capacity // size
                first, count, room = self.sequences, -(-(high - low) // per), self.capacity
                self.sequences += count
            else:
                room = self._rooms[at]
                first, count = self._open[room].pop()
                if not self._open[room]:
                    self._rooms.pop(at)
                per = room // size
            offset, full = self.capacity - room, min(count, (high - low) // per)
            if full:
                self.runs.append((size, low, low + full * per, first, offset, per))
                self._free(room - per * size, first, full)
                low, first, count = low + full * per, first + full, count - full
            if count and low < high:
                left = min(per, high - low)
                self.runs.append((size, low, low + left, first, offset, left))
                self._free(room - left * size, first, 1)
                low, first, count = low + left, first + 1, count - 1
            self._free(room, first, count)

    def arrays(self) -> np.ndarray:
        """Runs sorted by length and low rank."""
        return np.array(sorted(self.runs), np.int64).reshape(-1, 6)


# Ranks are below 2**40 in one length, so length and rank make one sortable number.
RANK_BITS = 40


def _place(runs: np.ndarray):
    keys = (runs[:, 0] << RANK_BITS) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            found = runs[np.searchsorted(keys, (length << RANK_BITS) + rank, side="right") - 1]
            past = rank - found[:, 1]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names],
                    pa.array(found[:, 3] + past // found[:, 5]),
                    pa.array(found[:, 4] + past % found[:, 5] * length),
                ],
                [*names, "sequence_id", "offset"],
            )

    return run


def pack(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    groups: int = GROUPS,
    keep_ids: bool = False,
) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one per piece.

    A null or empty text is its end id alone. Repeated rows, and rows with a
    null key, are documents of their own; ties in length are broken by where
    pieces were read, which changes no sequence count. An empty table gives
    an empty result; other columns are ignored.
    """
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = (
        f"key {kind}, piece int, start long, length long, ids_crc32 long, block long, place long"
        + ", ids array<int>" * keep_ids
    )
    pieces = materialise(rows.mapInArrow(_cut(vocabulary, capacity, keep_ids), schema), "packing-pieces")
    totals = materialise(pieces.groupBy("block", "length").agg(F.count("*").alias("n")), "packing-totals")
    ahead = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("block", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    counts = {r.length: r.n for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = Plan(counts, capacity, groups).arrays()
    names = ["key", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    ranked = pieces.join(starts, ["block", "length"]).select(*names, (F.col("ahead") + F.col("place")).alias("rank"))
    out = ranked.drop("rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    return ranked.mapInArrow(_place(runs), out.schema).withColumnRenamed("key", key)


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (sequence_id, keys, ids): the token sequences of a packing made with keep_ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", F.col(key).alias("key"), "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.col("parts.key").alias("keys"), F.flatten("parts.ids").alias("ids")
    )


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents").select("doc_id", "text"))
