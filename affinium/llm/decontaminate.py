"""Benchmark decontamination with a generalised suffix automaton.

The items' words are numbered and put into one automaton, item by item.
Documents stream through it; the longest suffix of the words read so far
that occurs in some item has a known length, so a window of the items ends
wherever that length reaches the window's. Items come in blocks of bounded
size: one automaton per block is built and broadcast, and every document
meets each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinium.llm.common import NOT_ALNUM, flat_words, small_slices
from affinium.llm.registry import query, table
from affinium.session import materialise

WINDOW_WORDS = 10
# Characters of item text in one automaton (a single longer item stays whole); about 100 bytes in a task each.
BLOCK_CHARS = 1 << 19
# Automata that one pass of the documents meets, and text bytes handled at once.
BLOCKS_AT_ONCE = 4
SLICE_BYTES = 1 << 20
# Share of a document's words that may be hit before it is dropped rather than cut.
MOST_COVERED = 0.5


class Automaton:
    """Suffix automaton over several word sequences, with the items of every window.

    `items` holds (item, words); shorter items than `window` count whole.
    """

    def __init__(self, items: list[tuple[object, list[str]]], window: int):
        self.window = window
        self.numbers: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items = [item for item, _ in items]
        coded = [[self.numbers.setdefault(w, len(self.numbers)) for w in words] for _, words in items]
        for words in coded:
            last = 0
            for word in words:
                last = self._extend(last, word)
        # Items of each window, by its state and size.
        self.windows: dict[tuple[int, int], set[int]] = {}
        for number, words in enumerate(coded):
            size = min(window, len(words))
            state = 0
            for at, word in enumerate(words, 1):
                # The state of the last `size` words: one more word, then up to where that length lies.
                state = self.next[state][word]
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                if at >= size:
                    self.windows.setdefault((state, size), set()).add(number)
        # Per state the windows that end wherever it does, the longest first: its own and those of its suffixes. A
        # state without windows of its own shares the tuple of its link, and there are at most `window` sizes.
        own: dict[int, list[tuple[int, int]]] = {}
        for state, size in self.windows:
            own.setdefault(state, []).append((size, state))
        self.ends: list[tuple] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = self.ends[self.link[state]]
            self.ends[state] = (*sorted(own[state], reverse=True), *above) if state in own else above
        pairs = {(a, b) for words in coded for a, b in zip(words, words[1:])}
        count = len(self.numbers)
        self.words = pa.array(list(self.numbers), pa.large_string())
        self.pairs = np.unique(np.array([a * count + b for a, b in pairs], np.int64))
        self.least = min((min(window, len(words)) for words in coded if words), default=0)

    def _extend(self, last: int, word: int) -> int:
        """Add one word to the sequence that ends in `last`; the new last state."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state = self._new(self.length[last] + 1, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last < 0:
            self.link[state] = 0
        else:
            known = self.next[last][word]
            same = self.length[known] == self.length[last] + 1
            self.link[state] = known if same else self._split(last, word, known)
        return state

    def _new(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(-1)
        return len(self.next) - 1

    def _split(self, last: int, word: int, known: int) -> int:
        copy = self._new(self.length[last] + 1, dict(self.next[known]))
        self.link[copy], self.link[known] = self.link[known], copy
        while last >= 0 and self.next[last].get(word) == known:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Stretches [start, stop) of words inside occurring windows, and the items these belong to."""
        state = matched = 0
        spans: list[tuple[int, int]] = []
        met: set[tuple[int, int]] = set()
        for at, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            else:
                matched = 0
            reach = 0
            for size, owner in self.ends[state]:
                if size <= matched:
                    reach = reach or size
                    met.add((owner, size))
            if reach:
                if spans and spans[-1][1] >= at - reach:
                    spans[-1] = (min(spans[-1][0], at - reach), at)
                else:
                    spans.append((at - reach, at))
        return spans, set().union(*(self.windows[m] for m in met))


def _item_blocks(benchmark: DataFrame, item: str, text: str) -> list[list]:
    """Items in blocks of about BLOCK_CHARS characters, brought over block by block."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null").distinct()
    parts = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(1024)))
    # Hash parts are cheap to total; parts are then joined to blocks, large ones cut by running length.
    totals = parts.groupBy("part").agg(F.sum(F.length("text") + 1).alias("chars"))
    ahead = F.coalesce(
        F.sum("chars").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    starts = totals.select("part", ahead.alias("ahead"))
    inside = Window.partitionBy("part").orderBy("item", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        parts.join(starts, "part")
        .withColumn("at", F.col("ahead") + F.coalesce(F.sum(F.length("text") + 1).over(inside), F.lit(0)))
        .select("item", "text", F.floor(F.col("at") / BLOCK_CHARS).alias("block"))
    )
    numbers = sorted(r.block for r in placed.select("block").distinct().collect())
    if len(numbers) < 2:
        return [placed.select("item", "text").collect()]
    return ([r for r in placed.where(F.col("block") == n).select("item", "text").collect()] for n in numbers)


def _runs(machine: Automaton, numbers: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Runs of known words whose neighbours are neighbours in some item: only these can hold a window."""
    pair = numbers[:-1] * len(machine.words) + numbers[1:]
    ok = (numbers[:-1] >= 0) & (numbers[1:] >= 0) & (owner[:-1] == owner[1:])
    if len(machine.pairs):
        at = np.minimum(np.searchsorted(machine.pairs, pair), len(machine.pairs) - 1)
        ok &= machine.pairs[at] == pair
    else:
        ok[:] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
    runs = [(a, b + 1) for a, b in zip(edges[::2], edges[1::2]) if b + 1 - a >= machine.least]
    if machine.least == 1:
        inside = np.zeros(len(numbers) + 1, bool)
        for a, b in runs:
            inside[a:b] = True
        runs += [(i, i + 1) for i in np.flatnonzero((numbers >= 0) & ~inside[: len(numbers)])]
        runs.sort()
    return runs


def _meet(shared: list, most_covered: float | None = None):
    """Match documents against broadcast automata; adds to what earlier ones found.

    With most_covered, hit stretches are cut from the texts then, and
    documents covered further are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for batch in small_slices(batches, "text", SLICE_BYTES):
            words, counts = flat_words(batch.column("text"), NOT_ALNUM)
            stops = np.cumsum(counts)
            owner = np.repeat(np.arange(len(counts)), counts)
            new_spans: dict[int, list[dict]] = {}
            new_items: dict[int, set[str]] = {}
            for machine in (s.value for s in shared):
                numbers = pc.fill_null(pc.index_in(words, value_set=machine.words), -1).to_numpy(zero_copy_only=False)
                numbers = numbers.astype(np.int64)
                for a, b in _runs(machine, numbers, owner):
                    stretch, found = machine.scan(numbers[a:b].tolist())
                    if found:
                        row = int(owner[a])
                        shift = int(a - (stops[row] - counts[row]))
                        new_spans.setdefault(row, []).extend({"start": s + shift, "stop": e + shift} for s, e in stretch)
                        new_items.setdefault(row, set()).update(machine.items[i] for i in found)
            del words
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for row, found in new_spans.items():
                spans[row] = _merged([*spans[row], *found])
                items[row] = sorted({*items[row], *new_items[row]})
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["spans"] = pa.array(spans, batch.schema.field("spans").type)
            columns["items"] = pa.array(items, batch.schema.field("items").type)
            columns["n_words"] = pa.array(counts, pa.int64())
            if most_covered is not None:
                hit = [sum(s["stop"] - s["start"] for s in found) for found in spans]
                columns["text"] = _cut(columns["text"], spans)
                stay = pa.array([h <= most_covered * n for h, n in zip(hit, counts)], pa.bool_())
                columns = {name: column.filter(stay) for name, column in columns.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            del batch, columns
            pool.release_unused()

    return run


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _cut(texts: pa.Array, spans: list[list[dict]]) -> pa.Array:
    """Texts without their hit stretches; texts without hits are not touched."""
    hit = [row for row, found in enumerate(spans) if found]
    if not hit:
        return texts
    left = []
    for row in hit:
        text = texts[row].as_py()
        places = [m.span() for m in WORD.finditer(text)]
        pieces, at = [], 0
        for s in spans[row]:
            pieces.append(text[at : places[s["start"]][0]])
            at = places[s["stop"] - 1][1]
        left.append("".join([*pieces, text[at:]]))
    mask = np.zeros(len(spans), bool)
    mask[hit] = True
    return pc.replace_with_mask(texts, pa.array(mask), pa.array(left, texts.type))


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["stop"]:
            out[-1] = {"start": out[-1]["start"], "stop": max(out[-1]["stop"], s["stop"])}
        else:
            out.append(s)
    return out


def _matched(
    documents: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, window: int,
    most_covered: float | None,
) -> DataFrame:
    """Rows (key, text, n_words, spans, items) after all automata; cut where most_covered is given."""
    spark = documents.sparkSession
    named = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item_id"), F.col(item_text).alias("item_text")
    )
    rows = documents.select(
        F.col(key).alias("key"),
        F.col(text).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,stop:long>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    waiting: list = []
    for block in _item_blocks(named, "item_id", "item_text"):
        if len(waiting) == BLOCKS_AT_ONCE:
            rows = materialise(rows.mapInArrow(_meet(waiting), rows.schema), "decontaminate")
            waiting = []
        words, counts = flat_words(pa.array([r.text for r in block], pa.string()), NOT_ALNUM)
        listed, stops = words.to_pylist(), np.cumsum(counts)
        items = [(r.item, listed[stop - count : stop]) for r, count, stop in zip(block, counts, stops)]
        waiting.append(spark.sparkContext.broadcast(Automaton([(i, w) for i, w in items if w], window)))
    return rows.mapInArrow(_meet(waiting, most_covered), rows.schema)


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
) -> DataFrame:
    """Rows (key, n_words, spans, items), one per document.

    spans are word stretches [start, stop) inside occurring windows, merged;
    items the ids, as text, of the items with such windows. Null and empty
    texts have no words; items without words, and null items' texts, match
    nothing. Repeated documents are judged alike, repeated items count once,
    a null item id is `null`. Without items nothing is hit; an empty table
    gives an empty result. Other columns are ignored. Work grows with the
    words of a text, repeated words included.
    """
    found = _matched(documents, benchmark, key, text, item, item_text, window, None)
    return found.withColumnRenamed("key", key).drop("text")


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    most_covered: float = MOST_COVERED,
) -> DataFrame:
    """Documents without the benchmark's windows, with their own columns, whatever their names.

    Hit stretches are cut out; a document of whose words more than
    most_covered are hit is dropped. Documents without hits, null and empty
    texts included, stay as they are, repeated rows too; keys are not read.
    An empty table gives an empty result, without items all stay.
    """
    others = F.struct(F.lit(0).alias("_none"), *[F.col(f"`{c}`") for c in documents.columns if c != text])
    packed = documents.select(others.alias("_row"), F.col(f"`{text}`").alias("_text"))
    found = _matched(packed, benchmark, "_row", "_text", item, item_text, window, most_covered)
    return found.select(
        *[(F.col("text") if c == text else F.col("key").getField(c)).alias(c) for c in documents.columns]
    )


@query("op3_benchmark_decontamination")
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_leaks(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")
    )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
