"""Near-duplicates by MinHash and a multi-index Hamming join.

A document is the set of its distinct word shingles. Its signature keeps
16 bits of each of 32 minimum hashes, in 8 chunks of 4 symbols. Two
signatures that differ in at most 15 symbols have, by the pigeonhole
principle, a chunk with at most one differing symbol. So each document is
filed under its chunks with each symbol left out in turn, 32 keys in all,
and every pair within that distance meets under one of them. At a
similarity of 0.8 a pair misses all eight chunks with probability 1.1e-6.

Documents with equal sets are one class from the start. Under each key the
classes are first compared with one leader only, the class that meets most
others; what links join is contracted to components. Then, under the keys
where several components still meet, every class outside the leader's
component is a candidate with all members of other components. So every pair
that shares a key is either compared or already connected.

The comparison with the leader also bounds those candidates. Two classes
share at most the smaller of their overlaps with the leader, and of what
they have beside it at most what falls into the same of 512 bits. Pairs
whose bound misses the threshold, as heavily edited copies of one text do,
never leave the join. Neither do pairs whose signatures differ in more than
20 symbols (a linked pair does with probability 1e-7). The others are
confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium.llm.common import SPACES, components, flat_words, small_slices
from affinium.llm.registry import query, table
from affinium.operators.skew import join_totals
from affinium.session import materialise

SHINGLE_WORDS = 5
PERCENT = 80
CHUNKS, SYMBOLS, BITS = 8, 4, 16
MOST_DIFFERENT = 20
# Longs of bits that mark what a class has beside its leader.
REST = 8
# Members of one key that a task pairs with as many others.
BLOCK_MEMBERS = 4096
# Shingles hashed at once inside a task.
STEP = 1 << 15

_RANDOM = np.random.default_rng(42)
FACTORS = _RANDOM.integers(0, 2**64, CHUNKS * SYMBOLS, dtype=np.uint64) | np.uint64(1)
SALTS = _RANDOM.integers(0, 2**64, CHUNKS * SYMBOLS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a shorter text is one shingle, an empty one none."""
    words, counts = flat_words(texts, SPACES)
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    hashes = known[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)

    def join(parts: list[np.ndarray]) -> np.ndarray:
        return _mix(reduce(lambda a, b: a * factor + b, parts, np.full(len(parts[0]), len(parts), np.uint64)))

    room = max(0, len(hashes) - size + 1)
    whole = join([hashes[i : i + room] for i in range(size)]) if room else hashes
    stops = np.cumsum(counts)
    sets = []
    for count, stop in zip(counts, stops):
        start = stop - count
        if count >= size:
            sets.append(np.unique(whole[start : stop - size + 1]))
        elif count:
            sets.append(join([hashes[i : i + 1] for i in range(start, stop)]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def class_of(shingles: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(shingles: np.ndarray) -> np.ndarray:
    """CHUNKS longs, each of SYMBOLS symbols of BITS bits."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), STEP):
        np.minimum(least, ((shingles[at : at + STEP, None] ^ SALTS) * FACTORS).min(axis=0), out=least)
    symbols = _mix(least) >> np.uint64(64 - BITS)
    shifts = np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(symbols.reshape(CHUNKS, SYMBOLS) << shifts, axis=1).view(np.int64)


CHUNK_NAMES = [f"c{i}" for i in range(CHUNKS)]


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), size)
            signed = np.array([signature(s) for s in sets]).reshape(len(sets), CHUNKS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("code"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                    *[pa.array(signed[:, i]) for i in range(CHUNKS)],
                ],
                ["id", "code", "n_shingles", "class", *CHUNK_NAMES],
            )

    return run


def _left_out() -> list[tuple[str, Column]]:
    """Every chunk with the mask of each symbol left out."""
    lanes = [((1 << BITS) - 1) << (BITS * i) for i in range(SYMBOLS)]
    masks = [(~lane) & (2**64 - 1) for lane in lanes]
    return [(c, F.lit(m - 2**64 if m >= 2**63 else m).cast("long")) for c in CHUNK_NAMES for m in masks]


def _keys() -> Column:
    return F.array(*[F.xxhash64(F.lit(i), F.col(c).bitwiseAND(mask)) for i, (c, mask) in enumerate(_left_out())])


def _first_shared(left: str, right: str) -> Column:
    """Place of the first key that two signatures share."""
    out = F.lit(None).cast("int")
    for i, (c, mask) in reversed(list(enumerate(_left_out()))):
        same = F.col(left + c).bitwiseXOR(F.col(right + c)).bitwiseAND(mask) == 0
        out = F.when(same, i).otherwise(out)
    return out


def _distance(left: str, right: str) -> Column:
    """Number of differing symbols."""
    terms = []
    for c in CHUNK_NAMES:
        differ = F.col(left + c).bitwiseXOR(F.col(right + c))
        for i in range(SYMBOLS):
            lane = F.shiftrightunsigned(differ, BITS * i).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
            terms.append((lane != 0).cast("int"))
    return reduce(lambda a, b: a + b, terms)


REST_NAMES = [f"r{i}" for i in range(REST)]


def _overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which members of sorted x are in sorted y."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _compare(size: int, percent: int, bounds: bool):
    """Confirmed links; with `bounds` every pair, with the overlap and the rest of b beside a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(small_slices(batches, "text_a"), "text_b"):
            sides = []
            for side in "ab":
                texts = batch.column(f"text_{side}").dictionary_encode()
                sets = shingle_sets(texts.dictionary, size)
                ids = [class_of(s) if len(s) else None for s in sets]
                sides.append((texts.indices.to_pylist(), sets, ids, batch.column(side).to_pylist()))
            (ia, sa, ca, a), (ib, sb, cb, b) = sides
            out, rests = [], []
            for x, y, p, q in zip(ia, ib, a, b):
                if ca[x] != p or cb[y] != q:
                    continue
                inside = _overlap(sb[y], sa[x])
                both = int(inside.sum())
                linked = 100 * both >= percent * (len(sa[x]) + len(sb[y]) - both)
                if bounds:
                    rest = sb[y][~inside] >> np.uint64(55)
                    marks = np.zeros(64 * REST, np.uint8)
                    marks[rest] = 1
                    rests.append(np.packbits(marks).view(np.int64))
                    out.append((p, q, linked, both, len(rest), len(sb[y]), len(rest) - int(marks.sum())))
                elif linked:
                    out.append((p, q))
            names = ["a", "b", "linked", "both", "rest", "n", "hidden"] if bounds else ["a", "b"]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
            arrays = [pa.array([o[i] for o in out], kinds[i]) for i in range(len(names))]
            if bounds:
                marked = np.array(rests, np.int64).reshape(len(rests), REST)
                arrays += [pa.array(marked[:, i]) for i in range(REST)]
            yield pa.RecordBatch.from_arrays(arrays, names + (REST_NAMES if bounds else []))

    return run


def _may_link(percent: int) -> Column:
    """Whether the bounds of strays (a_) and others (b_) under one leader leave room for a link."""
    shared = reduce(
        lambda x, y: x + y, [F.bit_count(F.col(f"a_{r}").bitwiseAND(F.col(f"b_{r}"))) for r in REST_NAMES]
    )
    # Members of the rest behind one bit beyond its first are counted as shared.
    beside = F.least(shared + F.least("a_hidden", "b_hidden"), F.col("a_rest"), F.col("b_rest"))
    most = F.least("a_both", "b_both") + beside
    return 100 * most >= percent * (F.col("a_n") + F.col("b_n") - most)


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """Rows (key, n_shingles, component_id, kept), one per document.

    component_id is the smallest key reachable by links, itself included;
    kept says that it is the document's own. A document without words, a
    null text or a null key links with nothing. Keys are whole numbers.
    Rows that repeat a key are documents of their own that share its name;
    rows with equal sets are compared as one. Ties cannot occur: links
    depend on sets alone. An empty table gives an empty result; other
    columns are ignored. The node of a class is 64 bits of its set's hash.
    """
    return _linked(_rows(documents, key, text), size, percent).select(
        F.col("id").alias(key), "n_shingles", "component_id", "kept"
    )


def _rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Ids and texts, and 64 bits that stand for a text."""
    return documents.select(
        F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("code")
    )


def _linked(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (id, code, n_shingles, component_id, kept, chosen) for rows (id, text, code).

    chosen holds for the one text of each component with the smallest key, and for rows that link with nothing.
    """
    schema = "id long, code long, n_shingles long, class long, " + ", ".join(f"{c} long" for c in CHUNK_NAMES)
    signed = materialise(rows.mapInArrow(_sign(size), schema), "minhash-signatures")
    classes = (
        signed.where("class is not null and id is not null").groupBy("class", *CHUNK_NAMES)
        .agg(F.min(F.struct("id", "code")).alias("least")).select("class", *CHUNK_NAMES, "least.id", "least.code")
    )
    classes = materialise(classes, "minhash-classes")
    filed = materialise(classes.select("class", F.posexplode(_keys()).alias("place", "key")), "minhash-keys")
    sizes = filed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = materialise(join_totals(filed, sizes, "key", "members", "class"), "minhash-shared")
    met = shared.groupBy("class").agg(F.sum("members").alias("met"))
    leaders = (
        shared.join(met, "class").groupBy("key")
        .agg(F.max(F.struct("met", "class"))["class"].alias("leader"), F.max("members").alias("members"))
    )
    led = join_totals(shared.select("key", "place", "class"), leaders, "key", "members", "class")
    shared = materialise(led.drop("members"), "minhash-led")
    first = shared.where("class <> leader").select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct()
    needed = shared.select("class").distinct().join(classes.select("class", "id", "code"), "class")
    # One text per class, however often its row is repeated.
    texts = rows.join(needed, ["id", "code"]).select("class", "text").dropDuplicates(["class"])
    texts = materialise(texts, "minhash-texts")
    compared = _with_texts(first, texts).mapInArrow(
        _compare(size, percent, True),
        "a long, b long, linked boolean, both long, rest long, n long, hidden long, "
        + ", ".join(f"{r} long" for r in REST_NAMES),
    )
    compared = materialise(compared, "minhash-star")
    labels = components(compared.where("linked").select("a", "b"), "minhash-star")
    # Keys under which several components meet, and the leader's component there.
    named = shared.join(labels.withColumnRenamed("id", "class"), "class", "left")
    named = named.select("key", "place", "class", "leader", F.coalesce("component", "class").alias("component"))
    named = materialise(named, "minhash-named")
    mixed = (
        named.groupBy("key")
        .agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            F.max(F.when(F.col("class") == F.col("leader"), F.col("component"))).alias("main"),
            F.count("*").alias("members"),
        )
        .where("low <> high")
        .select("key", "main", "members", F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int").alias("parts"))
    )
    # The leader has been compared with all members, so it is no candidate any more.
    bounds = compared.drop("linked").withColumnsRenamed({"a": "leader", "b": "class"})
    members = (
        join_totals(named.where("class <> leader"), mixed, "key", "members", "class").drop("members")
        .join(bounds, ["leader", "class"]).join(classes.drop("id", "code"), "class")
    )
    members = materialise(members, "minhash-members")
    values = ["class", "component", "both", "rest", "n", "hidden", *REST_NAMES, *CHUNK_NAMES]
    # Members of a large key are cut into blocks, which meet two by two.
    block = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    strays = members.where("component <> main").select(
        "key", "place", block.alias("left"), each.alias("right"), *[F.col(c).alias(f"a_{c}") for c in values]
    )
    others = members.select(
        "key", "main", block.alias("right"), each.alias("left"), *[F.col(c).alias(f"b_{c}") for c in values]
    )
    # A pair of two strays is taken once, any pair only under the first key that it shares.
    second = strays.join(others, ["key", "left", "right"]).where(
        (F.col("a_component") != F.col("b_component"))
        & ((F.col("b_component") == F.col("main")) | (F.col("a_class") < F.col("b_class")))
        & _may_link(percent)
        & (_distance("a_", "b_") <= MOST_DIFFERENT)
        & (_first_shared("a_", "b_") == F.col("place"))
    )
    second = second.select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct()
    more = _with_texts(second, texts).mapInArrow(_compare(size, percent, False), "a long, b long")
    more = materialise(more, "minhash-strays")
    name = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    eman = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    bridges = more.join(name, "a", "left").join(eman, "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")
    )
    joined = components(bridges, "minhash-bridges").select(
        F.col("id").alias("component"), F.col("component").alias("whole")
    )
    # A bridge may also end in a class without links to a leader, which is no component's member yet.
    final = (
        labels.withColumnRenamed("id", "class").join(joined, "component", "left")
        .select("class", F.coalesce("whole", "component").alias("node"))
        .union(joined.select("component", "whole")).distinct()
    )
    nodes = materialise(
        classes.select("class", "id", "code").join(final, "class", "left").select(
            "class", "id", "code", F.coalesce("node", "class").alias("node")
        ),
        "minhash-nodes",
    )
    least = nodes.groupBy("node").agg(
        F.min(F.struct("id", "code")).alias("least"), F.count("*").alias("members")
    )
    named = join_totals(nodes.select("node", "class"), least, "node", "members", "class").select(
        "class", F.col("least.id").alias("component_id"), F.col("least.code").alias("lead")
    )
    alone = F.col("id").isNull() | F.col("class").isNull()
    placed = signed.select(
        "id", "code", "n_shingles", F.when(F.col("id").isNotNull(), F.col("class")).alias("class")
    )
    result = placed.join(named, "class", "left").withColumn(
        "component_id", F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    )
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    chosen = alone | (kept & (F.col("code") == F.col("lead")))
    return result.select("id", "code", "n_shingles", "component_id", kept.alias("kept"), chosen.alias("chosen"))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes with a text of each."""
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("class").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.select("a", "b", "text_a", "text_b")


def drop_near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, percent: int = PERCENT
) -> DataFrame:
    """The documents that are kept, one row of each component, with their own columns.

    That is a row with the component's smallest key; of several texts under
    that key the one with the smallest hash, of rows that repeat key and
    text any one. Rows without words or without a key link with nothing and
    all stay. An empty table gives an empty result.
    """
    linked = _linked(_rows(documents, key, text), size, percent).where("chosen and id is not null")
    copies = materialise(
        linked.groupBy("id", "code", "n_shingles").agg(F.count("*").alias("copies")), "minhash-kept"
    )
    # Few rows repeat, if any: a table of their own is small enough to be looked up.
    repeated = materialise(copies.where("copies > 1 and n_shingles > 0").select("id", "code"), "minhash-repeated")
    single = copies.where("copies = 1 or n_shingles = 0").select("id", "code")
    keys = [documents[key].cast("long"), F.xxhash64(documents[text])]

    def of(kept: DataFrame) -> DataFrame:
        return documents.join(kept, (keys[0] == kept["id"]) & (keys[1] == kept["code"]), "left_semi")

    nameless = documents.where(documents[key].cast("long").isNull())
    return of(single).union(nameless).union(of(repeated).dropDuplicates([key, text]))


@query("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=4, percent=80)
