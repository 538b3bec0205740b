"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Rows are written once, numbered, in blocks of at most 65,536, bucketed by
block. A block sorts the short fingerprints of its texts and sends to each
owner, who answers for one range of fingerprints, the ones of that range as
Golomb-coded gaps. The owner merges the lists of all blocks and sends back
one bit a fingerprint: whether another block has it too. Only the texts of
such suspects leave their block: they are grouped by their bytes, copies
being added up before the shuffle, which tells true copies from equal
fingerprints. All other rows are settled where they lie.

The bitmaps meet the rows by block, and since the rows are bucketed by it,
no text moves for that. A text that a third of all rows share is sent once a
block, its results come back once a block, and rows find them by (block,
text); no group grows beyond the rows of a block or the number of blocks.
A block sends no empty message, so there are never more messages than texts.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium.llm.registry import query, table
from affinium.session import fresh_path, materialise

# Rows of a block, as a power of two.
BLOCK_BITS = 16
# Fingerprints an owner merges, on average, and the fewest that are worth another one.
OWNER_PRINTS = 1 << 20
FEWEST_PRINTS = 1 << 12
# Bits of a fingerprint beyond the logarithm of the rows: a text is suspected wrongly once in 2 ** 16.
SPARE_BITS = 16

MESSAGE = "block long, owner int, n int, k int, unary binary, rest binary, copies array<int>, places array<int>"


def golomb_parameter(n: int, bits: int) -> int:
    """Power of two nearest below 0.69 times the mean gap of n numbers below 2 ** bits."""
    return max(0, math.floor(bits - math.log2(n) + math.log2(math.log(2)))) if n else 0


def golomb_encode(numbers: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Rising distinct numbers below 2 ** 63 as gaps: quotients by 2 ** k in unary, and remainders of k bits."""
    gaps = np.diff(numbers.astype(np.int64), prepend=-1) - 1
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = (gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1
    return np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_decode(unary: bytes, rest: bytes, n: int, k: int) -> np.ndarray:
    """The numbers again."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * k].reshape(n, k).astype(np.int64)
    remainders = bits @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum((quotients << k) + remainders + 1) - 1


def shape_of(rows: int, parallel: int) -> tuple[int, int]:
    """Bits of a fingerprint and of an owner's number for so many rows."""
    size = max(1, rows).bit_length()
    owners = max(size - OWNER_PRINTS.bit_length(), min(parallel.bit_length(), size - FEWEST_PRINTS.bit_length()), 0)
    return min(63, size + SPARE_BITS), owners


def _messages(bits: int, owner_bits: int):
    """One block's rows to its messages; `places` stay with the block, in the order of the fingerprints."""

    def run(block: pa.Table) -> pa.Table:
        digests = block.column("digest").combine_chunks().cast(pa.binary(32))
        words = np.frombuffer(digests.buffers()[1], ">u8", len(digests) * 4, digests.offset * 32).reshape(-1, 4)
        prints = (words[:, 0].astype(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(prints, kind="stable")
        prints, places = prints[order], block.column("place").to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
        ends = np.r_[starts[1:], len(prints)]
        prints, copies = prints[starts], (ends - starts).astype(np.int32)
        low = bits - owner_bits
        owners = prints >> low
        cuts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        out = []
        for start, stop in zip(cuts, np.r_[cuts[1:], len(prints)]):
            n = int(stop - start)
            k = golomb_parameter(n, low)
            unary, rest = golomb_encode(prints[start:stop] & ((1 << low) - 1), k)
            out.append((int(owners[start]), n, k, unary, rest, copies[start:stop], places[starts[start] : ends[stop - 1]]))
        owner, n, k, unary, rest, counts, spots = zip(*out)
        number = block.column("block")[0].as_py()
        ints = pa.list_(pa.int32())
        return pa.table(
            [
                pa.array([number] * len(out), pa.int64()), pa.array(owner, pa.int32()), pa.array(n, pa.int32()),
                pa.array(k, pa.int32()), pa.array(unary, pa.binary()), pa.array(rest, pa.binary()),
                pa.array(counts, ints), pa.array(spots, ints),
            ],
            names=["block", "owner", "n", "k", "unary", "rest", "copies", "places"],
        )

    return run


def _answers(messages: pa.Table) -> pa.Table:
    """One owner: a bit for each fingerprint of each list, set where another list has it too."""
    lists = [
        golomb_decode(m["unary"].as_py(), m["rest"].as_py(), m["n"].as_py(), m["k"].as_py())
        for m in ({c: messages.column(c)[i] for c in ("unary", "rest", "n", "k")} for i in range(messages.num_rows))
    ]
    whole = np.concatenate(lists)
    order = np.argsort(whole, kind="stable")
    same = np.flatnonzero(whole[order][1:] == whole[order][:-1])
    met = np.zeros(len(whole), bool)
    met[order[same]] = met[order[same + 1]] = True
    cuts = np.cumsum([len(found) for found in lists])[:-1]
    bitmaps = [np.packbits(part).tobytes() if part.any() else b"" for part in np.split(met, cuts)]
    return pa.table(
        [messages.column("block"), messages.column("owner"), pa.array(bitmaps, pa.binary())],
        names=["block", "owner", "bitmap"],
    )


def _suspects(messages: pa.Table, answers: pa.Table) -> pa.Table:
    """One block: the places of its suspects as bits of 64-bit words; no row where there are none."""
    bitmaps = dict(zip(answers.column("owner").to_pylist(), answers.column("bitmap").to_pylist()))
    bits = np.zeros(1 << BLOCK_BITS, np.uint8)
    for i, owner in enumerate(messages.column("owner").to_pylist()):
        copies = messages.column("copies")[i].values.to_numpy()
        places = messages.column("places")[i].values.to_numpy()
        found = copies > 1
        if bitmaps[owner]:
            found |= np.unpackbits(np.frombuffer(bitmaps[owner], np.uint8))[: len(copies)].astype(bool)
        bits[places[np.repeat(found, copies)]] = 1
    some = bits.any()
    words = np.packbits(bits, bitorder="little").view("<i8")
    return pa.table(
        [
            pa.array(messages.column("block").to_pylist()[:1] if some else [], pa.int64()),
            pa.array([words] if some else [], pa.list_(pa.int64())),
        ],
        names=["block", "words"],
    )


def _bucketed(df: DataFrame, column: str, buckets: int) -> str:
    """Write a frame to the shared folder, bucketed by a column; gives the name of its table."""
    name = f"affinium_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets, column)
    writer.option("path", fresh_path(df.sparkSession, "exact-rows")).saveAsTable(name)
    return name


def _classes(rows: DataFrame, key: str, text: str, carry: bool) -> DataFrame:
    """Rows (id, digest, keep_id, size, kept), with all columns of the input as `whole` where asked."""
    spark = rows.sparkSession
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = [F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("whole")] if carry else []
    named = rows.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *whole)
    named = named.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("row", F.monotonically_increasing_id())
    named = named.withColumn("block", F.shiftright("row", BLOCK_BITS)).withColumn(
        "place", F.col("row").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
    )
    name = _bucketed(named, "block", parallel)
    written = spark.table(name)
    bits, owner_bits = shape_of(written.count(), parallel)
    sent = written.select("block", "place", "digest").groupBy("block").applyInArrow(_messages(bits, owner_bits), MESSAGE)
    sent = materialise(sent, "exact-messages")
    answers = sent.select("block", "owner", "n", "k", "unary", "rest").groupBy("owner").applyInArrow(
        _answers, "block long, owner int, bitmap binary"
    )
    words = sent.select("block", "owner", "copies", "places").groupBy("block").cogroup(answers.groupBy("block"))
    words = materialise(words.applyInArrow(_suspects, "block long, words array<long>"), "exact-suspects")
    word = F.element_at("words", F.shiftright("place", 6) + 1)
    suspect = F.coalesce(F.getbit(word, F.col("place").bitwiseAND(63)) == 1, F.lit(False))
    flagged = written.join(words.hint("shuffle_hash"), "block", "left").withColumn("suspect", suspect)
    flagged = flagged.withColumn("text", F.when(F.col("suspect"), F.col("text")))
    flagged = materialise(flagged.drop("words", "place"), "exact-flagged")
    spark.sql(f"drop table {name}")

    twins = flagged.where("suspect")
    texts = twins.groupBy("digest", "text").agg(F.count("*").alias("size"))
    texts = texts.groupBy("digest").agg(F.sum("size").alias("size"), F.count("*").alias("texts"))
    clash = F.raise_error(F.lit("two texts share one SHA-256"))
    texts = texts.select("digest", F.when(F.col("texts") > 1, clash).otherwise(F.col("size")).cast("long").alias("size"))
    heads = twins.groupBy("block", "digest").agg(F.max(F.struct("id", "row")).alias("head"))
    heads = materialise(heads, "exact-heads")
    best = heads.groupBy("digest").agg(F.max("head").alias("head"))
    known = heads.select("block", "digest").join(best.join(texts, "digest"), "digest")
    kept = [F.col("whole")] if carry else []
    settled = flagged.where("not suspect").select(
        "id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), *kept
    )
    met = twins.drop("text").join(known, ["block", "digest"]).select(
        "id", "digest", F.col("head.id").alias("keep_id"), "size", (F.col("row") == F.col("head.row")).alias("kept"), *kept
    )
    return settled.union(met)


def mark_duplicates(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, keep_id, group_size, kept, text_sha256), one per row of the input.

    Texts are equal when their bytes are; a null text counts as an empty one,
    and texts of any length are read whole. Of equal texts the row with the
    largest key stays; where that key repeats, one of its rows. A null key is
    smaller than any other, so keep_id is null only where all rows of a text
    have no key. An empty table gives an empty result; other columns are
    ignored.
    """
    return _classes(rows, key, text, False).select(
        F.col("id").alias(key), "keep_id", F.col("size").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that `mark_duplicates` keeps, with all their columns; only suspects move between tasks."""
    return _classes(rows, key, text, True).where("kept").select("whole.*")


@query(
    "op13_exact_dedup",
    """with d as (select doc_id, coalesce(text, '') t from documents),
    g as (select t, max(doc_id) keep_id, count(*) group_size from d group by t)
    select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(t) text_sha256 from d join g using (t)""",
)
def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return mark_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
