"""Sharding by a lookup table that the shards fill in turns.

Every shard has its own order of preference over the slots of a table of
prime size: an offset and a stride. In turns, each claims its first free
slot, so all shards own the same number of slots, give or take one, and
adding or removing a shard moves few slots besides its own. A row's key
hashes to a slot; the table, whose size is a parameter, is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium.llm.registry import query, table

TABLE_SIZE = 65_537
# The largest table that may be broadcast, in slots: about 16 MB.
TABLE_LIMIT = 1 << 20
SHARDS = [f"shard-{i:03d}" for i in range(128)]


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the owning shard for every slot.

    Shards take turns in the order of their names. Raises unless size is a
    prime of at most TABLE_LIMIT, the names differ and there are at least
    one and at most size of them.
    """
    if not _is_prime(size) or size > TABLE_LIMIT:
        raise ValueError(f"table size must be a prime of at most {TABLE_LIMIT}, not {size}")
    if not 0 < len(shards) <= size or len(set(shards)) != len(shards):
        raise ValueError("give between one and `size` different shards")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    places = {i: _number(f"offset:{shards[i]}") % size for i in turns}
    strides = {i: _number(f"stride:{shards[i]}") % (size - 1) + 1 for i in turns}
    owners, free = [-1] * size, size
    while free:
        for i in turns[:free]:
            while owners[places[i]] >= 0:
                places[i] = (places[i] + strides[i]) % size
            owners[places[i]] = i
            free -= 1
    return owners


def assign_shards(
    rows: DataFrame, key: str, shards: list[str] | None = None, size: int = TABLE_SIZE, prefix: str = ""
) -> DataFrame:
    """Rows with their slot and shard; no shuffle.

    Equal keys share a shard. A row whose key is null is placed by its other
    columns, so that many such rows do not meet in one shard. An empty table
    gives an empty result. Columns named slot or shard are replaced; a
    prefix avoids that.
    """
    shards = SHARDS if shards is None else shards
    owners = fill_table(shards, size)
    slot, shard = f"{prefix}slot", f"{prefix}shard"
    spark = rows.sparkSession
    lookup = spark.createDataFrame([(i, shards[o]) for i, o in enumerate(owners)], f"`{slot}` int, `{shard}` string")
    others = [F.col(f"`{c}`") for c in rows.columns if c not in (key, slot, shard)] or [F.lit(0)]
    text = F.coalesce(F.col(key).cast("string"), F.xxhash64(*others).cast("string"))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    placed = rows.drop(slot, shard).withColumn(slot, (number % size).cast("int"))
    return placed.join(F.broadcast(lookup), slot)


def write_shards(rows: DataFrame, key: str, path: str, **options) -> None:
    """Write one folder per shard, rows where they are read: no shuffle, a file per task and shard."""
    assign_shards(rows, key, **options).write.partitionBy("shard").parquet(path)


@query("op2_shard_lookup")
def op2_shard_lookup(spark: SparkSession, folder: str) -> DataFrame:
    placed = assign_shards(table(spark, folder, "documents"), "doc_id")
    return placed.select("doc_id", "slot", "shard")
