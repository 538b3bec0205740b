"""Chat formatting: collapse of cumulative snapshots, then rendering.

Logs often hold a conversation again and again while it grows. The rolling
hash of a conversation's first k turns is the sum of hashes of (place,
turn), so it rolls on by one addition per turn and can be summed in blocks:
a conversation that holds a third of all turns is spread over as many tasks
as it has blocks. A conversation whose whole hash is a prefix hash of a
longer one is dropped by an anti-join, identical ones keep the smallest id.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinium.llm.registry import query, table
from affinium.session import materialise

# Turns whose order is settled in one task, and turns rendered into one text.
BLOCK_TURNS = 1024
NO_ROLE = "unknown"


def _hash_parts(text: Column) -> list[Column]:
    """Two 60-bit numbers of one sha256, as decimals that can be summed without overflow."""
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16)]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, n_turns, a, b, role, text): a and b hash the turns up to pos.

    Turns are ordered by turn (null first), then by a hash of their content.
    Equal rows count once. A null role is `unknown`, a null text empty.
    Rows without conv_id form one conversation. Other columns are ignored.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(NO_ROLE)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("content", F.sha2(F.concat("role", F.lit("\x1f"), "text"), 256))
    rows = rows.groupBy("conv_id", "turn", "content").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    rows = rows.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-(2**62))) / BLOCK_TURNS))
    in_block = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "content")
    rows = rows.withColumn("place", F.row_number().over(in_block))
    # One row per block: how many turns come before it, and how many there are in all.
    conversation = Window.partitionBy("conv_id")
    before = conversation.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        rows.groupBy("conv_id", "block").agg(F.count("*").alias("size"))
        .withColumn("ahead", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("n_turns", F.sum("size").over(conversation))
    )
    rows = _with_block(rows, sizes.drop("size")).withColumn("pos", F.col("ahead") + F.col("place"))
    first, second = _hash_parts(F.concat(F.col("pos").cast("string"), F.lit(":"), "content"))
    rows = rows.withColumns({"a": first, "b": second})
    sums = rows.groupBy("conv_id", "block").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = sums.select("conv_id", "block", *[_sum(F.sum(c).over(before)).alias(f"{c}_ahead") for c in "ab"])
    rolling = in_block.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.sum(c).over(rolling) for c in "ab"})
    rows = _with_block(rows, sums)
    return rows.select(
        "conv_id", "pos", "n_turns", *[_sum(F.col(c) + F.col(f"{c}_ahead")).alias(c) for c in "ab"], "role", "text"
    )


def _sum(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("decimal(38,0)")


def _with_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
        *[c for c in blocks.columns if c not in ("conv_id", "block")],
    )
    same = rows["conv_id"].eqNullSafe(blocks["_conv"]) & (rows["block"] == blocks["_block"])
    return rows.join(blocks, same).drop("_conv", "_block")


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, copies) of conversations that are no proper prefix of another.

    Of identical conversations the smallest id stays (a missing id counts as
    the smallest); copies says how many there were.
    """
    whole = (
        hashed.where("pos = n_turns").groupBy("n_turns", "a", "b")
        .agg(
            F.when(F.count("conv_id") == F.count("*"), F.min("conv_id")).alias("conv_id"), F.count("*").alias("copies")
        )
    )
    prefixes = hashed.where("pos < n_turns").select(F.col("pos").alias("n_turns"), "a", "b").distinct()
    return whole.join(prefixes, ["n_turns", "a", "b"], "left_anti").select("conv_id", "n_turns", "copies")


def render(hashed: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, copies, part, text): the turns in order, at most BLOCK_TURNS in one part."""
    kept = kept.select(F.col("conv_id").alias("_conv"), "copies")
    turns = hashed.join(kept, hashed["conv_id"].eqNullSafe(kept["_conv"]))
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    parts = turns.groupBy(
        "conv_id", "n_turns", "copies", F.floor((F.col("pos") - 1) / BLOCK_TURNS).cast("int").alias("part")
    ).agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return parts.select(
        "conv_id", "n_turns", "copies", "part", F.array_join(F.col("lines.line"), "").alias("text")
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """Rendered maximal conversations; an empty table gives an empty result."""
    # Three branches read the hashes, so they are written once.
    hashed = materialise(prefix_hashes(turns), "chat-hashes")
    return render(hashed, maximal_conversations(hashed))


SQL = f"""
with t as (
  select distinct conv_id, turn, coalesce(role, '{NO_ROLE}') as role, coalesce(text, '') as text from conversations),
h as (select *, sha256(role || chr(31) || text) as content from t),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, content) as pos,
             count(*) over (partition by conv_id) as n_turns from h),
r as (select *, string_agg(content, ',') over (partition by conv_id order by pos) as prefix from p),
w as (select min(conv_id) as conv_id, count(*) as copies, prefix from r where pos = n_turns group by prefix),
k as (select conv_id, copies from w
      where prefix not in (select prefix from r where pos < n_turns))
select conv_id, n_turns, copies, cast((pos - 1) // {BLOCK_TURNS} as integer) as part,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by pos) as text
from p join k using (conv_id) group by all
"""


@query("op6_chat_snapshots", SQL)
def op6_chat_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return format_chats(table(spark, folder, "conversations"))
