"""CSV with line breaks inside quotes, read by many tasks.

Spark cuts a text file into blocks of lines. A line starts inside quotes when
an odd number of quotes stands before it in its file, so the parity of each
block's quotes, summed over earlier blocks, tells every block how it begins.
Lines that continue a record are then joined to the line that starts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinium.session import materialise

OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}
BLOCK = ["_file", "_block"]


def _odd_quotes(line: Column) -> Column:
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2


def _tagged_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return materialise(
        lines.select(
            "value", _odd_quotes(F.col("value")).alias("_odd"),
            F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_seq"),
        ),
        "lines",
    )


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """Add `_starts` (the line begins a record) and `_n` (records begun in its block so far)."""
    earlier_blocks = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block.
    inside = lines.groupBy(*BLOCK).agg(F.sum("_odd").alias("_odds")).select(
        *BLOCK, F.coalesce(F.sum("_odds").over(earlier_blocks), F.lit(0)).alias("_odds_before")
    )
    # A block is as large as a task of the scan, so it is sorted in one.
    so_far = Window.partitionBy(*BLOCK).orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    quotes_before = F.col("_odds_before") + F.sum("_odd").over(so_far) - F.col("_odd")
    blank = F.rtrim(F.col("value")).isin("", "\r")
    return (
        lines.join(inside, BLOCK)
        .withColumn("_outside", quotes_before % 2 == 0)
        .filter(~(F.col("_outside") & blank))
        .withColumn("_starts", F.col("_outside").cast("int"))
        .withColumn("_n", F.sum("_starts").over(so_far))
    )


def _block_table(lines: DataFrame) -> DataFrame:
    """One row per block: ids before it, headers until then, and the record that its first lines may continue."""
    begun = lines.groupBy(*BLOCK).agg(F.sum("_starts").alias("_begun"))
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("_begun") > 0, F.struct(F.col("_block"), F.col("_begun").alias("_n")))
    table = begun.select(
        *BLOCK, F.coalesce(F.sum("_begun").over(overall), F.lit(0)).alias("_before"),
        (F.coalesce(F.sum("_begun").over(in_file), F.lit(0)) == 0).alias("_heads"),
        F.last(own, ignorenulls=True).over(in_file).alias("_open"),
    )
    return table.withColumn("_file_at", F.dense_rank().over(Window.orderBy("_file")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file or folder as text columns, with dense `row_id` in file order.

    Every file has a header; names are those of the first. Quotes must enclose
    whole fields and be doubled inside them: a single one inside an unquoted
    field, which a sequential reader takes for a letter, would shift what
    follows. Blank lines outside quotes are no records. Short rows have nulls.
    """
    names = spark.read.csv(path, header=True, **OPTIONS).columns
    lines = materialise(_numbered_lines(_tagged_lines(spark, path)), "numbered")
    blocks = _block_table(lines).select(*BLOCK, "_before", "_heads", "_open", "_file_at")
    continued = F.col("_n") == 0
    placed = lines.join(blocks, BLOCK).select(
        "value", "_seq", "_file", "_block", "_starts", "_odd",
        F.when(continued, F.col("_open._block")).otherwise(F.col("_block")).alias("_own"),
        F.when(continued, F.col("_open._n")).otherwise(F.col("_n")).alias("_n"),
    )
    whole = (F.col("_starts") == 1) & (F.col("_odd") == 0)
    line = F.struct("_block", "_seq", "value")
    joined = placed.filter(~whole).groupBy("_file", "_own", "_n").agg(
        F.array_join(F.sort_array(F.collect_list(line))["value"], "\n").alias("value")
    )
    records = placed.filter(whole).select("_file", "_own", "_n", "value").unionByName(joined)
    owners = blocks.withColumnRenamed("_block", "_own").drop("_open")
    numbered = records.join(owners, ["_file", "_own"]).filter(~(F.col("_heads") & (F.col("_n") == 1)))
    schema = ", ".join(f"c{at} string" for at in range(len(names)))
    parsed = numbered.select(
        (F.col("_before") + F.col("_n") - 1 - F.col("_file_at")).cast("long").alias("row_id"),
        F.from_csv(F.regexp_replace("value", "\r$", ""), schema, OPTIONS).alias("_fields"),
    )
    return parsed.select(
        "row_id", *[F.col(f"_fields.c{at}").alias(name) for at, name in enumerate(names) if name != "row_id"]
    )
