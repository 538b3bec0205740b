"""Catalog ingest: header resolution, row ids and the unified schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinium import fixed
from affinium.functions import text as tx
from affinium.operators.dedupe import first_per_key
from affinium.session import is_missing, materialise
from affinium.sources.split_csv import read_records

CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("year", T.DoubleType()),
        T.StructField("genres", T.ArrayType(T.StringType())),
        T.StructField("description", T.StringType()),
        T.StructField("director", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("writer", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("votes", T.DoubleType()),
        T.StructField("cast", T.ArrayType(T.StringType())),
    ]
)

# Short names of the four data sets, relative to a data folder.
DATASETS = {
    "small": "small.csv",
    "16k": "16k.csv",
    "top": "top.csv",
    "wiki": "wiki.csv",
}


def resolve_dataset(value: str, folder: str = "data", aliases: Mapping[str, str] | None = None) -> str:
    """Data set alias to path; anything else already is a path."""
    table = DATASETS if aliases is None else aliases
    return f"{folder.rstrip('/')}/{table[value]}" if value in table else value


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """Unified field to input column, by case-insensitive trimmed header.

    The first alias in priority order wins; of two headers with one normal
    form the last wins.
    """
    by_name = {name.lower().strip(): name for name in columns}
    found: dict[str, str] = {}
    for field, aliases in fixed.HEADER_ALIASES.items():
        match = next((by_name[alias] for alias in aliases if alias in by_name), None)
        if match is not None:
            found[field] = match
        elif field in fixed.REQUIRED_FIELDS:
            raise ValueError(f"no {' or '.join(aliases)} column among {columns}")
    return found


def read_table(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw catalog rows from CSV (all text), JSON lines or Parquet, by suffix.

    Descriptions may hold line breaks, so each CSV file is read by one task;
    `split_csv.read_records` reads a large one by many. A dump without line
    breaks inside quotes is read in blocks with multi_line off.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("json", "jsonl"):
        return spark.read.option("primitivesAsString", True).json(path)
    return spark.read.csv(
        path, header=True, multiLine=multi_line, quote='"', escape='"', inferSchema=False, encoding="UTF-8"
    )


def with_row_ids(raw: DataFrame) -> DataFrame:
    """Dense row ids in file order for a freshly read file source.

    Every (file, block) is read in order by one task, so a row's id is the
    number of rows in earlier blocks plus its position in its own block. The
    tagged rows are written once, and both counts and ids come from what was
    written: however the scan is planned, no row can get lost or share an id.
    """
    tagged = raw.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    stored = materialise(tagged, "tagged")
    block = ["_file", "_block"]
    earlier = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy(*block)
        .agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
        .select(*block, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    numbered = stored.join(offsets, block)
    row_id = (F.col("_before") + F.col("_seq") - F.col("_first")).alias("row_id")
    return numbered.select(row_id, *[F.col(f"`{name}`") for name in raw.columns])


def checked_row_ids(raw: DataFrame) -> DataFrame:
    """Rows that bring their own `row_id`; raises unless the ids are whole numbers and all differ."""
    number = F.expr("try_cast(row_id as bigint)")
    found = raw.agg(
        F.count("*").alias("n"), F.count(number).alias("numbers"), F.count_distinct(number).alias("different")
    ).first()
    if not found["n"] == found["numbers"] == found["different"]:
        raise ValueError(f"row_id must be a different whole number in every row: {found.asDict()}")
    return raw


def _number(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.NumericType):
        return tx.finite(F.col(f"`{name}`"))
    return tx.number_of(tx.na_to_null(F.col(f"`{name}`").cast("string")))


def project_unified(raw: DataFrame) -> DataFrame:
    """Input columns to the ten unified columns, one row in, one row out."""
    headers = resolve_headers([name for name in raw.columns if name != "row_id"])

    def source(field: str) -> Column | None:
        if field not in headers:
            return None
        return tx.na_to_null(F.col(f"`{headers[field]}`").cast("string"))

    def text(field: str) -> Column:
        value = source(field)
        return F.lit(fixed.MISSING) if value is None else tx.text_or_missing(value)

    def parsed(field: str, parse) -> Column:
        value = source(field)
        return F.lit(None).cast("double") if value is None else parse(value)

    def number(field: str) -> Column:
        if field not in headers:
            return F.lit(None).cast("double")
        return _number(raw, headers[field])

    def listed(field: str) -> Column:
        value = source(field)
        return F.array().cast("array<string>") if value is None else tx.split_list(value)

    return raw.select(
        F.col("row_id").cast("long").alias("row_id"),
        source("title").alias("title"),
        parsed("year", tx.year_of).alias("year"),
        listed("genres").alias("genres"),
        tx.strip(F.coalesce(source("description"), F.lit(""))).alias("description"),
        text("director").alias("director"),
        number("rating").alias("rating"),
        text("writer").alias("writer"),
        parsed("duration", tx.duration_of).alias("duration"),
        number("votes").alias("votes"),
        listed("cast").alias("cast"),
    )


def with_title(df: DataFrame) -> DataFrame:
    """Drop rows without a title, then strip: a blank title survives as ''."""
    return df.filter(F.col("title").isNotNull()).withColumn("title", tx.strip(F.col("title")))


def with_description(df: DataFrame) -> DataFrame:
    description = F.col("description")
    return df.filter((F.length(description) > 0) & (F.upper(description) != fixed.NOT_AVAILABLE))


def normalise(raw: DataFrame) -> DataFrame:
    """Raw rows with `row_id` to the clean catalog.

    The description filter runs before the de-duplication, so the first
    valid row of a (title, year) is the one kept.
    """
    valid = with_description(with_title(project_unified(raw)))
    return first_per_key(valid, ["title", "year"], ["row_id"])


def load_catalog(spark: SparkSession, path: str, multi_line: bool = True, split: bool = False) -> DataFrame:
    """Any supported catalog file or folder to the unified schema; `split` reads large CSV files by many tasks.

    A split file's own `row_id` column is left for the number of the row.
    """
    if split:
        return normalise(read_records(spark, path))
    raw = read_table(spark, path, multi_line)
    return normalise(checked_row_ids(raw) if "row_id" in raw.columns else with_row_ids(raw))


def with_any_description(raw: DataFrame, column: str = "Description") -> DataFrame:
    """Baseline rule: non-empty description, neither stripped nor de-duplicated."""
    text = F.coalesce(tx.na_to_null(F.col(f"`{column}`")), F.lit(""))
    return raw.withColumn(column, text).filter(F.length(text) > 0)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """Titles of a CSV as a frame; a missing file gives no rows."""
    empty = spark.createDataFrame([], "Title string")
    try:
        table = read_table(spark, path)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return empty  # a missing list means "nothing requested"
    return table.select("Title") if "Title" in table.columns else empty
