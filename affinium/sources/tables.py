"""Catalog views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium.sources.catalog import normalise


# Declared schemas save a footer-reading job per table.
SCHEMAS = {
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
        " l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,"
        " o_orderpriority string"
    ),
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def catalog_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as catalog rows in the ratings-dump layout."""
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    sales = lines.groupBy("l_partkey").agg(
        F.count("*").alias("votes"),
        F.avg("l_quantity").alias("rating"),
        F.min("l_shipdate").alias("first_day"),
        F.array_sort(F.collect_set("s_name")).alias("people"),
        F.min_by("s_name", F.struct("l_orderkey", "l_linenumber")).alias("writer"),
    )
    return (
        table(spark, folder, "part")
        .join(sales, F.col("p_partkey") == F.col("l_partkey"), "left")
        .join(table(spark, folder, "documents"), F.col("p_partkey") == F.col("doc_id"), "left")
        .select(
            F.col("p_partkey").alias("row_id"),
            F.concat_ws(" ", "p_name", "p_brand").alias("Title"),
            F.date_format("first_day", "MMM d, yyyy").alias("Release Date"),
            F.concat(F.col("p_type"), F.lit(", "), F.replace("p_name", F.lit(" "), F.lit(", "))).alias("Genres"),
            F.col("text").alias("Description"),
            F.col("p_brand").alias("Directed by"),
            F.col("writer").alias("Written by"),
            F.col("rating").alias("Rating"),
            F.concat(F.col("p_size").cast("string"), F.lit(" min")).alias("Duration"),
            F.col("votes").alias("No of Persons Voted"),
            F.array_join("people", ",").alias("Cast"),
        )
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return normalise(catalog_raw(spark, folder))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Item embeddings: `(row_id, embedding)`."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")


def labelled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings with their label as the only category."""
    label = F.col("label").cast("string")
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.array(label).alias("genres"), "embedding"
    )


def indexed_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Clean catalog rows that have an embedding."""
    return catalog(spark, folder).join(vectors(spark, folder), "row_id")


def text_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("description"),
        F.array("lang").alias("genres"),
        F.col("source").alias("director"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")
