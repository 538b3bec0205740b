"""The training-data pipeline: five stages over documents, each on what the one before kept.

STAGES lists (name, function); a function takes (spark, docs, folder of the
tables) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, and
extra columns, whatever their names, go along. Null and empty texts have no
terms, words, windows or secrets: no stage drops them, and packing gives each
its end token. Rows without an id are documents like others, but take no part
in near-duplicate links. Repeated rows are judged alike; of near-duplicates
one row with the smallest id stays. Long texts
are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium.llm import decontaminate, minhash, packing, secrets, toxicity
from affinium.session import materialise, ship_package

MOST_TOXIC = 0.5


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of texts that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose toxicity score is below MOST_TOXIC; the lexicon is learned from the labels table."""
    ship_package(spark)
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, lexicon, prefix="_toxicity_")
    return scored.where(F.col("_toxicity_score") < MOST_TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8."""
    ship_package(spark)
    return minhash.drop_near_duplicates(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the benchmark's windows of ten words; mostly covered ones go."""
    ship_package(spark)
    return _measured(decontaminate.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet")))


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with secrets replaced by a mark."""
    return _measured(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

# Neither the learned lexicon nor tokens and packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages, one after the other, over the documents table."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
