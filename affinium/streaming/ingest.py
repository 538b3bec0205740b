"""Incremental ingest of landed film-API responses."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from affinium.operators.collecting import known_titles, new_records
from affinium.session import is_missing, scope
from affinium.sources.landed import film_records

LANDED_SCHEMA = "seq long, requested string, body string"


def read_landed(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of landed responses: JSON lines `(seq, requested, body)`."""
    return (
        spark.readStream.schema(LANDED_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def collected(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return None


def ingest(
    landed: DataFrame, target: str, checkpoint: str, ignore: DataFrame | None = None
) -> StreamingQuery:
    """Append records with unknown titles to `target`, then stop when caught up.

    The collected table itself is the state: every micro-batch is compared with
    the titles already written. A batch replayed after a failure finds its own
    records there and adds nothing, and no dedupe state grows in memory.
    Each batch of each stream has its own folder, which a replay overwrites.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"stream={stream}/batch={batch_id}"
        done = collected(spark, target)
        tables = [ignore] if ignore is not None else []
        if done is not None:
            # A replay must not see what its first attempt wrote.
            earlier = done.filter((F.col("stream") != stream) | (F.col("batch") != batch_id))
            tables += [earlier.select("requested"), earlier.select("Title")]
        if not tables:
            tables = [spark.createDataFrame([], "known string")]
        with scope(spark):
            fresh = new_records(film_records(batch), known_titles(*tables))
            fresh.write.mode("overwrite").parquet(f"{target}/{own}")

    return (
        landed.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
