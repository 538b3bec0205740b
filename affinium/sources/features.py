"""Content-addressed store of text vectors."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium.functions import text as tx
from affinium.operators.textvec import TextEncoder
from affinium.session import is_missing


class FeatureStore:
    """Parquet table `(text_key, vector)` per model; a text is encoded once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, model: str) -> str:
        return f"{self.path}/model={model.replace('/', '_')}"

    def read(self, model: str) -> DataFrame:
        """Stored vectors of one model; an absent folder is an empty store."""
        folder = self._folder(model)
        schema = "text_key string, vector array<float>"
        try:
            return self.spark.read.schema(schema).parquet(folder).groupBy("text_key").agg(
                # Overlapping fills may have stored a text more than once.
                F.min("vector").alias("vector")
            )
        except AnalysisException as error:
            if not is_missing(error):
                raise
            return self.spark.createDataFrame([], schema)

    def misses(self, df: DataFrame, encoder: TextEncoder, text: str = "description") -> DataFrame:
        """Distinct texts without a stored vector: `(text_key, text)`."""
        keyed = df.select(tx.text_key(encoder.name, F.coalesce(text, F.lit(""))).alias("text_key"),
                          F.coalesce(text, F.lit("")).alias("text"))
        # Copies of one text collapse before they meet the store.
        texts = keyed.groupBy("text_key").agg(F.first("text").alias("text"))
        return texts.join(self.read(encoder.name).select("text_key"), "text_key", "left_anti")

    def fill(self, df: DataFrame, encoder: TextEncoder, text: str = "description") -> None:
        """Encode and append whatever is missing."""
        encoded = encoder.transform(self.misses(df, encoder, text), "text", "vector")
        encoded.select("text_key", "vector").write.mode("append").parquet(self._folder(encoder.name))

    def features(self, df: DataFrame, encoder: TextEncoder, text: str = "description",
                 target: str = "text") -> DataFrame:
        """Add the vector of each text, filling the store first.

        Copies of one text share one stored row; AQE splits such a key.
        """
        self.fill(df, encoder, text)
        stored = self.read(encoder.name).withColumnRenamed("vector", target)
        keyed = df.withColumn("text_key", tx.text_key(encoder.name, F.coalesce(text, F.lit(""))))
        return keyed.join(stored, "text_key").drop("text_key")
