"""Projection of embeddings to three dimensions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinium.functions import text as tx
from affinium.operators.ordering import sample_rows


@dataclass
class Projection:
    """Rows with `pc` (array of components) and the variance each one explains."""

    rows: DataFrame
    explained: list[float]


def principal_components(df: DataFrame, vector: str = "embedding", k: int = 3) -> Projection:
    """Centred PCA; the covariance is aggregated on the cluster.

    Signs are fixed so that the largest loading of each component is positive.
    Spark's PCA does not centre when it transforms, so centring comes first.
    """
    shaped = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    centre = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(shaped)
    centred = centre.transform(shaped)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    flips = F.array(*[F.lit(float(sign or 1.0)) for sign in signs])
    pc = F.zip_with(vector_to_array("_p"), flips, lambda value, sign: value * sign)
    rows = model.transform(centred).withColumn("pc", pc).drop("_v", "_c", "_p")
    return Projection(rows, [float(x) for x in model.explainedVariance.toArray()])


def embedding_map(index: DataFrame, n: int = 300, seed: int = 0) -> DataFrame:
    """Plot table of a sampled index: label, primary category, three components."""
    projection = principal_components(sample_rows(index, n, seed))
    return projection.rows.select(
        "row_id",
        tx.display_label(F.col("title"), F.col("year")).alias("label"),
        tx.primary_category(F.col("genres")).alias("category"),
        *[F.get("pc", F.lit(at)).alias(f"pc{at + 1}") for at in range(3)],
        F.lit(sum(projection.explained)).alias("explained"),
    )


def result_map(query_vector: list[float], result: DataFrame, vector: str = "text") -> DataFrame:
    """Plot table of one query and its top-k result, with marker attributes."""
    spark = result.sparkSession
    query = spark.createDataFrame([(-1, "<INPUT>", 1.0, [float(x) for x in query_vector])],
                                  "row_id long, label string, score double, vector array<double>")
    found = result.select("row_id", F.col("title").alias("label"), "score",
                          F.col(vector).cast("array<double>").alias("vector"))
    points = query.unionByName(found)
    n = min(3, points.count())
    rows = principal_components(points, "vector", n).rows
    is_query = F.col("row_id") == -1
    score = F.col("score")
    return rows.select(
        "row_id", "label", "score",
        *[F.get("pc", F.lit(at)).alias(f"pc{at + 1}") for at in range(n)],
        F.when(is_query, 12.0).otherwise(tx.marker_size(score)).alias("marker_size"),
        F.when(is_query, 1.0).otherwise(tx.marker_alpha(score)).alias("marker_alpha"),
        F.when(~is_query, tx.line_alpha(score)).alias("line_alpha"),
    )
