"""Multi-positive contrastive loss over mini-batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinium import fixed
from affinium.functions import vectors as vec
from affinium.operators.arrow import key_runs, matrix, ragged
from affinium.operators.ordering import shuffle_key


def batch_weights(batched: DataFrame, categories: str = "genres", jaccard: bool = False) -> DataFrame:
    """Sparse rows of every batch's positive-weight matrix.

    One row per anchor: its positive partners in the batch with weight 1
    (any shared category) or the Jaccard ratio. A batch holds `batch_size`
    rows by construction, so packing it into one array is bounded, and no
    pair leaves the row of its anchor.
    """
    member = F.struct("row_id", F.array_distinct(categories).alias("set"))
    packed = batched.groupBy("batch_id").agg(F.sort_array(F.collect_list(member)).alias("members"))
    anchors = packed.select("batch_id", "members", F.explode("members").alias("anchor"))
    own = F.col("anchor.set")

    def weight(other):
        if jaccard:
            return vec.overlap_ratio(own, other["set"])
        return F.when(F.arrays_overlap(own, other["set"]), F.lit(1.0)).otherwise(F.lit(0.0))

    others = F.filter("members", lambda m: m["row_id"] != F.col("anchor.row_id"))
    pairs = F.transform(others, lambda m: F.struct(m["row_id"].alias("row_id"), weight(m).alias("weight")))
    positives = F.filter(pairs, lambda p: p["weight"] > 0)
    return anchors.select("batch_id", F.col("anchor.row_id").alias("row_id"), positives.alias("positives"))


def pair_weights(rows: np.ndarray, values: np.ndarray, n: int, jaccard: bool) -> np.ndarray:
    """Dense weight matrix of one batch from its (row, category) entries."""
    if len(values) == 0:
        return np.zeros((n, n))
    _, at = np.unique(values, return_inverse=True)
    hot = np.zeros((n, at.max() + 1))
    hot[rows, at] = 1.0
    shared = hot @ hot.T
    if jaccard:
        sizes = hot.sum(axis=1)
        weights = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1.0)
    else:
        weights = (shared > 0).astype(float)
    np.fill_diagonal(weights, 0.0)
    return weights


def info_nce(z: np.ndarray, weights: np.ndarray, temperature: float) -> tuple[float, int, np.ndarray]:
    """Loss of one batch, its valid anchors and the gradient with respect to z.

    Row-wise softmax over the other items, computed after subtracting the
    row maximum. Anchors without a positive contribute nothing.
    """
    mass = weights.sum(axis=1)
    valid = mass > 0
    n_valid = int(valid.sum())
    if n_valid == 0:
        return 0.0, 0, np.zeros_like(z)
    logits = z @ z.T / temperature
    np.fill_diagonal(logits, -np.inf)
    logits -= logits.max(axis=1, keepdims=True)
    log_prob = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    target = weights / np.where(valid, mass, 1.0)[:, None]
    pull = np.multiply(target, log_prob, out=np.zeros_like(target), where=target > 0)
    loss = -pull.sum(axis=1)[valid].mean()
    residual = np.where(valid[:, None], np.exp(log_prob) - target, 0.0) / n_valid
    return float(loss), n_valid, (residual + residual.T) @ z / temperature


def by_batch(batched: DataFrame) -> DataFrame:
    """Whole batches per task, each a contiguous run."""
    return batched.repartition("batch_id").sortWithinPartitions("batch_id", "row_id")


def batch_losses(
    batched: DataFrame,
    temperature: float = fixed.TEMPERATURE,
    categories: str = "genres",
    jaccard: bool = False,
) -> DataFrame:
    """Loss per batch from unit embeddings: `(batch_id, n_items, n_valid, loss)`."""

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, "batch_id"):
            rows, values = ragged(run["categories"])
            weights = pair_weights(rows, values, run.num_rows, jaccard)
            loss, n_valid, _ = info_nce(matrix(run["embedding"]), weights, temperature)
            yield pa.RecordBatch.from_pydict(
                {"batch_id": run["batch_id"].to_numpy()[:1], "n_items": [run.num_rows],
                 "n_valid": [n_valid], "loss": [loss]}
            )

    narrow = batched.select("batch_id", "row_id", F.col(categories).alias("categories"), "embedding")
    return by_batch(narrow).mapInArrow(losses, "batch_id long, n_items long, n_valid long, loss double")


def epoch_loss(losses: DataFrame) -> DataFrame:
    """Mean loss weighted by batch size; 0 without batches."""
    weighted = F.sum(F.col("loss") * F.col("n_items")) / F.sum("n_items")
    return losses.agg(F.coalesce(weighted, F.lit(0.0)).alias("loss"), F.count("*").alias("n_batches"))


def keep_flags(df: DataFrame, probability: float, seed: int, epoch: int) -> DataFrame:
    """Add `keep`: one 0/1 flag per metadata input, drawn by hash per row.

    The draw depends on seed, epoch, row and input alone, so a retried task
    drops the same inputs.
    """

    def draw(name: str):
        digest = shuffle_key(f"{seed}:{epoch}:{name}")
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32

    flags = [F.when(draw(name) >= probability, 1.0).otherwise(0.0) for name in fixed.MODALITIES]
    return df.withColumn("keep", F.array(*flags))
