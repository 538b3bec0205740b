"""Fusion of text and metadata into one unit vector, trained with the
contrastive loss by parallel workers. Here the linear fusion; `network` holds
the one with hidden layers.

The parameters are a table `(modality, idx, weights)`, one row per input
dimension and idx -1 for the bias. Vocabularies are capped, so the model has a
fixed size and may live on the driver; the data never does.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium import fixed
from affinium.operators.arrow import key_runs, matrix, one_array, ragged, vector_column
from affinium.operators.contrastive import by_batch, epoch_loss, info_nce, keep_flags, pair_weights
from affinium.operators.ordering import assign_batches
from affinium.session import materialise

LISTS = {"genres": "genre_idx", "cast": "cast_idx"}
IDS = {"director": "director_idx", "writer": "writer_idx"}
SCALARS = {"year": "year_n", "rating": "rating_n", "duration": "duration_n", "votes": "votes_n"}
INPUTS = ["text", *LISTS.values(), *IDS.values(), *SCALARS.values()]


@dataclass
class FusionModel:
    """Weights and bias per input; `text` plus the metadata inputs in use."""

    weights: dict[str, np.ndarray]
    bias: dict[str, np.ndarray]

    @classmethod
    def create(cls, text_dim: int, sizes: dict[str, int], embed_dim: int = fixed.EMBED_DIM,
               seed: int = fixed.SEED) -> FusionModel:
        """Seeded start; inputs with an empty vocabulary are left out."""
        rng = np.random.default_rng(seed)
        inputs = {"text": text_dim}
        inputs |= {name: sizes[name] for name in (*LISTS, *IDS) if sizes[name] > 0}
        inputs |= dict.fromkeys(SCALARS, 1)
        weights, bias = {}, {}
        for name, size in inputs.items():
            limit = 1.0 / np.sqrt(size)
            weights[name] = rng.uniform(-limit, limit, (size, embed_dim))
            bias[name] = rng.uniform(-limit, limit, embed_dim)
        return cls(weights, bias)

    @property
    def embed_dim(self) -> int:
        return self.bias["text"].shape[0]

    @property
    def metadata(self) -> list[str]:
        return [name for name in fixed.MODALITIES if name in self.weights]

    def copy(self) -> FusionModel:
        return type(self)({k: v.copy() for k, v in self.weights.items()},
                          {k: v.copy() for k, v in self.bias.items()})

    def zeros(self) -> FusionModel:
        return type(self)({k: np.zeros_like(v) for k, v in self.weights.items()},
                          {k: np.zeros_like(v) for k, v in self.bias.items()})

    def forward(self, inputs: dict, keep: np.ndarray | None, rng: np.random.Generator | None = None):
        """Unit vectors, and what the backward pass needs; a linear fusion has no units to drop."""
        z, lengths = fuse(self, inputs, keep)
        return z, (inputs, keep, z, lengths)

    def backward(self, tape: tuple, dz: np.ndarray, into: FusionModel) -> None:
        """Add the parameter gradient of one batch to `into`."""
        inputs, keep, z, lengths = tape
        fuse_gradient(self, inputs, keep, z, lengths, dz, into)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(name, -1, self.bias[name].tolist()) for name in self.bias]
        for name, block in self.weights.items():
            rows += [(name, at, row) for at, row in enumerate(block.tolist())]
        return spark.createDataFrame(rows, "modality string, idx int, weights array<double>")

    @classmethod
    def from_frame(cls, params: DataFrame) -> FusionModel:
        """Model-sized read: capped vocabularies times the embedding size."""
        from affinium.operators.network import FusionNetwork

        weights, bias = {}, {}
        table = params.orderBy("modality", "idx").toArrow()
        names, at = np.array(table["modality"].to_pylist()), table["idx"].to_numpy()
        for name in map(str, dict.fromkeys(names)):
            own = names == name
            rows = matrix(table["weights"].filter(pa.array(own)))
            if at[own][0] < 0:
                bias[name], rows = rows[0], rows[1:]
            weights[name] = rows
        return (FusionNetwork if "fuse" in weights else cls)(weights, bias)


def _input_columns(table: pa.Table | dict) -> dict[str, object]:
    """Arrow columns to NumPy: dense text, ragged lists, ids and scalars."""
    inputs: dict[str, object] = {"text": matrix(table["text"])}
    for name, column in LISTS.items():
        inputs[name] = ragged(table[column])
    for name, column in (IDS | SCALARS).items():
        inputs[name] = one_array(table[column]).to_numpy(zero_copy_only=False)
    return inputs


def _project(model: FusionModel, name: str, value, n: int) -> np.ndarray:
    block = model.weights[name]
    if name == "text":
        out = value @ block
    elif name in LISTS:
        rows, entries = value
        out = np.zeros((n, model.embed_dim))
        np.add.at(out, rows, block[entries])
    elif name in IDS:
        out = block[value]
    else:
        out = value[:, None] * block[0]
    return out + model.bias[name]


def fuse(model: FusionModel, inputs: dict, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and the lengths before normalising.

    `keep` has one 0/1 column per metadata input; a dropped input loses its
    bias too, because it is zeroed after its projection.
    """
    n = len(inputs["text"])
    total = _project(model, "text", inputs["text"], n)
    for at, name in enumerate(fixed.MODALITIES):
        if name not in model.weights:
            continue
        part = _project(model, name, inputs[name], n)
        total += part if keep is None else part * keep[:, at : at + 1]
    lengths = np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return total / lengths, lengths


def fuse_gradient(model: FusionModel, inputs: dict, keep: np.ndarray, z: np.ndarray,
                  lengths: np.ndarray, dz: np.ndarray, into: FusionModel) -> None:
    """Add the parameter gradient of one batch to `into`."""
    du = (dz - z * (z * dz).sum(axis=1, keepdims=True)) / lengths
    into.weights["text"] += inputs["text"].T @ du
    into.bias["text"] += du.sum(axis=0)
    for at, name in enumerate(fixed.MODALITIES):
        if name not in model.weights:
            continue
        part = du * keep[:, at : at + 1]
        into.bias[name] += part.sum(axis=0)
        if name in LISTS:
            rows, entries = inputs[name]
            np.add.at(into.weights[name], entries, part[rows])
        elif name in IDS:
            np.add.at(into.weights[name], inputs[name], part)
        else:
            into.weights[name][0] += inputs[name] @ part


def embed(encoded: DataFrame, model: FusionModel, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add `embedding`: the fused unit vector, without the inputs in `drop`."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    flags = [0.0 if name in drop else 1.0 for name in fixed.MODALITIES]

    @F.arrow_udf("array<float>")
    def vectors(*columns: pa.Array) -> pa.Array:
        inputs = _input_columns(dict(zip(INPUTS, columns, strict=True)))
        keep = np.tile(flags, (len(columns[0]), 1))
        z, _ = shared.value.forward(inputs, keep)
        return vector_column(z, pa.float32())

    return encoded.withColumn("embedding", vectors(*INPUTS))


def embed_text(texts: DataFrame, model: FusionModel) -> DataFrame:
    """Text-only embedding of rows that have nothing but a `text` vector."""
    empty = F.array().cast("array<int>")
    columns = {column: empty for column in LISTS.values()}
    columns |= {column: F.lit(0) for column in IDS.values()}
    columns |= {column: F.lit(0.0) for column in SCALARS.values()}
    fused = embed(texts.withColumns(columns), model, drop=tuple(fixed.MODALITIES))
    return fused.drop(*columns)


# --- training -------------------------------------------------------------


def batch_gradient(model: FusionModel, run: pa.Table, temperature: float, jaccard: bool,
                   rng: np.random.Generator | None, into: FusionModel) -> float:
    """Loss of one batch; its gradient is added to `into`."""
    inputs, keep = _input_columns(run), matrix(run["keep"])
    z, tape = model.forward(inputs, keep, rng)
    loss, _, dz = info_nce(z, pair_weights(*inputs["genres"], run.num_rows, jaccard), temperature)
    model.backward(tape, dz, into)
    return loss


def gradient_sums(batched: DataFrame, shared: Broadcast, temperature: float, jaccard: bool) -> DataFrame:
    """Summed gradients of all batches, one row per touched parameter row, and
    the loss totals in the row `('', 0)`.

    Every task adds up its own batches first; the sums of the tasks meet in an
    ordinary aggregation, so the result has the size of the model.
    """
    dim = max(block.shape[1] for block in shared.value.weights.values())
    schema = "modality string, idx int, loss double, items long, batches long, grad array<double>"

    def rows_of(name: str, block: np.ndarray, first: int) -> pa.RecordBatch:
        touched = np.flatnonzero(block.any(axis=1))
        n = len(touched)
        return pa.RecordBatch.from_pydict(
            {"modality": pa.array([name] * n, pa.string()), "idx": pa.array(touched + first, pa.int32()),
             "loss": pa.nulls(n, pa.float64()), "items": pa.nulls(n, pa.int64()),
             "batches": pa.nulls(n, pa.int64()), "grad": vector_column(block[touched], pa.float64())}
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = model.zeros()
        loss_sum, n_items, n_batches = 0.0, 0, 0
        for run in key_runs(batches, "batch_id"):
            loss = batch_gradient(model, run, temperature, jaccard, None, total)
            loss_sum, n_items, n_batches = loss_sum + loss * run.num_rows, n_items + run.num_rows, n_batches + 1
        if n_batches:
            yield pa.RecordBatch.from_pydict(
                {"modality": pa.array([""]), "idx": pa.array([0], pa.int32()), "loss": [loss_sum],
                 "items": [n_items], "batches": [n_batches], "grad": pa.array([None], pa.list_(pa.float64()))}
            )
            for name in model.weights:
                yield rows_of(name, total.weights[name], 0)
            for name in model.bias:
                yield rows_of(name, total.bias[name][None, :], -1)

    narrow = batched.select("batch_id", "row_id", "keep", *INPUTS)
    sums = [F.sum(F.get("grad", F.lit(at))) for at in range(dim)]
    return (
        by_batch(narrow)
        .mapInArrow(task, schema)
        .groupBy("modality", "idx")
        .agg(F.sum("loss").alias("loss"), F.sum("items").alias("items"),
             F.sum("batches").alias("batches"), F.array(*sums).alias("grad"))
    )


def mean_gradient(batched: DataFrame, model: FusionModel, temperature: float = fixed.TEMPERATURE,
                  jaccard: bool = False) -> tuple[FusionModel, float, int]:
    """Gradient averaged over the batches, with the summed loss and item count."""
    shared = batched.sparkSession.sparkContext.broadcast(model)
    table = gradient_sums(batched, shared, temperature, jaccard).toArrow()
    shared.unpersist()
    grad = model.zeros()
    loss, items, batches = 0.0, 0, 0
    names, at = table["modality"].to_pylist(), table["idx"].to_pylist()
    for row, name in enumerate(names):
        if name == "":
            loss, items, batches = (table[c][row].as_py() for c in ("loss", "items", "batches"))
    for row, name in enumerate(names):
        if name:
            value = np.array(table["grad"][row].as_py()[: model.weights[name].shape[1]], float) / batches
            if at[row] < 0:
                grad.bias[name] = value
            else:
                grad.weights[name][at[row]] = value
    return grad, loss, items


def fused_losses(batched: DataFrame, shared: Broadcast, temperature: float, jaccard: bool) -> DataFrame:
    """Loss of each batch under the model, without any gradient: `(n_items, loss)`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in key_runs(batches, "batch_id"):
            inputs = _input_columns(run)
            z, _ = shared.value.forward(inputs, None)
            weights = pair_weights(*inputs["genres"], run.num_rows, jaccard)
            loss, _, _ = info_nce(z, weights, temperature)
            yield pa.RecordBatch.from_pydict({"n_items": [run.num_rows], "loss": [loss]})

    narrow = batched.select("batch_id", "row_id", *INPUTS)
    return by_batch(narrow).mapInArrow(task, "n_items long, loss double")


class AdamW:
    """Decoupled weight decay on the model-sized parameters."""

    def __init__(self, model: FusionModel, lr: float, decay: float = fixed.WEIGHT_DECAY):
        self.lr, self.decay, self.step = lr, decay, 0
        self.moments = {(kind, name): (np.zeros_like(value), np.zeros_like(value))
                        for kind in ("weights", "bias") for name, value in getattr(model, kind).items()}

    def update(self, model: FusionModel, grad: FusionModel) -> None:
        self.step += 1
        for (kind, name), (mean, square) in self.moments.items():
            value, g = getattr(model, kind)[name], getattr(grad, kind)[name]
            mean += 0.1 * (g - mean)
            square += 0.001 * (g * g - square)
            rate = np.sqrt(square / (1 - 0.999**self.step)) + 1e-8
            value *= 1 - self.lr * self.decay
            value -= self.lr * (mean / (1 - 0.9**self.step)) / rate


# Steps that a worker takes between two meetings, and how many steps a meeting may carry the model on.
LOCAL_STEPS = 4
REACH = 32
# Meetings of an epoch, after which workers take more steps between two.
MOST_ROUNDS = 64
# Parameter rows that are added up in one group.
ROWS_ADDED = 256
PARTS = ("model", "mean", "square")
ROUND = "part string, modality string, slice int, loss double, items long, at array<int>, value array<double>"


def worker_count(batches: int, local_steps: int) -> int:
    """Workers of an epoch: as many as a meeting's reach allows, and at least two meetings an epoch."""
    return max(1, min(REACH // local_steps, batches // (2 * local_steps)))


def _rested(start: tuple[FusionModel, AdamW], steps: int) -> tuple[FusionModel, AdamW]:
    """Model and optimiser after so many steps without a gradient: where all rows go that no batch touches."""
    model, optimizer = copy.deepcopy(start)
    still = model.zeros()
    for _ in range(steps):
        optimizer.update(model, still)
    return model, optimizer


def local_steps(batched: DataFrame, shared: Broadcast, temperature: float, jaccard: bool, draw: tuple[int, int]) -> DataFrame:
    """What the workers of one round add to the shared (model, optimizer), summed over them.

    Each worker takes a step per batch of its own, in order. It reports the
    rows of parameters and moments that differ from resting, so its result
    grows with its batches, and in the rows `('', '', steps)` the totals of all
    workers with so many steps.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in key_runs(batches, "worker"):
            # A task may see the shared value again, so the steps are taken on a copy.
            model, optimizer = copy.deepcopy(shared.value)
            loss, items, steps = 0.0, 0, 0
            for run in key_runs(iter(own.to_batches()), "batch_id"):
                grad = model.zeros()
                rng = np.random.default_rng([*draw, run["batch_id"][0].as_py()])
                loss += batch_gradient(model, run, temperature, jaccard, rng, grad) * run.num_rows
                optimizer.update(model, grad)
                items, steps = items + run.num_rows, steps + 1
            rest, rest_optimizer = _rested(shared.value, steps)
            rows = [("", "", steps, loss, items, [1], [1.0])]
            for (kind, name), moments in optimizer.moments.items():
                found = (getattr(model, kind)[name], *moments)
                rested = (getattr(rest, kind)[name], *rest_optimizer.moments[kind, name])
                for part, a, b in zip(PARTS, found, rested, strict=True):
                    apart = np.atleast_2d(a - b)
                    touched = np.flatnonzero(apart.any(axis=1))
                    for number in np.unique(touched // ROWS_ADDED):
                        at = touched[touched // ROWS_ADDED == number]
                        rows.append((part, f"{kind}:{name}", int(number), None, None, at, apart[at].reshape(-1)))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "modality", "slice", "loss", "items", "at", "value"])

    def added(group: pa.Table) -> pa.Table:
        at = one_array(group["at"]).flatten().to_numpy()
        values = one_array(group["value"]).flatten().to_numpy().reshape(len(at), -1)
        places, back = np.unique(at, return_inverse=True)
        total = np.zeros((len(places), values.shape[1]))
        np.add.at(total, back, values)
        head = group.slice(0, 1).select(["part", "modality", "slice"])
        for name, value, kind in (
            ("loss", pa.compute.sum(group["loss"]).as_py(), pa.float64()), ("items", pa.compute.sum(group["items"]).as_py(), pa.int64()),
            ("at", places, pa.list_(pa.int32())), ("value", total.reshape(-1), pa.list_(pa.float64())),
        ):
            head = head.append_column(name, pa.array([value], kind))
        return head

    narrow = batched.select("worker", "batch_id", "row_id", "keep", *INPUTS)
    return narrow.mapInArrow(task, ROUND).groupBy("part", "modality", "slice").applyInArrow(added, ROUND)


def take_round(batched: DataFrame, model: FusionModel, optimizer: AdamW, temperature: float, jaccard: bool,
               draw: tuple[int, int]) -> tuple[float, int]:
    """One meeting of the workers; changes model and optimizer, returns summed loss and items.

    The workers' steps are added, as if taken one after the other from the
    same place; beyond REACH steps in all they count as REACH, or as the mean
    of the workers' where that is more. Moments are averaged.
    """
    start = (model.copy(), copy.deepcopy(optimizer))
    shared = batched.sparkSession.sparkContext.broadcast(start)
    table = local_steps(batched, shared, temperature, jaccard, draw).toArrow()
    shared.unpersist()
    rows = table.to_pylist()
    heads = [row for row in rows if not row["part"]]
    workers = {row["slice"]: round(row["value"][0]) for row in heads}
    count, taken = sum(workers.values()), sum(steps * n for steps, n in workers.items())
    share = {"model": min(1.0, max(REACH / taken, 1 / count)), "mean": 1 / count, "square": 1 / count}
    for (kind, name), moments in optimizer.moments.items():
        for moment in moments:
            moment[...] = 0.0
    for steps, n in workers.items():
        rest, rest_optimizer = _rested(start, steps)
        for (kind, name), moments in optimizer.moments.items():
            getattr(model, kind)[name] += share["model"] * n * (getattr(rest, kind)[name] - getattr(start[0], kind)[name])
            for moment, rested in zip(moments, rest_optimizer.moments[kind, name], strict=True):
                moment += n / count * rested
    for row in rows:
        if row["part"]:
            kind, name = row["modality"].split(":", 1)
            found = (getattr(model, kind)[name], *optimizer.moments[kind, name])[PARTS.index(row["part"])]
            value = share[row["part"]] * np.array(row["value"]).reshape(len(row["at"]), -1)
            if kind == "bias":
                found += value[0]
            else:
                found[row["at"]] += value
    optimizer.step += max(workers)
    return sum(row["loss"] for row in heads), sum(row["items"] for row in heads)


def validation_batches(encoded: DataFrame, batch_size: int) -> DataFrame:
    """The fixed batches of validation rows, the last partial one included, written once for all epochs."""
    narrow = encoded.select("row_id", *INPUTS)
    return materialise(assign_batches(narrow, "validation", 0, batch_size, drop_last=False), "validation")


def validation_loss(encoded: DataFrame, model: FusionModel, temperature: float, jaccard: bool,
                    batch_size: int) -> float:
    """Loss over all rows, nothing dropped."""
    return held_loss(validation_batches(encoded, batch_size), model, temperature, jaccard)


def held_loss(batched: DataFrame, model: FusionModel, temperature: float, jaccard: bool) -> float:
    """Loss over stored validation batches."""
    shared = batched.sparkSession.sparkContext.broadcast(model)
    losses = fused_losses(batched, shared, temperature, jaccard)
    total = epoch_loss(losses).first()["loss"]
    shared.unpersist()
    return total


def train_fusion(
    train: DataFrame,
    validation: DataFrame,
    model: FusionModel,
    epochs: int = fixed.EPOCHS,
    batch_size: int = fixed.BATCH_SIZE,
    lr: float = fixed.LEARNING_RATE,
    temperature: float = fixed.TEMPERATURE,
    modality_dropout: float = fixed.MODALITY_DROPOUT,
    jaccard: bool = False,
    seed: int = fixed.SEED,
    patience: int = fixed.PATIENCE,
    rounds: int | None = None,
    decay: float = fixed.WEIGHT_DECAY,
    report: Callable[[int, float, float], None] | None = None,
    workers: int | None = None,
    steps: int = LOCAL_STEPS,
) -> tuple[FusionModel, list[tuple[int, float, float]]]:
    """Contrastive training with early stopping; returns the best model.

    `train` and `validation` hold the encoded inputs, best as stored tables.
    An epoch shuffles the rows into batches once. Workers, a task each, take
    a step per batch, `steps` of them between two meetings (`take_round`), so
    an epoch has batches / (workers * steps) rounds. One worker steps through
    all batches in their order; by default their number follows the batches.
    Where an epoch would have more than MOST_ROUNDS rounds, workers take more
    steps between two, so that rounds do not grow with the table. With
    `rounds` an epoch takes so many averaged steps instead.
    """
    optimizer = AdamW(model, lr, decay)
    held = validation_batches(validation, batch_size)
    n_train = train.count()
    best, best_loss, waited, history = model.copy(), float("inf"), 0, []
    for epoch in range(1, epochs + 1):
        batched = assign_batches(train.select("row_id", *INPUTS), seed, epoch, batch_size)
        batched = keep_flags(batched, modality_dropout, seed, epoch)
        count, loss, items = (n_train // batch_size if rounds is None else 0), 0.0, 0
        crew = workers or worker_count(count, steps)
        taken = max(steps, -(-count // (crew * MOST_ROUNDS)))
        if rounds is None:
            # A partition holds one worker's batches of all rounds, in order, so that a round moves no rows.
            place = F.pmod("batch_id", F.lit(crew * taken))
            batched = batched.withColumn("round", F.floor(F.col("batch_id") / (crew * taken)))
            batched = batched.withColumn("worker", F.floor(place / taken).cast("int"))
            batched = batched.repartitionByRange(crew, "worker").sortWithinPartitions("round", "worker", "batch_id", "row_id")
        batched = batched.persist()
        for number in range(-(-count // (crew * taken))):
            share = batched.filter(F.col("round") == number)
            part_loss, part_items = take_round(share, model, optimizer, temperature, jaccard, (seed, epoch))
            loss, items = loss + part_loss, items + part_items
        for part in range(rounds or 0):
            share = batched.filter(F.pmod("batch_id", F.lit(rounds)) == part) if rounds > 1 else batched
            grad, part_loss, part_items = mean_gradient(share, model, temperature, jaccard)
            if part_items:
                optimizer.update(model, grad)
                loss, items = loss + part_loss, items + part_items
        batched.unpersist()
        val_loss = held_loss(held, model, temperature, jaccard)
        history.append((epoch, loss / max(items, 1), val_loss))
        if report:
            report(*history[-1])
        if val_loss < best_loss:
            best, best_loss, waited = model.copy(), val_loss, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best, history
