"""Text encoders: named plug-ins that add a vector column to a frame."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinium.functions import vectors as vec
from affinium.operators.arrow import vector_column

TEXT_DIM = 384


class TextEncoder(Protocol):
    """`name` identifies model and version: equal names mean equal vectors."""

    name: str
    dim: int

    def transform(self, df: DataFrame, text: str, target: str) -> DataFrame: ...


class HashedTextEncoder:
    """Frozen encoder: hashed term frequencies, unit length. Runs on the JVM."""

    def __init__(self, dim: int = TEXT_DIM):
        self.dim, self.name = dim, f"hashed-terms-{dim}"

    def _terms(self, df: DataFrame, text: str) -> DataFrame:
        words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
        return HashingTF(inputCol="_words", outputCol="_terms", numFeatures=self.dim).transform(
            words.transform(df)
        )

    def transform(self, df: DataFrame, text: str, target: str) -> DataFrame:
        scaled = Normalizer(inputCol="_terms", outputCol="_unit").transform(self._terms(df, text))
        return scaled.withColumn(target, vector_to_array("_unit", "float32")).drop("_words", "_terms", "_unit")


class Md5TextEncoder:
    """Frozen encoder: term frequencies in md5 buckets, unit length.

    Any engine with md5 can repeat it. Terms and buckets are made on the JVM,
    only the counting of bucket numbers is a batch function.
    """

    def __init__(self, dim: int = TEXT_DIM):
        self.dim, self.name = dim, f"md5-terms-{dim}"

    def transform(self, df: DataFrame, text: str, target: str) -> DataFrame:
        dim = self.dim
        parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
        words = F.filter(parts, lambda word: word != "")
        buckets = F.transform(
            words, lambda word: F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long") % dim
        )

        @F.arrow_udf("array<float>")
        def count(lists: pa.Array) -> pa.Array:
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            cells = np.repeat(np.arange(len(sizes)), sizes) * dim + lists.flatten().to_numpy(zero_copy_only=False)
            counts = np.bincount(cells.astype(np.int64), minlength=len(sizes) * dim).reshape(len(sizes), dim)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return vector_column((counts / np.maximum(norms, 1)).astype(np.float32), pa.float32())

        return df.withColumn(target, count(buckets))


class TfidfTextEncoder(HashedTextEncoder):
    """Hashed terms weighted by inverse document frequency, fitted on one corpus.

    The weights are part of the encoder and of its name, so a refit never
    reuses vectors of an older fit.
    """

    def __init__(self, weights: list[float]):
        super().__init__(len(weights))
        digest = hashlib.md5(np.round(weights, 9).tobytes()).hexdigest()[:12]
        self.weights, self.name = weights, f"tfidf-{self.dim}-{digest}"

    @classmethod
    def fit(cls, df: DataFrame, text: str, dim: int = TEXT_DIM) -> TfidfTextEncoder:
        terms = HashedTextEncoder(dim)._terms(df, text)
        return cls(IDF(inputCol="_terms", outputCol="_idf").fit(terms).idf.toArray().tolist())

    def transform(self, df: DataFrame, text: str, target: str) -> DataFrame:
        weights = F.array(*[F.lit(w) for w in self.weights])
        terms = self._terms(df, text).withColumn("_dense", vector_to_array("_terms"))
        weighted = terms.withColumn("_w", F.zip_with("_dense", weights, lambda x, w: x * w))
        return weighted.withColumn(target, vec.unit(F.col("_w")).cast("array<float>")).drop(
            "_words", "_terms", "_dense", "_w"
        )


class PrecomputedEncoder:
    """Vectors that already exist, keyed by row id.

    An item without a vector is an error, unless the caller asks to leave
    such items out.
    """

    def __init__(self, vectors: DataFrame, row_id: str, vector: str, dim: int, name: str = "precomputed",
                 drop_absent: bool = False):
        self.vectors = vectors.select(F.col(row_id).alias("row_id"), F.col(vector).alias("_vector"))
        self.dim, self.name, self.drop_absent = dim, name, drop_absent

    def transform(self, df: DataFrame, text: str, target: str) -> DataFrame:
        joined = df.join(self.vectors, "row_id", "inner" if self.drop_absent else "left")
        kind = self.vectors.schema["_vector"].dataType
        absent = F.raise_error(F.concat(F.lit("no vector for item "), F.col("row_id").cast("string"))).cast(kind)
        return joined.withColumn(
            target, F.when(F.col("_vector").isNull(), absent).otherwise(F.col("_vector"))
        ).drop("_vector")


class BatchTextEncoder:
    """Any model as a function from a list of texts to a [n, dim] matrix.

    `load` runs once per Python worker and returns that function, so the model
    itself is opened on the executors.
    """

    def __init__(self, name: str, dim: int, load: Callable[[], Callable[[list[str]], np.ndarray]],
                 batch_size: int = 64):
        self.name, self.dim, self.load, self.batch_size = name, dim, load, batch_size

    def transform(self, df: DataFrame, text: str, target: str) -> DataFrame:
        load, size, dim, held = self.load, self.batch_size, self.dim, {}

        @F.arrow_udf("array<float>")
        def encode(texts: pa.Array) -> pa.Array:
            if "model" not in held:
                held["model"] = load()
            values = texts.to_pylist()
            parts = [held["model"](values[at : at + size]) for at in range(0, len(values), size)]
            rows = np.concatenate(parts) if parts else np.zeros((0, dim))
            return vector_column(np.asarray(rows, np.float32), pa.float32())

        return df.withColumn(target, encode(F.coalesce(text, F.lit(""))))


def onnx_encoder(model: str, tokenizer: str, dim: int, name: str | None = None, window: int = 256,
                 batch_size: int = 64) -> BatchTextEncoder:
    """Sentence encoder from an exported transformer: mean of the token vectors, unit length.

    `model` and `tokenizer` are files every executor can read. A text longer
    than the model's window is read window by window to its end, and the mean
    runs over the tokens of all windows.
    """

    def load() -> Callable[[list[str]], np.ndarray]:
        import onnxruntime
        from tokenizers import Tokenizer

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        wanted = {entry.name for entry in session.get_inputs()}
        split = Tokenizer.from_file(tokenizer)
        split.no_padding()
        split.enable_truncation(window)

        def token_sums(pieces: list) -> tuple[np.ndarray, np.ndarray]:
            shape = (len(pieces), max(1, *(len(piece.ids) for piece in pieces)))
            inputs = {key: np.zeros(shape, np.int64) for key in ("input_ids", "attention_mask", "token_type_ids")}
            for row, piece in enumerate(pieces):
                inputs["input_ids"][row, : len(piece.ids)] = piece.ids
                inputs["attention_mask"][row, : len(piece.ids)] = 1
                inputs["token_type_ids"][row, : len(piece.ids)] = piece.type_ids
            states = session.run(None, {key: value for key, value in inputs.items() if key in wanted})[0]
            weights = inputs["attention_mask"][:, :, None]
            return (states * weights).sum(axis=1), weights.sum(axis=1)

        def encode(texts: list[str]) -> np.ndarray:
            pieces = [(row, piece) for row, whole in enumerate(split.encode_batch(texts))
                      for piece in (whole, *whole.overflowing)]
            total, count = np.zeros((len(texts), dim)), np.zeros((len(texts), 1))
            for at in range(0, len(pieces), batch_size):
                part = pieces[at : at + batch_size]
                rows = [row for row, _ in part]
                sums, counts = token_sums([piece for _, piece in part])
                np.add.at(total, rows, sums)
                np.add.at(count, rows, counts)
            mean = total / np.maximum(count, 1)
            return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)

        return encode

    return BatchTextEncoder(name or model.rsplit("/", 1)[-1], dim, load, batch_size)
