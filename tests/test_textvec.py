"""Text encoders and the feature store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinium.functions import vectors as vec
from affinium.operators.textvec import BatchTextEncoder, HashedTextEncoder, PrecomputedEncoder, TfidfTextEncoder, onnx_encoder
from affinium.plans import runs
from affinium.sources.features import FeatureStore

TEXTS = ["a baker opens a shop", "a baker opens a shop", "Baker!  opens; SHOP a a", "école d'été 42", "", "zzz"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, description string")


def encoded(df, encoder):
    rows = encoder.transform(df, "description", "text").orderBy("row_id").select("text").collect()
    return np.array([row["text"] for row in rows])


def test_hashed_terms(spark):
    got = encoded(frame(spark), HashedTextEncoder(64))
    assert got.shape == (6, 64)
    assert np.array_equal(got[0], got[1])
    assert got[0] == pytest.approx(got[2])  # word order, case and punctuation do not matter
    assert np.linalg.norm(got, axis=1) == pytest.approx([1, 1, 1, 1, 0, 1], abs=1e-6)
    assert sorted(got[0][got[0] > 0]) == pytest.approx(sorted(np.array([2, 1, 1, 1]) / np.sqrt(7)), abs=1e-6)


def test_tfidf(spark):
    df = frame(spark)
    encoder = TfidfTextEncoder.fit(df, "description", 64)
    plain, weighted = encoded(df, HashedTextEncoder(64)), encoded(df, encoder)
    counts = plain * np.where(np.arange(6) == 4, 1, 1)[:, None]
    expected = counts * np.array(encoder.weights)
    norms = np.maximum(np.linalg.norm(expected, axis=1, keepdims=True), 1e-12)
    assert weighted == pytest.approx(expected / norms, abs=1e-5)
    assert encoder.name != TfidfTextEncoder.fit(df.limit(2), "description", 64).name


def test_whole_text_counts(spark):
    """A word at the far end of a long text changes its vector."""
    long = "word " * 20_000
    got = encoded(frame(spark, [long, long + " tail"]), HashedTextEncoder(64))
    assert not np.array_equal(got[0], got[1])


def test_batch_encoder(spark):
    def load_lengths():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    got = encoded(frame(spark).repartition(3), BatchTextEncoder("lengths", 2, load_lengths, batch_size=2))
    assert got[:, 0].tolist() == [len(t) for t in TEXTS]


def test_store_encodes_each_text_once(spark, tmp_path):
    store, encoder = FeatureStore(spark, str(tmp_path)), HashedTextEncoder(32)
    df = frame(spark)
    assert store.misses(df, encoder).count() == 5  # two equal texts
    out = store.features(df, encoder).orderBy("row_id").collect()
    assert np.array([r["text"] for r in out]) == pytest.approx(encoded(df, encoder))
    assert store.misses(df, encoder).isEmpty()
    assert store.read(encoder.name).count() == 5
    more = frame(spark, [*TEXTS, "new text"])
    assert [r["text"] for r in store.misses(more, encoder).collect()] == ["new text"]
    assert store.misses(df, HashedTextEncoder(16)).count() == 5  # another model, other keys


def test_store_with_a_third_of_copies(spark, tmp_path):
    texts = [f"text {i}" if i % 3 else "copy" for i in range(300)]
    out = FeatureStore(spark, str(tmp_path)).features(frame(spark, texts), HashedTextEncoder(16))
    assert out.count() == 300 and out.select("row_id").distinct().count() == 300


def test_baseline(spark):
    df = frame(spark)
    found = runs.baseline(df, "shop baker", 3, HashedTextEncoder(64)).collect()
    assert [row["row_id"] for row in found] == [0, 1, 2]
    vectors = encoded(df, HashedTextEncoder(64))
    query = encoded(frame(spark, ["shop baker"]), HashedTextEncoder(64))[0]
    assert found[0]["score"] == pytest.approx(float(vectors[0] @ query), abs=1e-6)
    ranked = runs.baseline(df, "shop baker", 10, HashedTextEncoder(64)).collect()
    assert [row["score"] for row in ranked][-1] == 0.0 and len(ranked) == 6


def test_baseline_with_precomputed_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "k long, v array<float>")
    out = PrecomputedEncoder(vectors, "k", "v", 2, drop_absent=True).transform(frame(spark), "description", "text")
    assert out.count() == 2 and out.select(F.max(vec.norm(F.col("text")))).first()[0] == 1.0
    with pytest.raises(Exception, match="no vector for item"):
        PrecomputedEncoder(vectors, "k", "v", 2).transform(frame(spark), "description", "text").collect()


def test_overlapping_fills_keep_row_counts(spark, tmp_path):
    store, encoder, df = FeatureStore(spark, str(tmp_path / "store")), HashedTextEncoder(8), frame(spark)
    one = store.misses(df, encoder)
    encoded = encoder.transform(one, "text", "vector").select("text_key", "vector")
    for _ in range(2):
        encoded.write.mode("append").parquet(store._folder(encoder.name))
    assert store.features(df, encoder).count() == df.count()


def test_baseline_map(spark):
    points = runs.baseline_map(frame(spark).withColumn("title", F.col("row_id").cast("string")), "baker", 4,
                               HashedTextEncoder(64)).collect()
    by_label = {row["label"]: row for row in points}
    assert len(points) == 5 and by_label["<INPUT>"]["marker_size"] == 12.0
    assert by_label["<INPUT>"]["line_alpha"] is None
    assert by_label["0"]["marker_size"] == pytest.approx(8 + 20 * by_label["0"]["score"])


def field(number, payload):
    """One protobuf field: varint or length-delimited."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(payload, int):
        return varint(number << 3) + varint(payload)
    payload = payload.encode() if isinstance(payload, str) else payload
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def lookup_model(table):
    """Smallest sentence model: token states are rows of a table (one Gather)."""
    def value(name, kind, rank):
        shape = b"".join(field(1, field(2, f"{name}{at}")) for at in range(rank))
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    weights = field(1, table.shape[0]) + field(1, table.shape[1]) + field(2, 1) + field(8, "table") + field(9, table.tobytes())
    node = field(1, "table") + field(1, "input_ids") + field(2, "states") + field(4, "Gather")
    graph = (field(1, node) + field(2, "g") + field(5, weights) + field(11, value("input_ids", 7, 2))
             + field(12, value("states", 1, 3)))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def test_onnx_encoder_reads_whole_texts(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("onnxruntime")
    words = ["[UNK]", "a", "b", "c"]
    split = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    split.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    split.save(str(tmp_path / "tokenizer.json"))
    table = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [2, 2, 2]], np.float32)
    (tmp_path / "model.onnx").write_bytes(lookup_model(table))
    encoder = onnx_encoder(str(tmp_path / "model.onnx"), str(tmp_path / "tokenizer.json"), 3, window=4, batch_size=2)
    texts = ["a b", "a a a a a a a a a b b zzz", "", "c"]
    got = encoded(frame(spark, texts), encoder)
    for row, text in zip(got, texts, strict=True):
        ids = [words.index(w) if w in words else 0 for w in text.split()]
        mean = table[ids].mean(axis=0) if ids else np.zeros(3)
        assert row == pytest.approx(mean / max(np.linalg.norm(mean), 1e-12), abs=1e-6)
