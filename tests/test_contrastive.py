"""Contrastive loss, its gradient, fusion and training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinium import fixed
from affinium.operators import contrastive as con
from affinium.operators import fusion as fu
from affinium.operators.network import FusionNetwork

SIZES = {"genres": 4, "director": 3, "writer": 2, "cast": 5}


def unit_rows(rng, n, dim):
    z = rng.normal(size=(n, dim))
    return z / np.linalg.norm(z, axis=1, keepdims=True)


def test_loss_definition_and_gradient():
    rng = np.random.default_rng(0)
    z, weights = unit_rows(rng, 7, 4), np.abs(rng.normal(size=(7, 7)))
    np.fill_diagonal(weights, 0)
    weights[2] = 0
    loss, valid, grad = con.info_nce(z, weights, 0.2)
    total = 0.0
    for i in range(7):
        if weights[i].sum() == 0:
            continue
        s = z @ z[i] / 0.2
        lse = np.log(sum(np.exp(s[j]) for j in range(7) if j != i))
        total += -sum(weights[i, j] * (s[j] - lse) for j in range(7) if j != i) / weights[i].sum()
    assert valid == 6 and loss == pytest.approx(total / 6)
    for at in ((0, 0), (2, 1), (6, 3)):
        step = np.zeros_like(z)
        step[at] = 1e-6
        slope = (con.info_nce(z + step, weights, 0.2)[0] - con.info_nce(z - step, weights, 0.2)[0]) / 2e-6
        assert grad[at] == pytest.approx(slope, abs=1e-6)


def test_no_positive_and_single_row():
    z = unit_rows(np.random.default_rng(0), 3, 2)
    assert con.info_nce(z, np.zeros((3, 3)), 0.07)[:2] == (0.0, 0)
    assert con.info_nce(z[:1], np.zeros((1, 1)), 0.07)[:2] == (0.0, 0)


def test_pair_weights():
    rows, values = np.array([0, 0, 1, 2]), np.array(["a", "b", "b", "c"], dtype=object)
    binary = con.pair_weights(rows, values, 4, False)
    assert binary.tolist() == [[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]
    assert con.pair_weights(rows, values, 4, True)[0, 1] == 0.5


def test_losses_on_spark(spark):
    """A batch larger than an Arrow batch still is one batch."""
    rng = np.random.default_rng(1)
    z = unit_rows(rng, 90, 3)
    rows = [(i, i // 30, [f"g{i % 4}"], [float(x) for x in z[i]]) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, batch_id long, genres array<string>, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = con.batch_losses(df).orderBy("batch_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for row in got:
        at = np.arange(row["batch_id"] * 30, row["batch_id"] * 30 + 30)
        weights = (at[:, None] % 4 == at[None, :] % 4).astype(float)
        np.fill_diagonal(weights, 0)
        assert row["loss"] == pytest.approx(con.info_nce(z[at], weights, 0.07)[0])
        assert (row["n_items"], row["n_valid"]) == (30, 30)
    total = con.epoch_loss(con.batch_losses(df)).first()
    assert total["loss"] == pytest.approx(np.mean([row["loss"] for row in got]))
    assert con.epoch_loss(con.batch_losses(df.limit(0))).first()["loss"] == 0.0


def test_batch_weights(spark):
    df = spark.createDataFrame(
        [(0, 0, ["a", "a"]), (1, 0, ["a", "b"]), (2, 0, ["c"]), (3, 1, ["a"])],
        "row_id long, batch_id long, genres array<string>",
    )
    rows = {r["row_id"]: r["positives"] for r in con.batch_weights(df, jaccard=True).collect()}
    assert [tuple(p) for p in rows[0]] == [(1, 0.5)]
    assert rows[2] == [] and rows[3] == []


def test_keep_flags(spark):
    ids = spark.range(4000).withColumnRenamed("id", "row_id")
    flags = con.keep_flags(ids, 0.3, 1, 2)
    shares = flags.select(*[F.avg(F.get("keep", F.lit(at))) for at in range(8)]).first()
    assert all(abs(share - 0.7) < 0.04 for share in shares)
    assert con.keep_flags(ids.repartition(7), 0.3, 1, 2).exceptAll(flags).isEmpty()
    assert con.keep_flags(ids, 0.3, 1, 3).filter("keep <> array(0d)").exceptAll(flags).count() > 0


def encoded(spark, n=48, seed=0, batches=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        genre = int(i % 4)
        rows.append((i, i % batches, [float(x) for x in rng.normal(size=6) + genre], sorted({genre, int(rng.integers(4))}),
                     [int(x) for x in rng.permutation(5)[: rng.integers(0, 3)]], int(rng.integers(3)),
                     int(rng.integers(2)), *[float(x) for x in rng.normal(size=4)],
                     [float(x) for x in rng.integers(0, 2, 8)]))
    return spark.createDataFrame(
        rows, "row_id long, batch_id long, text array<float>, genre_idx array<int>, cast_idx array<int>, "
        "director_idx int, writer_idx int, year_n double, rating_n double, duration_n double, votes_n double, "
        "keep array<double>")


def total_loss(spark, df, model):
    shared = spark.sparkContext.broadcast(model)
    row = fu.gradient_sums(df, shared, 0.5, False).filter("modality = ''").first()
    return row["loss"] / row["items"]


def test_gradient_matches_finite_differences(spark):
    df = encoded(spark).persist()
    model = fu.FusionModel.create(6, SIZES, 4, seed=3)
    grad, _, items = fu.mean_gradient(df, model, 0.5)
    assert items == 48
    for kind, name, at in (("weights", "text", (2, 1)), ("weights", "genres", (1, 3)), ("weights", "cast", (4, 0)),
                           ("weights", "director", (2, 2)), ("weights", "votes", (0, 1)), ("bias", "year", (3,)),
                           ("bias", "text", (0,))):
        losses = []
        for sign in (1, -1):
            moved = model.copy()
            getattr(moved, kind)[name][at] += sign * 1e-4
            losses.append(total_loss(spark, df, moved))
        slope = (losses[0] - losses[1]) / 2e-4
        assert getattr(grad, kind)[name][at] == pytest.approx(slope, abs=1e-5)
    df.unpersist()


def test_embedding(spark):
    df = encoded(spark)
    model = fu.FusionModel.create(6, SIZES, 4)
    full = np.array([r["embedding"] for r in fu.embed(df, model).orderBy("row_id").collect()])
    assert np.linalg.norm(full, axis=1) == pytest.approx(np.ones(48), abs=1e-5)
    text = df.orderBy("row_id").select("text").collect()
    u = np.array([r["text"] for r in text]) @ model.weights["text"] + model.bias["text"]
    expected = u / np.linalg.norm(u, axis=1, keepdims=True)
    dropped = fu.embed(df, model, tuple(fixed.MODALITIES)).orderBy("row_id").collect()
    assert np.array([r["embedding"] for r in dropped]) == pytest.approx(expected, abs=1e-5)
    only = fu.embed_text(df.select("row_id", "text"), model).orderBy("row_id")
    assert only.columns == ["row_id", "text", "embedding"]
    assert np.array([r["embedding"] for r in only.collect()]) == pytest.approx(expected, abs=1e-5)


def test_model_round_trip(spark):
    model = fu.FusionModel.create(6, SIZES | {"cast": 0}, 4)
    assert "cast" not in model.metadata
    loaded = fu.FusionModel.from_frame(model.to_frame(spark))
    for name in model.weights:
        assert np.array_equal(loaded.weights[name], model.weights[name])
        assert np.array_equal(loaded.bias[name], model.bias[name])


def test_training_lowers_the_loss(spark):
    train, val = encoded(spark, 96).drop("batch_id", "keep"), encoded(spark, 32, 1).drop("batch_id", "keep")
    model = fu.FusionModel.create(6, SIZES, 4)
    best, history = fu.train_fusion(train, val, model, epochs=4, batch_size=16, lr=0.05, temperature=0.5, rounds=2)
    assert history[-1][1] < history[0][1]
    assert fu.validation_loss(val, best, 0.5, False, 16) == pytest.approx(min(h[2] for h in history), abs=1e-9)


def test_one_worker_takes_a_step_per_batch(spark):
    """One worker equals stepping through the batches one after the other, however often it reports."""
    data = encoded(spark, 100).drop("batch_id", "keep")
    want, losses = fu.FusionModel.create(6, SIZES, 4), []
    optimizer = fu.AdamW(want, 0.05)
    for epoch in (1, 2):
        batched = fu.assign_batches(data.select("row_id", *fu.INPUTS), 7, epoch, 16)
        batched = fu.keep_flags(batched, 0.3, 7, epoch).persist()
        losses.append(0.0)
        for at in range(6):
            grad, loss, items = fu.mean_gradient(batched.filter(f"batch_id = {at}"), want, 0.5)
            assert items == 16
            optimizer.update(want, grad)
            losses[-1] += loss / 96
    got = fu.FusionModel.create(6, SIZES, 4)
    _, history = fu.train_fusion(data, data, got, epochs=2, batch_size=16, lr=0.05, temperature=0.5,
                                 modality_dropout=0.3, seed=7, workers=1, steps=6)
    assert [h[1] for h in history] == pytest.approx(losses, abs=1e-9)
    for name in want.weights:
        assert got.weights[name] == pytest.approx(want.weights[name], abs=1e-9)
        assert got.bias[name] == pytest.approx(want.bias[name], abs=1e-9)


def test_early_stopping(spark):
    data = encoded(spark, 32).drop("batch_id", "keep")
    model = fu.FusionModel.create(6, SIZES, 4)
    _, history = fu.train_fusion(data, data, model, epochs=6, batch_size=16, lr=0.0, patience=2, rounds=1)
    assert len(history) == 3


def test_workers_add_their_steps(spark, monkeypatch):
    """A round equals separate walks from the same start, added up; rounds have a task per worker and no single one."""
    data = encoded(spark, 100).drop("batch_id", "keep")
    batched = fu.keep_flags(fu.assign_batches(data.select("row_id", *fu.INPUTS), 7, 1, 16), 0.3, 7, 1).persist()
    for reach in (32, 3):
        monkeypatch.setattr(fu, "REACH", reach)
        start, walks = fu.FusionModel.create(6, SIZES, 4), []
        for worker in range(3):
            model = start.copy()
            optimizer = fu.AdamW(model, 0.05)
            for at in (2 * worker, 2 * worker + 1):
                optimizer.update(model, fu.mean_gradient(batched.filter(f"batch_id = {at}"), model, 0.5)[0])
            walks.append((model, optimizer))
        got = start.copy()
        fu.train_fusion(data, data, got, epochs=1, batch_size=16, lr=0.05, temperature=0.5, modality_dropout=0.3, seed=7,
                        workers=3, steps=2)
        for name in start.weights:
            moved = sum(m.weights[name] - start.weights[name] for m, _ in walks) * min(1, reach / 6)
            assert got.weights[name] == pytest.approx(start.weights[name] + moved, abs=1e-9)
    plans = []
    real = fu.take_round
    monkeypatch.setattr(fu, "take_round", lambda part, *rest: plans.append(part.rdd.getNumPartitions()) or real(part, *rest))
    fu.train_fusion(data, data, start.copy(), epochs=1, batch_size=16, workers=3, steps=1)
    assert plans == [3, 3]


def test_rounds_of_an_epoch_are_bounded(spark, monkeypatch):
    """40 batches in two rounds instead of 20: workers take more steps, and every row is still trained on."""
    monkeypatch.setattr(fu, "MOST_ROUNDS", 2)
    items, real = [], fu.take_round

    def spy(*args):
        items.append(real(*args)[1])
        return 0.0, items[-1]

    monkeypatch.setattr(fu, "take_round", spy)
    df = encoded(spark, n=160)
    fu.train_fusion(df, df, fu.FusionModel.create(6, SIZES, 4), epochs=1, batch_size=4, workers=2, steps=1)
    assert len(items) == 2 and sum(items) == 160


def test_workers_follow_the_batches():
    assert [fu.worker_count(n, 4) for n in (0, 1, 8, 18, 64, 10**6)] == [1, 1, 1, 2, 8, 8]


@pytest.fixture(scope="module")
def network():
    return FusionNetwork.create(6, SIZES, 4, seed=3, hidden=5, id_dim=2)


def test_network_gradient_matches_finite_differences(spark, network):
    """One entry of every block of weights and biases."""
    df = encoded(spark).persist()
    grad, _, items = fu.mean_gradient(df, network, 0.5)
    assert items == 48
    runs = [df.filter(f"batch_id = {b}").orderBy("row_id").toArrow() for b in (0, 1)]

    def loss(model):
        return sum(fu.batch_gradient(model, run, 0.5, False, None, model.zeros()) for run in runs) / len(runs)

    for kind in ("weights", "bias"):
        for name, block in getattr(network, kind).items():
            slopes = np.zeros_like(block)
            for at in np.ndindex(block.shape):
                sides = []
                for sign in (1, -1):
                    moved = network.copy()
                    getattr(moved, kind)[name][at] += sign * 1e-5
                    sides.append(loss(moved))
                slopes[at] = (sides[0] - sides[1]) / 2e-5
            assert getattr(grad, kind)[name] == pytest.approx(slopes, abs=1e-5), (kind, name)
    df.unpersist()


def test_network_drops_units_alike(network, spark):
    """A draw is that of its seed, keeps the mean, and is off when embedding."""
    run = encoded(spark, 24, batches=1).orderBy("row_id").toArrow()
    losses = [fu.batch_gradient(network, run, 0.5, False, np.random.default_rng(s), network.zeros()) for s in (1, 1, 2)]
    assert losses[0] == losses[1] != losses[2]
    x = np.ones((4000, 6))
    kept, gate = network._hidden("text", x, np.random.default_rng(0))
    plain, _ = network._hidden("text", x, None)
    assert kept.mean(axis=0) == pytest.approx(plain.mean(axis=0), rel=0.06)


def test_network_round_trip_and_embedding(spark, network):
    loaded = fu.FusionModel.from_frame(network.to_frame(spark))
    assert type(loaded) is FusionNetwork
    for kind in ("weights", "bias"):
        assert {k: v.tolist() for k, v in getattr(loaded, kind).items()} == {k: v.tolist() for k, v in getattr(network, kind).items()}
    df = encoded(spark)
    text = np.array([r["text"] for r in df.orderBy("row_id").collect()])
    hidden = np.maximum(text @ network.weights["text"] + network.bias["text"], 0)
    joined = np.zeros((48, network.weights["fuse"].shape[0]))
    joined[:, :4] = hidden @ network.weights["text_out"] + network.bias["text_out"]
    u = np.maximum(joined @ network.weights["fuse"] + network.bias["fuse"], 0) @ network.weights["fuse_out"] + network.bias["fuse_out"]
    got = fu.embed(df, network, tuple(fixed.MODALITIES)).orderBy("row_id").collect()
    assert np.array([r["embedding"] for r in got]) == pytest.approx(u / np.linalg.norm(u, axis=1, keepdims=True), abs=1e-5)
    bare = FusionNetwork.create(6, SIZES | {"cast": 0}, 4, hidden=5)
    assert "cast" not in bare.metadata and bare.weights["fuse"].shape == (8 * 4, 5)


def test_network_learns_what_a_linear_fusion_cannot(spark):
    """Items are alike when two text components agree in sign: no linear map tells them apart."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        a, b = rng.choice([-1.0, 1.0], 2)
        text = [a + 0.1 * rng.normal(), b + 0.1 * rng.normal(), 1.0, 0.0, 0.0, 0.0]
        rows.append((i, [float(x) for x in text], [int(a * b > 0)], [], 0, 0, 0.0, 0.0, 0.0, 0.0))
    data = spark.createDataFrame(rows, "row_id long, text array<float>, genre_idx array<int>, cast_idx array<int>, director_idx int, "
                                 "writer_idx int, year_n double, rating_n double, duration_n double, votes_n double")
    train, val = data.filter("row_id < 192"), data.filter("row_id >= 192")
    best = {}
    for kind in (fu.FusionModel, FusionNetwork):
        options = {"hidden": 16} if kind is FusionNetwork else {}
        _, history = fu.train_fusion(train, val, kind.create(6, SIZES, 4, **options), epochs=6, batch_size=48, lr=0.02,
                                     temperature=0.5, workers=1)
        best[kind] = min(h[2] for h in history)
    assert best[FusionNetwork] < best[fu.FusionModel] - 0.1
