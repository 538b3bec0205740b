"""Principal components against an SVD."""

import numpy as np
import pytest

from affinium.operators.projection import embedding_map, principal_components


def test_components_match_svd(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(80, 6)) * np.array([5, 3, 2, 1, 0.5, 0.1]) + 7).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                               "row_id long, embedding array<float>")
    projection = principal_components(df)
    got = np.array([r["pc"] for r in projection.rows.orderBy("row_id").collect()])
    centred = x.astype(float) - x.astype(float).mean(axis=0)
    _, values, axes = np.linalg.svd(centred, full_matrices=False)
    assert projection.explained == pytest.approx((values**2 / (values**2).sum())[:3], abs=1e-9)
    assert np.abs(got) == pytest.approx(np.abs(centred @ axes[:3].T), abs=1e-5)
    for at in range(3):
        axis = axes[at] * np.sign(axes[at][np.abs(axes[at]).argmax()])
        assert got[:, at] == pytest.approx(centred @ axis, abs=1e-5)


def test_map_samples_and_labels(spark):
    rows = [(i, f"t{i}", 1999.0 if i % 2 else None, ["a"] if i % 3 else [], [float(i), float(i * i), 1.0, float(i % 5)])
            for i in range(50)]
    index = spark.createDataFrame(
        rows, "row_id long, title string, year double, genres array<string>, embedding array<float>")
    points = embedding_map(index, 20).collect()
    assert len(points) == 20
    for row in points:
        assert row["label"] == (f"t{row['row_id']} (1999)" if row["row_id"] % 2 else f"t{row['row_id']}")
        assert row["category"] == ("a" if row["row_id"] % 3 else "Unknown")
