"""Dictionaries, kernel ridge and kernel k-means against dense kernels."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import landmarks

SCHEMA = "id long, v array<double>, y double"


def points(n, seed, dim=2):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, dim))
    return x, np.sin(2 * x[:, 0]) + x[:, -1]


def frame(spark, x, y, parts=5):
    return spark.createDataFrame([(i, list(map(float, v)), float(w)) for i, (v, w) in enumerate(zip(x, y, strict=True))], SCHEMA).repartition(parts)


def test_kernels():
    x, y = np.array([[1.0, 2.0]]), np.array([[0.0, 1.0], [3.0, -1.0]])
    assert landmarks.linear()(x, y).tolist() == [[2.0, 1.0]]
    assert landmarks.radial(0.5)(x, y)[0] == pytest.approx([np.exp(-1), np.exp(-6.5)])
    assert landmarks.polynomial(2.0, 1.0, 3)(x, y).tolist() == [[125.0, 27.0]]
    assert landmarks.sigmoid(0.1, 0.2)(x, y)[0] == pytest.approx(np.tanh([0.4, 0.3]))


def test_every_row_lies_within_the_tolerance(spark):
    x, y = points(600, 1)
    for kernel, tolerance in ((landmarks.radial(0.7), 1e-2), (landmarks.polynomial(1.0, 1.0, 2), 1e-8)):
        rows = landmarks.dictionary(frame(spark, x, y), "v", kernel, 200, tolerance)
        assert 3 < len(rows) < 120
        near = {tuple(r) for r in rows.tolist()}
        assert near <= {tuple(r) for r in x.tolist()} and len(near) == len(rows)
        got = landmarks.mapped(frame(spark, x, y), "v", kernel, rows).orderBy("id").collect()
        full = np.linalg.solve(kernel(rows, rows), kernel(rows, x))
        want = np.array([kernel(v[None], v[None])[0, 0] for v in x]) - (kernel(rows, x) * full).sum(0)
        assert max(r.away for r in got) <= tolerance + 1e-9
        assert [r.away for r in got] == pytest.approx(list(np.maximum(want, 0)), abs=1e-6)
        z = np.array([r.z for r in got])
        assert np.abs(z @ z.T - kernel(x, x)).max() <= tolerance + 1e-6
    assert len(rows) == 6  # the space of quadratic forms of two numbers


def test_the_bound_holds(spark):
    x, y = points(200, 2)
    rows = landmarks.dictionary(frame(spark, x, y), "v", landmarks.radial(20.0), 7, 1e-6)
    assert len(rows) == 7


def test_ridge_equals_the_dense_form(spark):
    x, y = points(150, 3)
    kernel = landmarks.radial(0.8)
    model = landmarks.kernel_ridge(frame(spark, x, y), "v", "y", kernel, (0.1,), 150, 1e-9)
    dense = np.linalg.solve(kernel(x, x) + 0.1 * np.eye(150), y)
    at, _ = points(30, 4)
    got = model.predict(frame(spark, at, at[:, 0]), "v").orderBy("id").collect()
    assert [r.predicted for r in got] == pytest.approx(list(kernel(at, x) @ dense), abs=1e-4)
    hat = kernel(x, x) @ np.linalg.inv(kernel(x, x) + 0.1 * np.eye(150))
    away = (y - hat @ y) / (1 - np.diag(hat))
    assert model.error == pytest.approx((away**2).mean(), rel=1e-3)


def test_leaving_out_picks_the_penalty(spark):
    x, y = points(150, 5)
    noisy = y + np.random.default_rng(6).normal(0, 0.3, len(y))
    kernel, penalties = landmarks.radial(0.8), (1e-6, 0.3, 1e4)
    model = landmarks.kernel_ridge(frame(spark, x, noisy), "v", "y", kernel, penalties, 80, 1e-3)
    assert model.penalty == 0.3


def test_rings_part_in_kernel_space(spark):
    angles = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    ring = np.column_stack([np.cos(angles), np.sin(angles)])
    x = np.vstack([0.3 * ring, 3.0 * ring])
    got = landmarks.kernel_kmeans(frame(spark, x, x[:, 0]), "id", "v", landmarks.polynomial(1.0, 0.0, 2), 2, 20, 1e-9)
    near = {r.id: r.cluster for r in got.collect()}
    assert all(near[i] == 0 for i in range(60)) and set(near.values()) == {0, min(i for i in near if near[i])}


def test_edge_cases(spark):
    rows = [(1, None, 1.0), (2, [], 1.0), (3, [float("nan"), 1.0], 1.0), (4, [1.0, None], 2.0), (5, [1.0, 2.0], 3.0), (6, [1.0, 2.0], None), (7, [1.0, 2.0], 3.0), (8, [0.0, 0.0], 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("z", F.lit("x"))
    found = landmarks.dictionary(df, "v", landmarks.linear(), 10, 1e-9)
    assert found.tolist() == [[1.0, 2.0]]
    assert {(r.id, round(r.z[0], 6), round(r.away, 6)) for r in landmarks.mapped(df, "v", landmarks.linear(), found).collect()} == {(i, round(5**0.5, 6), 0.0) for i in (5, 6, 7)} | {(8, 0.0, 0.0)}
    empty = df.filter("id < 0")
    assert len(landmarks.dictionary(empty, "v", landmarks.linear())) == 0
    with pytest.raises(ValueError):
        landmarks.kernel_ridge(empty, "v", "y", landmarks.linear())


def test_ridge_passes_over_what_differs(spark, monkeypatch):
    """Equal vectors are one row, and weights and errors are those of all rows."""
    rng = np.random.default_rng(9)
    x, y = np.repeat(rng.uniform(-1, 1, (12, 1)), 30, axis=0), rng.normal(0, 1, 360)
    seen, summed = [], landmarks.summed
    monkeypatch.setattr(landmarks, "summed", lambda df, *a: seen.append(df.count()) or summed(df, *a))
    kernel = landmarks.polynomial(1.0, 1.0, 2)
    got = landmarks.kernel_ridge(frame(spark, x, y), "v", "y", kernel, (0.5, 2.0), 10, 1e-9)
    z = landmarks.Space(kernel, got.space.rows).images(x)[0]
    inverse = np.linalg.inv(z.T @ z + got.penalty * np.eye(z.shape[1]))
    w = inverse @ z.T @ y
    error = (((y - z @ w) / (1 - ((z @ inverse) * z).sum(1))) ** 2).mean()
    assert set(seen) == {12} and got.weights == pytest.approx(w) and got.error == pytest.approx(error)
