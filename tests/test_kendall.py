"""Kendall's tau-b by range-wise inversion counting against all pairs."""

import numpy as np
import pytest

from growthspark.operators import aggregates as A


def tau_b(x, y):
    keep = ~(np.isnan(x) | np.isnan(y))
    x, y = x[keep], y[keep]
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    free = np.sqrt((dx != 0).sum() * (dy != 0).sum())
    return (dx * dy).sum() / free if free else None


def columns(seed, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    y = np.round(x + rng.normal(size=n), 1)
    hot = np.where(rng.random(n) < 0.4, 3.0, rng.integers(0, 50, n))  # one value holds two fifths of the rows
    z = np.where(rng.random(n) < 0.1, np.nan, -x)
    return {"x": x, "y": y, "hot": hot, "z": z}


@pytest.mark.parametrize("size", [1 << 18, 32])
def test_matrix_matches_all_pairs(spark, size):
    data = columns(1)
    rows = [tuple(float(v) for v in r) for r in zip(*data.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data))
    got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in A.kendall_matrix(df, list(data), size).collect()}
    assert len(got) == 16
    for a in data:
        for b in data:
            want = tau_b(data[a], data[b])
            assert got[a, b] == (None if want is None else pytest.approx(want, abs=1e-12)), (a, b)


@pytest.mark.parametrize("seed", range(6))
def test_inversions_with_ties_and_weights(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 60))
    x, y, c = rng.integers(0, 9, n), rng.integers(0, 12, n), rng.integers(1, 5, n)
    want = sum(int(c[i] * c[j]) for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
    assert A.inversions(x, y, c) == want
    assert A.inversions(x, y, c * 10 ** 12) == want * 10 ** 24


def test_constant_column_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert {(r["feature_a"], r["feature_b"]): r["correlation"] for r in A.kendall_matrix(df, ["a", "b"]).collect()} == {
        ("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): 1.0}
    df = spark.createDataFrame([], "a double, b double")
    assert [r["correlation"] for r in A.kendall_matrix(df, ["a", "b"]).collect()] == [None] * 4
