"""Quadratic spline interpolation (CL6) against a dense collocation system."""

import datetime

import numpy as np
import pytest

from growthspark.functions.spline import quadratic_spline
from growthspark.operators import windows as WN


def dense(x, y, at):
    """Cox-de Boor basis over the full knot vector, solved as a dense system."""
    n = len(x)
    t = np.concatenate(([x[0]] * 3, (x[1:-2] + x[2:-1]) / 2, [x[-1]] * 3))

    def basis(i, k, u):
        if k == 0:
            return float(t[i] <= u < t[i + 1] or (u == t[-1] and t[i] < t[i + 1] == t[-1]))
        left = (u - t[i]) / (t[i + k] - t[i]) * basis(i, k - 1, u) if t[i + k] > t[i] else 0.0
        right = (t[i + k + 1] - u) / (t[i + k + 1] - t[i + 1]) * basis(i + 1, k - 1, u) if t[i + k + 1] > t[i + 1] else 0.0
        return left + right

    rows = lambda us: np.array([[basis(i, 2, u) for i in range(n)] for u in us])
    return rows(at) @ np.linalg.solve(rows(x), y)


@pytest.mark.parametrize("n", [3, 4, 5, 9, 40])
def test_spline_matches_dense_system(n):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.integers(1, 4, n)).astype(float)
    y = rng.normal(size=n) * 100
    at = np.arange(x[0], x[-1] + 1)
    assert np.allclose(quadratic_spline(x, y, at), dense(x, y, at), atol=1e-9)
    assert np.allclose(quadratic_spline(x, 3 * x * x - x + 2, at), 3 * at * at - at + 2)  # a quadratic is its own spline
    assert np.isnan(quadratic_spline(x, y, [x[0] - 1, x[-1] + 1])).all()


def test_creators_apart_and_outer_gaps_stay(spark):
    day = datetime.date(2024, 1, 1)
    series = {"a": [None, 1.0, None, 9.0, 16.0, None, 36.0, None], "b": [1.0, None, 3.0], None: [0.0, 1.0, None, 9.0], "c": [None, None]}
    rows = [(u, day + datetime.timedelta(i), v, "x") for u, vs in series.items() for i, v in enumerate(vs)]
    got = {(r["username"], (r["date"] - day).days): r["v"] for r in WN.interpolate(
        spark.createDataFrame(rows, "username string, date date, v double, _new string"), "v", "polynomial").collect()}
    assert len(got) == len(rows)
    known = [(1, 1.0), (3, 9.0), (4, 16.0), (6, 36.0)]
    want = dense(np.array([k for k, _ in known], float), np.array([v for _, v in known]), [2.0, 5.0])
    assert got["a", 0] is None and got["a", 7] is None
    assert [got["a", 2], got["a", 5]] == pytest.approx(list(want))
    assert got["b", 1] is None and got["c", 0] is None  # fewer than three known values
    assert got[None, 2] == pytest.approx(4.0)
