"""Exact quantile selection, Gram-statistics fits and metrics against numpy."""

import numpy as np
import pytest

from growthspark.functions import stats as ST
from growthspark.operators import gram as G


@pytest.fixture()
def small_task_max(monkeypatch):
    # force the histogram narrowing path on small data
    monkeypatch.setattr(ST, "TASK_MAX", 40)
    monkeypatch.setattr(ST, "BUCKETS", 8)


def test_exact_quantiles_match_numpy_with_ties(spark, small_task_max):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=700), np.full(300, 2.5), rng.integers(0, 5, 200).astype(float)])
    y = rng.exponential(size=len(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    probs = [0.001, 0.1, 0.25, 0.5, 0.75, 0.95, 0.999]
    got = ST.global_quantiles(df, {f"x{p}": ("x", p) for p in probs} | {f"y{p}": ("y", p) for p in probs})
    for p in probs:
        assert got[f"x{p}"] == pytest.approx(np.percentile(x, p * 100), rel=0, abs=1e-12)
        assert got[f"y{p}"] == pytest.approx(np.percentile(y, p * 100), rel=0, abs=1e-12)


def test_quantiles_skip_nulls_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    got = ST.global_quantiles(df, {"a": ("a", 0.5), "b": ("b", 0.5)})
    assert got["a"] == 2.0 and got["b"] is None


def _gram_from_numpy(X, y, names):
    V = np.hstack([X, y[:, None]])
    sh = V.mean(0)
    D = V - sh
    return G.Gram(names + ["y"], float(len(y)), D.sum(0), D.T @ D, sh)


def test_ols_min_norm_on_collinear_shares_matches_lstsq(spark):
    rng = np.random.default_rng(0)
    n = 400
    shares = rng.dirichlet([2, 2, 2], size=n)
    X = np.hstack([rng.normal(size=(n, 2)), shares])
    y = X @ np.array([3.0, -1.0, 5.0, 2.0, -4.0]) + rng.normal(size=n)
    names = [f"x{i}" for i in range(5)]
    fit = G.solve(_gram_from_numpy(X, y, names), "linear")
    mu, sd = X.mean(0), X.std(0)
    Z = (X - mu) / sd
    w = np.linalg.lstsq(Z - Z.mean(0), y - y.mean(), rcond=None)[0]
    assert np.max(np.abs(fit.coef - w)) < 1e-8


def test_gram_from_spark_equals_numpy(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 3)) * [1, 100, 0.01] + [0, 1e4, 5]
    y = X @ [1.0, 0.02, 30.0] + rng.normal(size=300)
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(X, y)], "a double, b double, c double, y double")
    g = G.gram_by(df, ["a", "b", "c"], "y")[None]
    ref = _gram_from_numpy(X, y, ["a", "b", "c"])
    assert np.allclose(g.scatter(), ref.scatter(), rtol=1e-9, atol=1e-6)
    f1, f2 = G.solve(g, "ridge", 2.0), G.solve(ref, "ridge", 2.0)
    assert np.allclose(f1.coef, f2.coef, rtol=1e-9)


def test_ridge_closed_form_and_lasso_kkt():
    rng = np.random.default_rng(3)
    X = rng.normal(size=(500, 6))
    y = X @ rng.normal(size=6) + rng.normal(size=500)
    g = _gram_from_numpy(X, y, [f"x{i}" for i in range(6)])
    Z = (X - X.mean(0)) / X.std(0)
    yc = y - y.mean()
    w = np.linalg.solve(Z.T @ Z + 1.5 * np.eye(6), Z.T @ yc)
    assert np.allclose(G.solve(g, "ridge", 1.5).coef, w, rtol=1e-10)
    a = 0.2
    wl = G.solve(g, "lasso", a).coef
    grad = Z.T @ (yc - Z @ wl) / len(y)
    act = np.abs(wl) > 0
    assert np.all(np.abs(grad[act] - a * np.sign(wl[act])) < 1e-8)
    assert np.all(np.abs(grad[~act]) <= a + 1e-8)


def test_fold_sse_from_gram_equals_direct():
    rng = np.random.default_rng(4)
    X = rng.normal(size=(200, 3))
    y = X @ [1.0, 2.0, 3.0] + rng.normal(size=200)
    tr = _gram_from_numpy(X[:150], y[:150], ["a", "b", "c"])
    te = _gram_from_numpy(X[150:], y[150:], ["a", "b", "c"])
    fit = G.solve(tr, "linear")
    b0, b = fit.raw()
    resid = y[150:] - (b0 + X[150:] @ b)
    sse, sst = G.sse_on(te, fit)
    assert sse == pytest.approx(float(resid @ resid), rel=1e-10)
    assert sst == pytest.approx(float(((y[150:] - y[150:].mean()) ** 2).sum()), rel=1e-10)


def test_time_series_folds_like_sklearn():
    # sklearn TimeSeriesSplit(n_splits=5) on 12 samples: test size 2, train ends 2, 4, 6, 8, 10
    f = G.time_series_folds(12, 5)
    assert f == [(0, 2, 2, 4), (0, 4, 4, 6), (0, 6, 6, 8), (0, 8, 8, 10), (0, 10, 10, 12)]
    f = G.time_series_folds(12, 3, gap=1, max_train_size=4)
    assert f == [(0, 2, 3, 6), (1, 5, 6, 9), (4, 8, 9, 12)]


def test_distribution_functions():
    from growthspark.functions import dist
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.2281388519649, abs=1e-9)
    assert dist.t_ppf(0.975, 1000) == pytest.approx(1.9623390808264, abs=1e-9)
    assert dist.t_ppf(0.975, 30) == pytest.approx(2.0422724563, abs=1e-8)
    # F(1, n) is t(n)^2; the two-sided t tail at the 97.5 % quantile is 5 %
    assert dist.f_sf(4.0, 1, 30) == pytest.approx(dist.t_sf_two_sided(2.0, 30), abs=1e-12)
    assert dist.t_sf_two_sided(2.0422724563, 30) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_cdf(dist.t_ppf(0.9, 7), 7) == pytest.approx(0.9, abs=1e-12)
