"""Numpy twins on the rows themselves of FS2, FS5, FS7 and DG3 (the engine works on sums)."""

import numpy as np
import pytest

from growthspark.operators import diagnostics as D
from growthspark.operators import models as M
from growthspark.operators import select as S

NAMES = ["a", "b", "c", "d", "e", "f", "g"]


@pytest.fixture(scope="module")
def data(spark):
    """Seven features, three of them of use, 40 dates of two creators."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 7)) * [1, 5, 0.2, 1, 3, 1, 1] + [0, 10, 0, -4, 0, 0, 2]
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + 4 * x[:, 2] + 0.05 * x[:, 4] + rng.normal(size=80)
    dates = np.repeat(np.datetime64("2024-01-01") + 7 * np.arange(40), 2)
    rows = [(f"u{i % 2}", d.item(), *map(float, r), float(t)) for i, (d, r, t) in enumerate(zip(dates, x, y))]
    df = spark.createDataFrame(rows, "username string, date date, " + ", ".join(f"{n} double" for n in NAMES) + ", growth double")
    return df, x, y


def design(df, n_splits):
    return M.build_design(df, NAMES, "growth", n_splits=n_splits)


def coefficients(x, y, center, scale, alpha):
    """Ridge (alpha 0: least squares) on scaled rows: weights and intercept."""
    z = (x - center) / scale
    zc, yc = z - z.mean(0), y - y.mean()
    w = np.linalg.solve(zc.T @ zc + alpha * np.eye(z.shape[1]), zc.T @ yc)
    return w, y.mean() - z.mean(0) @ w


def eliminate(x, y, k, alpha):
    """Features dropped by the smallest weight, first dropped first, down to k."""
    center, scale, left, gone = x.mean(0), x.std(0), list(range(x.shape[1])), []
    while len(left) > k:
        w, _ = coefficients(x[:, left], y, center[left], scale[left], alpha)
        gone.append(left.pop(int(np.argmin(np.abs(w)))))
    return left, gone


@pytest.mark.parametrize("k", [1, 3, 6])
def test_fs2_recursive_elimination(data, k):
    df, x, y = data
    left, gone = eliminate(x, y, k, 0.0)
    picked, ranking = S.recursive_elimination(design(df, None).total, k)
    assert picked == [NAMES[j] for j in left]
    assert ranking == {**{NAMES[j]: 1 for j in left}, **{NAMES[j]: len(gone) + 1 - i for i, j in enumerate(gone)}}


def test_fs5_elimination_with_folds(data):
    df, x, y = data
    des, least = design(df, 4), 2
    got = S.rfe_cv(des, "ridge", least, 1.0)
    scores = []
    for lo, hi, first, last in des.plan.fold_positions:  # positions of dates; two rows each
        tr, te = slice(2 * lo, 2 * hi), slice(2 * first, 2 * last)
        center, scale = x[tr].mean(0), x[tr].std(0)
        by_size = {}
        for size in range(7, least - 1, -1):
            left, _ = eliminate(x[tr], y[tr], size, 1.0)
            w, b = coefficients(x[tr][:, left], y[tr], center[left], scale[left], 1.0)
            by_size[size] = -np.mean((y[te] - ((x[te][:, left] - center[left]) / scale[left]) @ w - b) ** 2)
        scores.append(by_size)
    mean = {size: np.mean([s[size] for s in scores]) for size in scores[0]}
    assert got["cv_scores"] == pytest.approx(mean)
    best = max(mean, key=mean.get)
    assert got["n_features_selected"] == best
    assert got["selected_features"] == [NAMES[j] for j in eliminate(x, y, best, 1.0)[0]]


def test_fs7_methods_report_their_own_selection(data):
    df, x, y = data
    des = design(df, None)
    r = np.abs([np.corrcoef(c, y)[0, 1] for c in x.T])
    strongest = [NAMES[j] for j in np.argsort(-r)[:3]]
    assert S.select_features(des, "univariate", 3) == strongest
    assert S.select_features(des, "recursive", 3) == [NAMES[j] for j in eliminate(x, y, 3, 0.0)[0]]
    varied = [NAMES[j] for j in np.argsort(-r) if x[:, j].var() > 0.01][:3]  # no two features are alike
    assert S.select_features(des, "filter", 3) == varied


@pytest.mark.parametrize(("bend", "tilt"), [(0.0, 0.0), (0.3, 0.0), (0.001, 2.0)])
def test_dg3_linearity(spark, bend, tilt):
    rng = np.random.default_rng(2)
    p = rng.normal(50, 8, 300)
    e = bend * (p - 45) ** 2 + tilt * p + rng.normal(size=300)
    got = D.linearity(spark.createDataFrame([(float(a + b), float(a)) for a, b in zip(p, e)], "y_true double, y_pred double"))
    assert got["correlation_with_fitted"] == pytest.approx(np.corrcoef(p, e)[0, 1])
    quad = abs(np.polyfit(p - p.mean(), e, 2)[0])
    assert got["quadratic_coefficient"] == pytest.approx(quad, rel=1e-6, abs=1e-9)
    assert got["passed"] is bool(abs(np.corrcoef(p, e)[0, 1]) < 0.1 and quad < 0.01)
