"""Lasso and elastic net on linearly dependent features: a weak penalty without a warm start."""

import numpy as np
import pytest

from growthspark.operators import gram as G
from growthspark.operators import models as M


def shares_gram(scale=1.0):
    """Shares of three counts add up to 1; the sums of ``scale`` copies of the rows."""
    rng = np.random.default_rng(5)
    counts = rng.poisson(0.6, (4000, 3)) + np.eye(3)[rng.integers(0, 3, 4000)]
    share = counts / counts.sum(1, keepdims=True)
    minutes = counts @ np.array([45.0, 120.0, 8.0])
    x = np.column_stack([counts.sum(1), share, minutes, rng.integers(1, 13, 4000)])
    y = 900 * share[:, 0] + 300 * share[:, 1] - 40 * counts.sum(1) + rng.normal(0, 1200, 4000)
    v = np.column_stack([x, y])
    names = ["freq", "a", "b", "c", "minutes", "month", "y"]
    shift = v.mean(0)
    return G.Gram(names, len(v) * scale, (v - shift).sum(0) * scale, (v - shift).T @ (v - shift) * scale, shift)


@pytest.mark.parametrize("scale", [1.0, 10_000.0])
@pytest.mark.parametrize("l1_ratio", [0.9, 1.0])
def test_weak_penalty_is_solved_without_a_warm_start(scale, l1_ratio):
    g = shares_gram(scale)
    _, sd = G.scaler_from(g)
    s = g.scatter()
    szz, szy = s[:-1, :-1] / np.outer(sd, sd), s[:-1, -1] / sd
    for alpha in M.alpha_grid()[:8]:
        w = G.solve(g, "elasticnet", alpha, l1_ratio).coef
        l1, l2 = g.n * alpha * l1_ratio, g.n * alpha * (1 - l1_ratio)
        grad = szy - szz @ w - l2 * w
        off = np.where(w != 0, np.abs(grad - l1 * np.sign(w)), np.maximum(np.abs(grad) - l1, 0.0))
        assert off.max() <= 1e-2 * l1
