"""Quadratic interpolating spline of one series (CL6, degree 2)."""

from __future__ import annotations

import numpy as np

LEAST_POINTS = 3  # known values that determine a quadratic


def _basis(z: np.ndarray, s, u):
    """The three quadratic B-splines that do not vanish on span s, at u; the ends of z count threefold."""
    last = len(z) - 1
    left, right = z[s], z[s + 1]
    first = (right - u) ** 2 / ((right - z[np.maximum(s - 1, 0)]) * (right - left))
    third = (u - left) ** 2 / ((z[np.minimum(s + 2, last)] - left) * (right - left))
    return first, 1.0 - first - third, third


def quadratic_spline(x, y, at) -> np.ndarray:
    """Values at ``at`` of the smooth piecewise quadratic through (x, y), NaN outside of [x[0], x[-1]].

    ``x`` rises strictly and has three points or more.  The pieces meet midway
    between inner points, the first and last interval belonging to the pieces
    next to them, so there are as many conditions as coefficients.  The
    collocation matrix is tridiagonal and totally positive: elimination without
    pivoting is stable, and the work is linear.
    """
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    n = len(x)
    if n < LEAST_POINTS:
        raise ValueError("a quadratic spline needs three points")
    z = np.concatenate((x[:1], (x[1:-2] + x[2:-1]) / 2, x[-1:]))
    lower, diagonal, upper = _basis(z, np.arange(n - 2), x[1:-1])
    coef, gain = np.empty(n), np.zeros(n)
    coef[0], coef[-1] = y[0], y[-1]
    for i in range(1, n - 1):
        pivot = diagonal[i - 1] - lower[i - 1] * gain[i - 1]
        gain[i] = upper[i - 1] / pivot
        coef[i] = (y[i] - lower[i - 1] * coef[i - 1]) / pivot
    for i in range(n - 2, 0, -1):
        coef[i] -= gain[i] * coef[i + 1]
    s = np.clip(np.searchsorted(z, at, side="right") - 1, 0, n - 3)
    a, b, c = _basis(z, s, at)
    out = a * coef[s] + b * coef[s + 1] + c * coef[s + 2]
    return np.where((at < x[0]) | (at > x[-1]), np.nan, out)
