"""Distribution functions without scipy (driver-side scalars).

Normal: ``statistics.NormalDist``.  Student t and F: the regularised
incomplete beta function evaluated by its continued fraction (modified
Lentz), the textbook method; quantiles by bisection on the CDF.
"""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

from numpy.polynomial import chebyshev
from pyspark.sql import functions as F

_N = NormalDist()


def norm_cdf(x: float) -> float:
    return _N.cdf(x)


def norm_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def _betacf(a: float, b: float, x: float) -> float:
    tiny, eps = 1e-300, 1e-15
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    tail = 0.5 * betainc(df / 2.0, 0.5, x)
    return 1.0 - tail if t > 0 else tail


def t_sf_two_sided(t: float, df: float) -> float:
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    if not 0.0 < p < 1.0:
        raise ValueError("p must be in (0, 1)")
    if p == 0.5:
        return 0.0
    lo, hi = -1.0, 1.0
    while t_cdf(lo, df) > p:
        lo *= 2.0
    while t_cdf(hi, df) < p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, df) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-13 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F(d1, d2) distribution."""
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf_2(x: float) -> float:
    """Survival of chi-square with 2 degrees of freedom (Jarque-Bera p-value)."""
    return math.exp(-x / 2.0)


def critical_value(level: float, df_resid: int | None) -> float:
    """Two-sided critical value: t if residual degrees of freedom > 0, else normal."""
    q = (1.0 + level) / 2.0
    if df_resid is not None and df_resid > 0:
        return t_ppf(q, df_resid)
    return norm_ppf(q)


# ---------------------------------------------------------------------------
# normal log-tail as a Column (no Python worker)
# ---------------------------------------------------------------------------
_MIDDLE = 3.75  # x where the variable of the series is 0
_TERMS = 24


def _scaled_erfc(x: float) -> float:
    """exp(x^2) erfc(x), x >= 0; by its asymptotic series where erfc is too small a number."""
    if x < 20:
        return math.exp(x * x) * math.erfc(x)
    term, total, k = 1.0, 1.0, 0
    while k < 12:
        k += 1
        term *= -(2 * k - 1) / (2 * x * x)
        total += term
    return total / (x * math.sqrt(math.pi))


@cache
def _tail_series() -> tuple:
    """Chebyshev coefficients of (1 + 2x) exp(x^2) erfc(x) in t = (x - m) / (x + m): smooth on [-1, 1)."""
    n = 64
    nodes = [math.cos(math.pi * (k + 0.5) / n) for k in range(n)]
    values = [(1 + 2 * x) * _scaled_erfc(x) for x in (_MIDDLE * (1 + t) / (1 - t) for t in nodes)]
    coef = [2.0 / n * sum(v * math.cos(math.pi * j * (k + 0.5) / n) for k, v in enumerate(values)) for j in range(_TERMS)]
    return (coef[0] / 2, *coef[1:])


def log_lower_tail(df, z: str, name: str):
    """``df`` with ``name`` = ln Phi(-|z|): accurate far out, where Phi itself is 0; built-in functions only."""
    x = F.abs(F.col(z)) / F.lit(math.sqrt(2.0))
    step = df.withColumn("_x", x).withColumn("_t", (F.col("_x") - _MIDDLE) / (F.col("_x") + _MIDDLE))
    powers = chebyshev.cheb2poly(_tail_series())  # the terms fall fast enough for Horner's rule
    series = f"{float(powers[-1])!r}D"
    for c in reversed(powers[:-1].tolist()):
        series = f"({series} * _t + {c!r}D)"
    scaled = F.expr(series) / (1 + 2 * F.col("_x"))
    return step.withColumn(name, F.log(scaled / 2) - F.col("_x") * F.col("_x")).drop("_x", "_t")
