"""Gram statistics: one Spark aggregate feeds every linear fit.

A linear model with p <= 13 features depends on the data only through
n, sum(v) and sum(v v') of v = (x, y): (p+2)(p+3)/2 numbers.  Spark computes
those sums once per *time segment* (a ``groupBy`` with map-side combine, a
few hundred bytes per segment in the shuffle); the driver adds segments up to
any expanding or sliding training window and solves p x p systems.  OLS
(minimum-norm via pseudo-inverse), ridge, lasso and elastic net (coordinate
descent), fold MSE/R2, F-tests, correlations and eigenvalues are all
functions of these sums, so hundreds of candidate fits cost no extra job.

Values are shifted by the global means before squaring (a cheap earlier
aggregate) so the sums stay well conditioned.

Time segments come from the sorted distinct dates (bounded by the calendar,
a few thousand values): fold borders become literal dates and the segment of
a row is ``sum(date >= border_k)`` -- an expression, no join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PINV_RCOND = 1e-10
PENALTIES_A_DECADE = 16   # steps of a penalty path
PATH_PASSES = 1000        # coordinate passes at a step that is only on the way


@dataclass
class Gram:
    names: list            # features..., target (last)
    n: float
    s: np.ndarray          # sum of (v - shift)
    m: np.ndarray          # sum of (v - shift)(v - shift)'
    shift: np.ndarray

    def __add__(self, o: "Gram") -> "Gram":
        return Gram(self.names, self.n + o.n, self.s + o.s, self.m + o.m, self.shift)

    @staticmethod
    def zero(names, shift) -> "Gram":
        k = len(names)
        return Gram(list(names), 0.0, np.zeros(k), np.zeros((k, k)), np.asarray(shift, float))

    def mean(self) -> np.ndarray:
        return self.shift + self.s / self.n

    def scatter(self) -> np.ndarray:
        """Sum of squares and cross products about the mean."""
        return self.m - np.outer(self.s, self.s) / self.n

    def subset(self, idx: list) -> "Gram":
        idx = list(idx)
        return Gram([self.names[i] for i in idx], self.n, self.s[idx], self.m[np.ix_(idx, idx)], self.shift[idx])


def _v(c: str, shift: float) -> Column:
    return F.col(c).cast("double") - F.lit(float(shift))


def global_means(df: DataFrame, names: list) -> np.ndarray:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).collect()[0]
    return np.array([row[f"m{i}"] or 0.0 for i in range(len(names))], float)


def gram_by(df: DataFrame, features: list, target: str, key: Column | str | None = None,
            shift: np.ndarray | None = None) -> dict:
    """{key value: Gram} from ONE aggregate (key None -> {None: Gram})."""
    names = list(features) + [target]
    if shift is None:
        shift = global_means(df, names)
    vs = [_v(c, shift[i]) for i, c in enumerate(names)]
    aggs = [F.sum(F.lit(1.0)).alias("n")]
    aggs += [F.sum(vs[i]).alias(f"s{i}") for i in range(len(names))]
    for i in range(len(names)):
        for j in range(i, len(names)):
            aggs.append(F.sum(vs[i] * vs[j]).alias(f"m{i}_{j}"))
    g = df.groupBy(key).agg(*aggs) if key is not None else df.agg(*aggs)
    out = {}
    for r in g.collect():
        k = r[0] if key is not None else None
        s = np.array([r[f"s{i}"] or 0.0 for i in range(len(names))])
        m = np.zeros((len(names), len(names)))
        for i in range(len(names)):
            for j in range(i, len(names)):
                m[i, j] = m[j, i] = r[f"m{i}_{j}"] or 0.0
        out[k] = Gram(names, float(r["n"] or 0.0), s, m, np.asarray(shift, float))
    return out


# cumulative probabilities of Poisson(1), until the tail is below a 53-bit uniform's resolution
def _poisson_steps() -> np.ndarray:
    below, term, k, out = 0.0, np.exp(-1.0), 0, []
    while below < 1 - 2.0 ** -53 and term >= 2.0 ** -54:
        below, k = below + term, k + 1
        out.append(below)
        term /= k
    return np.array(out)


POISSON_STEPS = _poisson_steps()
REPLICATES_AT_ONCE = 64   # replicates whose weights a task holds together


def poisson_weights(row_hash: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson(1) weight of every row (64-bit hash) in every replicate: rows x replicates.

    A counter-based generator: the weight depends on the hash and the replicate alone.
    """
    with np.errstate(over="ignore"):
        x = row_hash.astype(np.uint64)[:, None] + (replicates.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON_STEPS, (x >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


def bootstrap_sums(df: DataFrame, features: list, target: str, row_hash: Column, n_replicates: int, shift) -> DataFrame:
    """(replicate, place, value): every replicate's weighted Gram sums, laid out as ``gram_by`` numbers them.

    The rows are read once.  Per Arrow batch, the products of the columns times
    the weights of all replicates are one matrix product; a task sends back its
    sums only, so the shuffle does not grow with the rows.
    """
    names = list(features) + [target]
    shift = np.asarray(shift, float)
    upper = np.triu_indices(len(names))

    def run(batches):
        acc = np.zeros((n_replicates, 1 + len(names) + len(upper[0])))
        for batch in batches:
            hashed = batch.column(0).to_numpy(zero_copy_only=False)
            cols = [pc.fill_null(batch.column(i + 1), shift[i]).to_numpy(zero_copy_only=False) - shift[i] for i in range(len(names))]
            v = np.column_stack(cols)
            products = np.column_stack([np.ones(len(v)), v, v[:, upper[0]] * v[:, upper[1]]])
            for r in range(0, n_replicates, REPLICATES_AT_ONCE):
                some = np.arange(r, min(n_replicates, r + REPLICATES_AT_ONCE))
                acc[some] += poisson_weights(hashed, some).T @ products
        rep, place = np.indices(acc.shape)
        yield pa.RecordBatch.from_arrays([pa.array(rep.ravel().astype(np.int32)), pa.array(place.ravel().astype(np.int32)), pa.array(acc.ravel())],
                                         names=["replicate", "place", "value"])

    rows = df.select(row_hash.cast("long").alias("_hash"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)])
    return (rows.mapInArrow(run, "replicate int, place int, value double")
            .groupBy("replicate", "place").agg(F.sum("value").alias("value")))


def bootstrap_grams(df: DataFrame, features: list, target: str, row_hash: Column, n_replicates: int, shift) -> list:
    """The Gram of each bootstrap replicate (rows weighted by Poisson(1))."""
    names = list(features) + [target]
    k = len(names)
    sums = np.zeros((n_replicates, 1 + k + k * (k + 1) // 2))
    for r in bootstrap_sums(df, features, target, row_hash, n_replicates, shift).collect():
        sums[r["replicate"], r["place"]] = r["value"]
    out = []
    for row in sums:
        m = np.zeros((k, k))
        m[np.triu_indices(k)] = row[1 + k:]
        out.append(Gram(names, float(row[0]), row[1:1 + k].copy(), m + np.triu(m, 1).T, np.asarray(shift, float)))
    return out


def total(grams, names=None, shift=None) -> Gram:
    grams = list(grams)
    if not grams:
        return Gram.zero(names, shift)
    acc = grams[0]
    for g in grams[1:]:
        acc = acc + g
    return acc


# ---------------------------------------------------------------------------
# time segments and time-ordered splits
# ---------------------------------------------------------------------------
def distinct_dates(df: DataFrame, date_col: str = "date") -> list:
    """Sorted distinct dates (bounded by the calendar, not by the data size)."""
    return [r[0] for r in df.select(date_col).where(F.col(date_col).isNotNull()).distinct()
            .orderBy(date_col).collect()]


def time_series_folds(n: int, n_splits: int = 5, test_size: int | None = None, gap: int = 0,
                      max_train_size: int | None = None) -> list:
    """Expanding-window folds over n ordered positions: [(train_lo, train_hi, test_lo, test_hi)]."""
    t = test_size if test_size is not None else n // (n_splits + 1)
    if t <= 0 or n - gap - t * n_splits <= 0:
        raise ValueError(f"too few distinct dates ({n}) for {n_splits} splits")
    folds = []
    for test_start in range(n - n_splits * t, n, t):
        train_end = test_start - gap
        train_lo = train_end - max_train_size if max_train_size and max_train_size < train_end else 0
        folds.append((train_lo, train_end, test_start, test_start + t))
    return folds


@dataclass
class SegmentPlan:
    """Fold borders as dates; ``seg`` expression; fold ranges in segment ids."""
    borders: list                      # sorted border dates (positions > 0)
    folds: list                        # [(train_seg_lo, train_seg_hi, test_seg_lo, test_seg_hi)] half-open
    fold_positions: list = field(default_factory=list)
    dates: list = field(default_factory=list)

    def seg_expr(self, date_col: str = "date") -> Column:
        # one constant array, whatever the number of borders; a row without a date is in segment 0
        if not self.borders:
            return F.lit(0)
        passed = F.filter(F.array(*[F.lit(b) for b in self.borders]), lambda b: b <= F.col(date_col))
        return F.size(passed)


def segment_plan(dates: list, folds_pos: list) -> SegmentPlan:
    cuts = sorted({p for f in folds_pos for p in f if 0 < p < len(dates)})
    borders = [dates[p] for p in cuts]

    def seg_of(p):  # segment id of position p = number of cuts <= p
        return sum(1 for c in cuts if c <= p)

    folds = [(seg_of(a), seg_of(b - 1) + 1 if b > a else seg_of(a), seg_of(c), seg_of(d - 1) + 1)
             for a, b, c, d in folds_pos]
    return SegmentPlan(borders, folds, folds_pos, dates)


# ---------------------------------------------------------------------------
# solvers on Gram statistics
# ---------------------------------------------------------------------------
@dataclass
class Fit:
    features: list
    coef: np.ndarray        # on scaled features z = (x - center) / scale
    intercept: float
    center: np.ndarray
    scale: np.ndarray
    n: float
    sse: float
    sst: float

    @property
    def mse(self) -> float:
        return self.sse / self.n if self.n else float("nan")

    @property
    def r2(self) -> float:
        if self.sst == 0:
            return 1.0 if self.sse == 0 else 0.0
        return 1.0 - self.sse / self.sst

    def raw(self):
        """(intercept, coefficients) on the original feature scale."""
        b = self.coef / self.scale
        return self.intercept - float(np.dot(b, self.center)), b


def scaler_from(g: Gram):
    """StandardScaler on the Gram's rows: mean and population std (0 -> 1)."""
    p = len(g.names) - 1
    mu = g.mean()[:p]
    var = np.diag(g.scatter())[:p] / g.n
    sd = np.sqrt(np.maximum(var, 0.0))
    sd[sd == 0] = 1.0
    return mu, sd


def _soft(x, t):
    return np.sign(x) * max(abs(x) - t, 0.0)


def coordinate_descent(Szz, Szy, n, alpha, l1_ratio, tol=1e-9, max_iter=20000, w0=None):
    """sklearn's objective 1/(2n)||y-Zw||^2 + a r|w|_1 + a(1-r)/2|w|^2 on centred Gram.

    Cyclic updates on the p x p Gram (no data pass); stops when the largest
    coefficient change is below ``tol`` relative to the largest coefficient.
    ``w0`` warm-starts along an alpha path.  Where the features are linearly
    dependent (shares that add up to 1) and the penalty is weak, the updates
    hardly move along the dependence; then the solution is followed down from
    the penalty that leaves no coefficient.
    """
    l1, l2 = n * alpha * l1_ratio, n * alpha * (1.0 - l1_ratio)
    w, done = _descend(Szz, Szy, l1, l2, tol, max_iter, np.zeros(len(Szy)) if w0 is None else w0.copy())
    top = float(np.max(np.abs(Szy), initial=0.0))
    if not done and 0 < l1 < top:
        w = np.zeros(len(Szy))
        for t in np.geomspace(top, l1, 2 + PENALTIES_A_DECADE * int(np.ceil(np.log10(top / l1)))):
            w, done = _descend(Szz, Szy, t, l2 * t / l1, tol, max_iter if t == l1 else PATH_PASSES, w)
    if not done:
        raise ArithmeticError(f"coordinate descent did not converge in {max_iter} passes")
    return w


def _descend(Szz, Szy, l1, l2, tol, max_iter, w):
    """(coefficients, whether they are a solution) after ``max_iter`` passes at most from ``w``, which is updated."""
    diag = np.diag(Szz)
    for it in range(max_iter):
        wmax, dmax = 0.0, 0.0
        for j in range(len(Szy)):
            if diag[j] == 0:
                w[j] = 0.0
                continue
            rho = Szy[j] - Szz[j] @ w + diag[j] * w[j]
            new = _soft(rho, l1) / (diag[j] + l2)
            dmax = max(dmax, abs(new - w[j]))
            w[j] = new
            wmax = max(wmax, abs(new))
        if dmax <= tol * max(wmax, 1.0):
            return w, True
        if it % 25 == 24:
            exact = _active_set_solution(Szz, Szy, l1, l2, w)
            if exact is not None:
                return exact, True
    return w, False


def _active_set_solution(Szz, Szy, l1, l2, w):
    """Solve the optimality conditions exactly on the current active set and
    signs; return the solution if it satisfies all of them, else None."""
    act = np.flatnonzero(np.abs(w) > 0)
    if len(act) == 0:
        return None
    s = np.sign(w[act])
    A = Szz[np.ix_(act, act)] + l2 * np.eye(len(act))
    try:
        wa = np.linalg.solve(A, Szy[act] - l1 * s)
    except np.linalg.LinAlgError:
        return None
    if not np.all(np.sign(wa) == s):
        return None
    out = np.zeros_like(w)
    out[act] = wa
    grad = Szy - Szz @ out
    inactive = np.setdiff1d(np.arange(len(w)), act)
    if len(inactive) and np.any(np.abs(grad[inactive]) > l1 * (1 + 1e-9) + 1e-12):
        return None
    return out


def solve(g: Gram, model_type: str = "linear", alpha: float = 1.0, l1_ratio: float = 0.5,
          center=None, scale=None, w0=None) -> Fit:
    """Fit on the rows summarised by ``g`` with features scaled by (center, scale).

    linear: minimum-norm least squares (pseudo-inverse, relative cut-off 1e-10);
    ridge: (Z'Z + alpha I) w = Z'y; lasso / elasticnet: coordinate descent on
    sklearn's objective.  Intercept free (data centred).
    """
    p = len(g.names) - 1
    if center is None or scale is None:
        center, scale = scaler_from(g)
    S = g.scatter()
    D = 1.0 / scale
    Szz = S[:p, :p] * np.outer(D, D)
    Szy = S[:p, p] * D
    Syy = S[p, p]
    mt = model_type.lower()
    if mt in ("linear", "ols", "linear_regression"):
        w = np.linalg.pinv(Szz, rcond=PINV_RCOND, hermitian=True) @ Szy if p else np.zeros(0)
    elif mt == "ridge":
        w = np.linalg.solve(Szz + alpha * np.eye(p), Szy)
    elif mt == "lasso":
        w = coordinate_descent(Szz, Szy, g.n, alpha, 1.0, w0=w0)
    elif mt in ("elasticnet", "elastic_net"):
        w = coordinate_descent(Szz, Szy, g.n, alpha, l1_ratio, w0=w0)
    else:
        raise ValueError(f"unknown model type {model_type}")
    mean = g.mean()
    zbar = (mean[:p] - center) / scale
    intercept = float(mean[p] - zbar @ w)
    sse = float(Syy - 2 * w @ Szy + w @ Szz @ w)
    return Fit(list(g.names[:p]), w, intercept, np.asarray(center), np.asarray(scale), g.n, max(sse, 0.0), Syy)


def sse_on(g: Gram, fit: Fit) -> tuple[float, float]:
    """(SSE, SST) of ``fit`` on the rows summarised by ``g`` (e.g. a test block)."""
    p = len(g.names) - 1
    b0, b = fit.raw()
    # residual r = y - b0 - x b ; with v = (x, y) shifted by c: r = (y - cy) - (x - cx) b + (cy - b0 - cx b)
    c = g.shift
    k = c[p] - b0 - c[:p] @ b
    a = np.append(-b, 1.0)          # r = a . (v - c) + k
    sse = float(a @ g.m @ a + 2 * k * (a @ g.s) + k * k * g.n)
    sst = float(g.scatter()[p, p])
    return max(sse, 0.0), sst


def predict_expr(fit: Fit, medians: dict | None = None) -> Column:
    """y_hat as a Column: intercept + sum(coef * (x - center) / scale); codegen, no Python."""
    e = F.lit(float(fit.intercept))
    for j, c in enumerate(fit.features):
        x = F.col(c).cast("double")
        if medians and medians.get(c) is not None:
            x = F.coalesce(x, F.lit(float(medians[c])))
        e = e + F.lit(float(fit.coef[j])) * ((x - F.lit(float(fit.center[j]))) / F.lit(float(fit.scale[j])))
    return e


def correlation(g: Gram) -> np.ndarray:
    S = g.scatter()
    d = np.sqrt(np.maximum(np.diag(S), 0.0))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = S / np.outer(d, d)
    r[~np.isfinite(r)] = np.nan
    return r
