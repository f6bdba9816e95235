import math

import numpy as np
import pytest

from growthspark.llm import topk_search
from tests.llm.helpers import collect


def brute(rows, k=5, every=50):
    ints = []
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            ints.append((i, [min(max(math.floor(256 * float(x)), -2 ** 63 + 1024), 2 ** 63 - 1024) for x in v]))
    out = []
    for n, (i, v) in enumerate(ints):
        if i is None or math.fmod(i, every):
            continue
        scores = [(-min(max(sum(a * b for a, b in zip(v, w)), -2 ** 63), 2 ** 63 - 1), j is None, j or 0, j)
                  for m, (j, w) in enumerate(ints) if m != n and len(w) == len(v)]
        out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def search(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, 2, b"x") for i, v in rows], "vec_id long, embedding array<double>, id int, score int, ints binary")
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collect(topk_search.top_k(df, **how))), key=str)


def cloud(seed, n=400, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:160] = x[100]                                         # more copies than are asked for
    x[200:260] = x[200] + rng.normal(scale=1e-3, size=(60, dim))  # near copies in the same cells
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(None, x[100].tolist()), (None, x[3].tolist()), (150, x[150].tolist()), (150, x[150].tolist()), (50, x[7].tolist()), (-50, x[9].tolist()),
             (900, None), (950, []), (1000, [None] * dim), (1050, [float("nan")] * dim), (1100, [float("inf")] * dim), (1150, [0.0] * dim),
             (1200, [1.0, 2.0]), (1250, [2.0]), (1251, [-3.0])]
    return rows


@pytest.mark.parametrize(("seed", "block_bytes", "first_wave"), [(1, 1 << 20, 2), (2, 400, 1)])
def test_results_match_brute_force(spark, seed, block_bytes, first_wave):
    rows = cloud(seed)
    assert search(spark, rows, block_bytes=block_bytes, first_wave=first_wave) == brute(rows)


def test_large_components_and_empty_table(spark):
    rows = [(0, [1e6, -2e5]), (1, [3e7, 4e-3]), (2, [1e300, 1.0]), (3, [-1e300, 5.0]), (50, [123456.789, 0.5])]
    assert search(spark, rows) == brute(rows)
    assert search(spark, []) == []
    assert search(spark, [(1, [1.0, 2.0])]) == []


@pytest.mark.parametrize("scale", [1.0, 90.0, 30000.0])
def test_bounds_hold(scale):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(300, 40)) * scale)
    q = np.floor(rng.normal(size=(20, 40)) * scale)
    low, high = topk_search.bounds(q, *topk_search.approximate(x))
    exact = q @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < exact.std()  # and they tell something
