"""FS8: weighted sums of all replicates in one pass over the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from growthspark.operators import gram as G
from growthspark.operators import select as S
from growthspark.plans.q_models import model_frame


def table(spark, n=500):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    x[:, 2] = 5 * x[:, 0] + rng.normal(size=n)
    rows = [(i, float(a), None if i % 50 == 7 else float(b), float(y)) for i, (a, b, y) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double").repartition(5), rows


def test_sums_of_each_replicate_equal_the_weighted_rows(spark):
    df, rows = table(spark)
    key = F.xxhash64(F.lit(3), F.col("id"))
    hashed = {r["id"]: r["h"] for r in df.select("id", key.alias("h")).collect()}
    reps = G.REPLICATES_AT_ONCE + 3  # more than one block of replicates
    shift = [0.1, -0.2, 0.3]
    got = G.bootstrap_grams(df, ["a", "b"], "y", key, reps, shift)
    w = G.poisson_weights(np.array([hashed[i] for i, *_ in rows]), np.arange(reps))
    v = np.array([[a - 0.1, 0.0 if b is None else b + 0.2, y - 0.3] for _, a, b, y in rows])
    for r in range(reps):
        assert got[r].n == pytest.approx(w[:, r].sum())
        assert np.allclose(got[r].s, w[:, r] @ v) and np.allclose(got[r].m, (v * w[:, [r]]).T @ v)


def test_weights_are_poisson_and_differ_between_replicates():
    w = G.poisson_weights(np.arange(200_000) * 7919 - 5, np.arange(3))
    share = [np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6]
    for r in range(3):
        assert np.allclose([(w[:, r] == k).mean() for k in range(4)], share, atol=0.005)
    assert abs(np.corrcoef(w.T) - np.eye(3)).max() < 0.01


def test_rows_are_not_multiplied(spark):
    df, _ = table(spark)
    plan = G.bootstrap_sums(df, ["a", "b"], "y", F.xxhash64("id"), 40, [0.0] * 3)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Expand" not in plan and "MapInArrow" in plan
    assert G.bootstrap_grams(df.limit(0), ["a", "b"], "y", F.xxhash64("id"), 2, [0.0] * 3)[1].n == 0


def test_strong_feature_is_always_selected(spark, sf):
    df, _ = table(spark)
    daily = df.select(F.concat(F.lit("u"), F.col("id") % 4).alias("username"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"), "a", "b", "y")
    sums = G.bootstrap_grams(daily, ["a", "b"], "y", F.xxhash64("username", "date"), 20, [0.0] * 3)
    assert all(abs(G.correlation(g)[0, 2]) > 0.9 > abs(G.correlation(g)[1, 2]) for g in sums)
    r = S.feature_stability_analysis(model_frame(spark, sf), "univariate", 6, 5)
    assert sum(x["selection_count"] for x in r["feature_stability"]) == 6 * 5 and 0 < r["mean_jaccard"] <= 1
