"""CL11: sequential removal from a mergeable summary against removing column by column."""

import numpy as np
import pytest

from growthspark.operators import clean as CL


def naive(data, cols, t=3.0):
    keep = np.ones(len(next(iter(data.values()))), bool)
    for c in cols:
        x = data[c][keep]
        x = x[~np.isnan(x)]
        if len(x):
            q1, q3 = np.percentile(x, [25, 75])
            keep &= ~((data[c] < q1 - t * (q3 - q1)) | (data[c] > q3 + t * (q3 - q1)))
    return keep


@pytest.mark.parametrize("margin", [0.05, 0.001])  # the second one draws its brackets anew
def test_removal_matches_column_by_column(spark, monkeypatch, margin):
    monkeypatch.setattr(CL, "MARGIN", margin)
    rng = np.random.default_rng(8)
    n = 500
    data = {
        "reach": rng.standard_cauchy(n) * 10,
        "posts_": np.where(rng.random(n) < 0.6, 4.0, rng.integers(0, 60, n)),     # one value holds most rows
        "growth": np.where(rng.random(n) < 0.2, np.nan, rng.standard_cauchy(n)),
        "saves": np.full(n, np.nan),
        "shares": rng.integers(0, 5, n).astype(float),
    }
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(zip(*data.values()))]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in data))
    out, removed = CL.handle_outliers(df, "iqr", 3.0, "remove", cols=list(data))
    keep = naive(data, list(data))
    assert sorted(r["id"] for r in out.collect()) == np.flatnonzero(keep).tolist()
    assert removed == n - keep.sum() > 0


def test_whole_table_is_scanned_a_fixed_number_of_times(spark, monkeypatch):
    steps = []
    cells = CL.value_cells
    monkeypatch.setattr(CL, "value_cells", lambda df, cols, brackets: (steps.append(len(cols)), cells(df, cols, brackets))[1])
    df = spark.range(400).selectExpr("cast(id % 37 as double) a", "cast(id % 11 as double) b", "cast(pow(id % 100, 4) as double) c")
    CL.handle_outliers(df, "iqr", 3.0, "remove", cols=["a", "b", "c"])
    assert steps == [3, 1, 1, 1]  # all columns once over the safe rows, then each over the suspects
