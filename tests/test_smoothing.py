"""CL17: follower smoothing as a stream of batches."""

import math
import time

import numpy as np
import pytest

from growthspark.operators import clean as CL


def one_by_one(series):
    out, prev = [], None
    for cur in series:
        if prev is not None and cur is not None and abs(cur - prev) > 50_000:
            cur = prev + math.copysign(1, cur - prev) * min(10_000, prev * 0.1)
        out.append(cur)
        prev = cur
    return out


@pytest.mark.parametrize("cut", [1, 3, 1000])
def test_batches_carry_the_state(cut):
    rng = np.random.default_rng(cut)
    series = {k: [None if rng.random() < 0.1 else float(rng.integers(0, 10) * 30_000) for _ in range(40)] for k in ("a", "b", None)}
    keys = [k for k, v in series.items() for _ in v]
    values = np.array([math.nan if x is None else x for v in series.values() for x in v])
    state, got = [object(), math.nan], []
    for i in range(0, len(keys), cut):
        got += CL.smooth_series(keys[i:i + cut], values[i:i + cut], state).tolist()
    want = [x for v in series.values() for x in one_by_one(v)]
    assert [None if math.isnan(x) else x for x in got] == want


def test_linear_time_on_a_long_history():
    n = 1_000_000
    values = np.where(np.arange(n) % 2 == 0, 1e6, 2e6)  # every day a jump
    began = time.time()
    CL.smooth_series(["a"] * n, values, [object(), math.nan])
    assert time.time() - began < 20


def test_frame_keeps_rows_types_and_missing_dates(spark):
    rows = [("a", "2024-01-01", 100_000), ("a", "2024-01-02", 300_000), ("a", None, 111_000), ("a", "2024-01-03", None), (None, "2024-01-01", 5), ("a", "2024-01-04", 900_000)]
    df = spark.createDataFrame(rows, "username string, date string, followers long").selectExpr("username", "to_date(date) AS date", "followers", "'x' AS note")
    got = {(r["username"], str(r["date"])): r["followers"] for r in CL.smooth_follower_jumps(df).collect()}
    assert got == {("a", "2024-01-01"): 100_000, ("a", "2024-01-02"): 110_000, ("a", "2024-01-03"): None, ("a", "2024-01-04"): 900_000,
                   ("a", "None"): 910_000 - 0, (None, "2024-01-01"): 5} | {("a", "None"): 890_000}
