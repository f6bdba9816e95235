"""Trap tests (T1-T11) and scalar functions on hand-made frames."""

import math

from pyspark.sql import functions as F

from growthspark.functions import exprs as X


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_safe_divide_zero_and_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0), (None, 1.0), (1.0, None)], "n double, d double")
    out = [r[0] for r in df.select(X.safe_divide("n", "d").alias("q")).collect()]
    assert out == [0.0, 2.0, None, None]


def test_pct_change(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (-10.0, 5.0)], "o double, n double")
    out = [r[0] for r in df.select(X.pct_change("o", "n")).collect()]
    assert out[0] == 0.0 and math.isinf(out[1]) and out[2] == 150.0


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-3,), (50,), (7,)], "x long")
    assert [r[0] for r in df.select(X.clip("x", 0, 20)).collect()] == [None, 0, 20, 7]


def test_cut_right_closed_zero_is_null(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (3.5,), (100.0,)], "x double")
    out = [r[0] for r in df.select(X.cut("x", [0, 3, 7, 14, float("inf")], ["Low", "Medium", "High", "Very High"])).collect()]
    assert out == [None, "Low", "Medium", "Very High"]


def test_argmax_ties_first(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.0), (0.0, 0.0, 0.0), (0.1, 0.2, 0.7)], "a double, b double, c double")
    assert [r[0] for r in df.select(X.row_argmax(["a", "b", "c"])).collect()] == ["a", "a", "c"]


def test_entropy(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (0.5, 0.5, 0.0), (1 / 3, 1 / 3, 1 / 3)], "a double, b double, c double")
    out = [r[0] for r in df.select(X.share_entropy(["a", "b", "c"])).collect()]
    assert out[0] == 0.0 and abs(out[1] - 1.0) < 1e-12 and abs(out[2] - 1.0) < 1e-12


def test_round_half_even_matches_numpy(spark):
    import numpy as np
    vals = [2.5, 3.5, -2.5, 0.125, 2.0196875, 1.0000005]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(X.round_half_even("x", 6)).collect()]
    assert got == [float(np.round(v, 6)) for v in vals]
    got0 = [r[0] for r in df.select(X.round_to_long("x")).collect()]
    assert got0 == [int(np.round(v)) for v in vals]


def test_format_large_numbers_like_python(spark):
    vals = [1250.0, 1450.0, 999.0, -1250.0, 2_500_000.0, 7.25e9, 12.0]

    def py(v):
        if abs(v) >= 1e9:
            return f"{v / 1e9:.1f}B"
        if abs(v) >= 1e6:
            return f"{v / 1e6:.1f}M"
        if abs(v) >= 1e3:
            return f"{v / 1e3:.1f}K"
        return f"{v:.1f}"
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert [r[0] for r in df.select(X.format_large_number("x")).collect()] == [py(v) for v in vals]


def test_parse_date_formats_in_order(spark):
    df = spark.createDataFrame([("2024-03-05",), ("05-03-2024",), ("03/05/2024",), ("25/03/2024",),
                                ("2024-03-05 10:11:12",), ("bad",)], "s string")
    out = [r[0] for r in df.select(F.date_format(X.parse_date_string("s"), "yyyy-MM-dd")).collect()]
    assert out == ["2024-03-05", "2024-03-05", "2024-03-05", "2024-03-25", "2024-03-05", None]


def test_week_start_monday_and_iso_week(spark):
    df = spark.createDataFrame([("2023-01-01",), ("2024-01-01",)], "d string").select(F.to_date("d").alias("d"))
    out = df.select(X.week_start("d").cast("string"), F.weekofyear("d")).collect()
    assert (out[0][0], out[0][1]) == ("2022-12-26", 52)
    assert (out[1][0], out[1][1]) == ("2024-01-01", 1)


def test_standardize_time(spark):
    df = spark.createDataFrame([(None,), ("0830",), ("08:30:00",), ("21:00",)], "t string")
    assert [r[0] for r in df.select(X.standardize_time("t")).collect()] == ["12:00", "12:00", "08:30", "21:00"]


def test_roi_without_time_uses_one_hour(spark):
    df = spark.createDataFrame([(6, 0), (6, 120)], "follows long, minutes_spent long")
    assert [r[0] for r in df.select(X.roi_follows_per_hour()).collect()] == [6.0, 3.0]
