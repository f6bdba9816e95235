"""Inputs of several statistics passes are built once: one shuffle, one scan, one written table."""

import datetime as dt

from pyspark.sql import functions as F

from growthspark.operators import clean as CL
from growthspark.operators import quality as Q
from growthspark.operators import weekly as W
from growthspark.session import write_once
from growthspark.sources import fixtures as FX


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def from_tables(df):
    files = df.inputFiles()
    return bool(files) and all("/once-" in f for f in files)


def days(spark, n=40):
    rows = [(f"supp_{i % 3}", dt.date(2024, 1, 1) + dt.timedelta(days=i), i, i * 7 % 11 or None, None if i % 5 == 0 else i / 10,
             None if i % 7 == 0 else "08:00") for i in range(n)]
    return spark.createDataFrame(rows, "username string, date date, followers long, posts long, engagement_rate double, post_time string")


def test_written_table_keeps_rows_and_types(spark):
    d = days(spark).withColumn("nan", F.lit(float("nan")))
    w = write_once(d)
    assert w.dtypes == d.dtypes and sorted(map(str, w.collect())) == sorted(map(str, d.collect()))
    assert write_once(d.where("false")).count() == 0


def test_daily_metrics_and_weeks_take_one_shuffle(spark, sf):
    d = FX.daily_metrics(spark, sf)
    assert shuffles(d) == 1
    assert shuffles(W.create_weekly_features(d)) == 1


def test_damaged_days_take_one_scan_and_hold_the_copies(spark, sf):
    d = FX.daily_dirty(spark, sf)
    assert scans(d) == 1
    h = F.datediff("date", F.lit("1995-01-01").cast("date")) + F.regexp_extract("username", r"(\d+)$", 1).cast("long")
    f1 = FX.daily_metrics(spark, sf).withColumn("h", h)
    exact, keyed = f1.where("h % 41 = 0").count(), f1.where("h % 43 = 0").count()
    assert d.count() == f1.count() + exact + keyed and d.where("seq = 1").count() == keyed


def test_damaged_days_are_deduplicated_without_a_shuffle(spark, sf):
    assert shuffles(CL.dedup_keys(CL.fix_data_types(FX.daily_dirty(spark, sf).drop("date").withColumn("date", F.lit("01-01-2024")))[0])) == 1


def test_statistics_steps_read_a_written_table(spark):
    d = days(spark)
    assert from_tables(CL.handle_missing_values(d))
    for action in ("cap", "transform", "remove"):
        assert from_tables(CL.handle_outliers(d, "iqr", 3.0, action)[0])
    assert from_tables(Q.validate_data_integrity(d))
    full = d.withColumns({c: F.lit(1).cast("long") for c in ("reels", "stories", "growth", "follows", "unfollows", "reach", "post_likes", "comments",
                                                             "saves", "shares", "minutes_spent", "profile_visits")}).withColumn("roi_follows_per_hour", F.lit(1.0))
    assert from_tables(W.weekly_feature_table(full))


def test_partials_of_a_week_are_merged_in_one_shuffle(spark):
    full = days(spark).withColumns({c: F.lit(1).cast("long") for c in ("reels", "stories", "growth", "follows", "unfollows", "reach")})
    parts = write_once(W.weekly_partials(full))
    assert shuffles(W.finish_weekly(parts)) == 1
