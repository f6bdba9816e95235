"""The weekly table without its write does the work of the columns that are read; predictions are made once per row and fit."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from growthspark.operators import gram as G
from growthspark.operators import models as M
from growthspark.operators import weekly as W
from growthspark.operators.metrics import regression_metrics
from growthspark.plans import q_features, q_models


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def days(spark):
    rows = [(f"c{i % 2}", dt.date(2024, 1, 1) + dt.timedelta(days=i), i % 3, i % 2, 1, 5 * i, 10 + i, i, i % 4, 100 + 7 * i, 20 + i, 1000 + i, i / 50,
             None if i % 6 == 0 else i / 9, i % 5 / 2, ["08:00", "12:30"][i % 2]) for i in range(40)]
    rows += rows[:2] + [(None, *rows[5][1:])]
    names = ("username date posts reels stories growth follows unfollows comments reach profile_visits followers engagement_rate roi_follows_per_hour "
             "avg_hashtag_count post_time").split()
    d = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, ["string", "date", *["long"] * 9, "long", *["double"] * 3, "string"])))
    return d.withColumns({c: F.lit(3).cast("long") for c in ("post_likes", "saves", "shares", "minutes_spent", "hashtags_used", "ads_posted")})


def test_unwritten_weekly_table_has_the_rows_of_the_written_one(spark):
    d = days(spark)
    a, b = W.weekly_feature_table(d), W.weekly_feature_table(d, checkpoint=False)
    assert a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_unread_weekly_columns_are_not_computed(spark, sf):
    narrow = plan(W.weekly_feature_table(days(spark), checkpoint=False).select("username", "week_start", "weekly_growth"))
    assert "mode(" not in narrow and "scalar-subquery" not in narrow
    assert "mode(" not in plan(q_features.dq12t(spark, sf)) and "/once-" not in "".join(q_features.dq12t(spark, sf).inputFiles())
    assert q_models.model_frame(spark, sf).columns == ["username", "week_start", *q_models.MODEL_FEATURES, "weekly_growth"]


def test_predictions_are_columns_of_the_exploded_rows(spark):
    d = spark.createDataFrame([(i, float(i), None if i == 7 else 2.0 * i + i % 3) for i in range(12)], "k int, x double, y double")
    fits = {n: G.Fit(["x"], [w], 1.0, [0.5], [2.0], 12, 0.0, 1.0) for n, w in (("a", 4.0), ("b", -1.0))}
    got = M.predicted(d, "y", fits, {"a": F.col("k") < 5, "b": F.col("k") >= 3})
    want = sorted(str((f, y, 1.0 + w * (x - 0.5) / 2.0)) for f, w, lo, hi in ((0, 4.0, 0, 5), (1, -1.0, 3, 12))
                  for k, x, y in map(tuple, d.collect()) if lo <= k < hi)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    row = regression_metrics(got, by=["_fid"], extra={"top": F.max("y_pred")}).where("_fid = 0").collect()[0]
    assert row["n"] == 5 and row["top"] == pytest.approx(1.0 + 4.0 * 3.5 / 2.0)
    assert M.scored_metrics(d, "y", fits)["b"]["n"] == 12
