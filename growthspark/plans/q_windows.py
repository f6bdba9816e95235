"""Registered queries: creator-history windows WN1-WN8, WN11."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import weekly as W
from ..operators import windows as WN
from ..sources import fixtures as FX
from .registry import register
from .sqlparts import q, weekly_ctes

KEY = ["username", "date"]
W7 = "WINDOW w AS (PARTITION BY username ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


def _roll(c, agg, n="w", size=7, cast=None):
    inner = f"{agg}({c}) OVER {n}"
    if cast:
        inner = f"CAST({inner} AS {cast})"
    return f"CASE WHEN COUNT({c}) OVER {n} = {size} THEN {inner} END"


@register("wn1", doubles=("reach_rolling_7d", "posts_rolling_7d", "stories_rolling_7d"),
          sql=q(f"SELECT username, date, {_roll('reach', 'AVG')} AS reach_rolling_7d, "
                f"{_roll('growth', 'SUM', cast='BIGINT')} AS growth_rolling_7d, "
                f"{_roll('posts', 'STDDEV_SAMP')} AS posts_rolling_7d, "
                f"{_roll('stories', 'VAR_SAMP')} AS stories_rolling_7d FROM f2 {W7}", "f2"))
def wn1(spark, sf):
    """WN1 rolling_aggregation over 7 rows per creator (F2 dense days)."""
    d = FX.daily_dense(spark, sf)
    out = WN.rolling_aggregation(d, 7, {"reach": "mean", "growth": "sum", "posts": "std", "stories": "var"})
    return out.select(*KEY, "reach_rolling_7d", "growth_rolling_7d", "posts_rolling_7d", "stories_rolling_7d")


WN2_COLS = ["daily_posting_frequency_7d_avg", "daily_posting_frequency_7d_std", "daily_posting_frequency_7d_sum",
            "engagement_rate_7d_avg", "engagement_rate_7d_std", "growth_7d_avg", "growth_7d_sum",
            "followers_7d_avg", "reach_7d_sum", "reach_7d_avg"]


@register("wn2", doubles=tuple(c for c in WN2_COLS if not c.endswith("_sum")),
          sql=q(f"SELECT username, date, {_roll('dpf', 'AVG')} AS daily_posting_frequency_7d_avg, "
                f"{_roll('dpf', 'STDDEV_SAMP')} AS daily_posting_frequency_7d_std, "
                f"{_roll('dpf', 'SUM', cast='BIGINT')} AS daily_posting_frequency_7d_sum, "
                f"{_roll('engagement_rate', 'AVG')} AS engagement_rate_7d_avg, "
                f"{_roll('engagement_rate', 'STDDEV_SAMP')} AS engagement_rate_7d_std, "
                f"{_roll('growth', 'AVG')} AS growth_7d_avg, {_roll('growth', 'SUM', cast='BIGINT')} AS growth_7d_sum, "
                f"{_roll('followers', 'AVG')} AS followers_7d_avg, {_roll('reach', 'SUM', cast='BIGINT')} AS "
                f"reach_7d_sum, {_roll('reach', 'AVG')} AS reach_7d_avg "
                f"FROM (SELECT *, posts + reels + stories AS dpf FROM f1) a {W7}", "f1"))
def wn2(spark, sf):
    """WN2 the ten 7-day rolling features of the daily pipeline (F1)."""
    d = WN.add_daily_rolling_features(FX.daily_metrics(spark, sf))
    return d.select(*KEY, *WN2_COLS)


@register("wn3", doubles=("growth_momentum",),
          sql=q("SELECT username, date, CASE WHEN COUNT(growth) OVER w3 = 3 THEN AVG(growth) OVER w3 END AS "
                "growth_momentum, growth - LAG(growth) OVER (PARTITION BY username ORDER BY date) AS "
                "growth_acceleration FROM f2 WINDOW w3 AS (PARTITION BY username ORDER BY date ROWS BETWEEN 2 "
                "PRECEDING AND CURRENT ROW)", "f2"))
def wn3(spark, sf):
    """WN3 growth momentum (3-row mean) and acceleration (first difference)."""
    d = WN.add_growth_momentum(FX.daily_dense(spark, sf))
    return d.select(*KEY, "growth_momentum", "growth_acceleration")


@register("wn4", doubles=("engagement_trend",),
          sql=q("SELECT username, date, CASE WHEN COUNT(engagement_rate) OVER w = 7 THEN "
                "regr_slope(engagement_rate, pos) OVER w END AS engagement_trend FROM (SELECT *, "
                "CAST(ROW_NUMBER() OVER (PARTITION BY username ORDER BY date) AS DOUBLE) AS pos FROM f1) a " + W7,
                "f1"))
def wn4(spark, sf):
    """WN4 rolling degree-1 slope of engagement rate over the last 7 rows."""
    d = WN.add_rolling_slope(FX.daily_metrics(spark, sf), "engagement_rate", 7, "engagement_trend")
    return d.select(*KEY, "engagement_trend")


WEEK_W = "PARTITION BY username ORDER BY week_start"


@register("wn5", doubles=("prev_week_engagement",),
          sql=q(f"SELECT username, week_start, LAG(weekly_growth) OVER ({WEEK_W}) AS prev_week_growth, "
                f"LAG(weekly_posting_frequency) OVER ({WEEK_W}) AS prev_week_posting, "
                f"LAG(engagement_rate) OVER ({WEEK_W}) AS prev_week_engagement FROM wk", "f1",
                extra=weekly_ctes("f1")))
def wn5(spark, sf):
    """WN5 lag-1 weekly features per creator."""
    w = WN.add_weekly_lags(W.create_weekly_features(FX.daily_metrics(spark, sf)))
    return w.select("username", "week_start", "prev_week_growth", "prev_week_posting", "prev_week_engagement")


@register("wn6", doubles=("growth_momentum_3w", "performance_trend"),
          sql=q(f"SELECT username, week_start, CASE WHEN COUNT(weekly_growth) OVER w3 = 3 THEN AVG(weekly_growth) "
                f"OVER w3 END AS growth_momentum_3w, CASE WHEN COUNT(weekly_growth) OVER w4 = 4 THEN "
                f"regr_slope(weekly_growth, pos) OVER w4 END AS performance_trend FROM (SELECT *, CAST(ROW_NUMBER() "
                f"OVER ({WEEK_W}) AS DOUBLE) AS pos FROM wk) a WINDOW w3 AS ({WEEK_W} ROWS BETWEEN 2 PRECEDING AND "
                f"CURRENT ROW), w4 AS ({WEEK_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", "f1",
                extra=weekly_ctes("f1")))
def wn6(spark, sf):
    """WN6 3-week momentum and WN4's 4-week performance trend."""
    w = WN.add_weekly_lags(W.create_weekly_features(FX.daily_metrics(spark, sf)))
    return w.select("username", "week_start", "growth_momentum_3w", "performance_trend")


@register("wn7", doubles=("post_consistency_variance_7d",),
          sql=q("SELECT username, date, CASE WHEN COUNT(posts) OVER w >= 2 THEN VAR_POP(posts) OVER w ELSE 0.0 END "
                "AS post_consistency_variance_7d FROM f1 " + W7, "f1"))
def wn7(spark, sf):
    """WN7 population variance of posts over the last <= 7 rows (0 with < 2 rows)."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, WN.consistency_variance_7d().alias("post_consistency_variance_7d"))


@register("wn8", sql=q(f"SELECT username, week_start, weekly_growth - 2 * LAG(weekly_growth, 1) OVER ({WEEK_W}) + "
                       f"LAG(weekly_growth, 2) OVER ({WEEK_W}) AS growth_second_diff FROM wk", "f1",
                       extra=weekly_ctes("f1")))
def wn8(spark, sf):
    """WN8 second difference (acceleration) of weekly growth."""
    w = W.create_weekly_features(FX.daily_metrics(spark, sf))
    return w.select("username", "week_start",
                    WN.second_difference("weekly_growth", order="week_start").alias("growth_second_diff"))


@register("wn11", doubles=("engagement_rate_pct_7d",),
          sql=q("SELECT username, date, CASE WHEN COUNT(engagement_rate) OVER w = 7 THEN AVG(engagement_rate) OVER w "
                "END * 100 AS engagement_rate_pct_7d FROM f1 " + W7, "f1"))
def wn11(spark, sf):
    """WN11 engagement-rate trend line: 7-row rolling mean x 100."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, (WN.rolling_value("engagement_rate", 7, "mean") * 100).alias("engagement_rate_pct_7d"))
