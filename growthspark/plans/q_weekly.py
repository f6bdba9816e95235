"""Registered queries: weekly aggregation, weekly features, flagship fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import weekly as W
from ..operators.metrics import regression_metrics
from ..operators import models as M
from ..sources import fixtures as FX
from .registry import register
from .sqlparts import F1_SUMS, F2_SUMS, mix_cols, q, roi_cols, weekly_ctes, weekly_feature_ctes

WEEK_KEYS = ["username", "week_start"]


# ---------------------------------------------------------------- AG1 / AG2
@register("ag1", doubles=("engagement_rate", "avg_hashtag_count", "roi_follows_per_hour",
                          "posting_consistency_variance", "posting_regularity_score"),
          sql=q("SELECT * FROM wk", "f1", extra=weekly_ctes("f1")))
def ag1(spark, sf):
    """AG1+AG2 on F1: weekly sums, means, last followers, modal post time, consistency."""
    return W.create_weekly_features(FX.daily_metrics(spark, sf))


@register("ag2", doubles=("posting_consistency_variance", "posting_regularity_score"),
          sql=q("SELECT username, week_start, week_end, posting_consistency_variance, posting_consistency_days, "
                "max_gap_days, posting_regularity_score FROM wk", "f2",
                extra=weekly_ctes("f2", sums=F2_SUMS, means=[], followers=False, post_time=False)))
def ag2(spark, sf):
    """AG2 on F2 (dense days with inactive days): variance, active days, max gap, regularity."""
    w = W.create_weekly_features(FX.daily_dense(spark, sf))
    return w.select("username", "week_start", "week_end", "posting_consistency_variance",
                    "posting_consistency_days", "max_gap_days", "posting_regularity_score")


@register("jn2", sql=q("SELECT username, week_start, CAST(COUNT(*) AS BIGINT) AS days_in_week, "
                       "MIN(date) AS first_day, MAX(date) AS last_day FROM dw GROUP BY username, week_start",
                       "f1", extra=weekly_ctes("f1")))
def jn2(spark, sf):
    """JN2: day -> week match as an equality on the Monday key (no range join)."""
    d = W.add_week_columns(FX.daily_metrics(spark, sf))
    return d.groupBy("username", "week_start").agg(
        F.count(F.lit(1)).alias("days_in_week"), F.min("date").alias("first_day"),
        F.max("date").alias("last_day"))


@register("jn1", doubles=("posting_consistency_variance", "posting_regularity_score", "engagement_rate"),
          sql=q("SELECT username, week_start, weekly_posting_frequency, engagement_rate, "
                "posting_consistency_variance, posting_regularity_score FROM wk", "f1", extra=weekly_ctes("f1")))
def jn1(spark, sf):
    """JN1: weekly frame + consistency frame keyed by (username, week_start)."""
    w = W.create_weekly_features(FX.daily_metrics(spark, sf))
    return w.select("username", "week_start", "weekly_posting_frequency", "engagement_rate",
                    "posting_consistency_variance", "posting_regularity_score")


# ---------------------------------------------------------------- FE1-FE3
FE1_D = ("share_posts", "share_reels", "share_stories", "content_diversity")


@register("fe1", doubles=FE1_D,
          sql=q(f"SELECT username, week_start, {mix_cols()} FROM wk", "f1", extra=weekly_ctes("f1")))
def fe1(spark, sf):
    """FE1: content totals, shares, entropy diversity, dominant type, reels focus."""
    w = W.add_content_mix_features(W.create_weekly_features(FX.daily_metrics(spark, sf)))
    return w.select("username", "week_start", "total_content", "share_posts", "share_reels",
                    "share_stories", "content_diversity", "dominant_content_type", "reels_focused")


FE2_COLS = ["follows_per_minute", "engagement_per_minute", "follows_per_post", "engagement_per_post",
            "reach_per_post", "reach_efficiency", "profile_visit_conversion"]


@register("fe2", doubles=tuple(FE2_COLS),
          sql=q(f"SELECT username, week_start, {roi_cols()} FROM wk", "f1", extra=weekly_ctes("f1")))
def fe2(spark, sf):
    """FE2: efficiency ratios per minute, per post, reach and visit conversion."""
    w = W.add_roi_features(W.create_weekly_features(FX.daily_metrics(spark, sf)))
    return w.select("username", "week_start", *FE2_COLS)


@register("fe3", doubles=("roi_score",),
          sql=q("SELECT username, week_start, roi_score FROM wf", "f1", extra=weekly_feature_ctes("f1")))
def fe3(spark, sf):
    """FE3: ROI score normalised by whole-table maxima (one-row aggregate inlined as literals)."""
    w = W.weekly_feature_table(FX.daily_metrics(spark, sf))
    return w.select("username", "week_start", "roi_score")


# ---------------------------------------------------------------- flagship
ML_SQL_FIT = ("fit AS (SELECT regr_slope(weekly_growth, weekly_posting_frequency) AS b, "
              "regr_intercept(weekly_growth, weekly_posting_frequency) AS a FROM wk),\n"
              "pr AS (SELECT CAST(weekly_growth AS DOUBLE) AS y, a + b * weekly_posting_frequency AS yhat "
              "FROM wk, fit)")
METRICS_SQL = ("SELECT COUNT(*) AS n, AVG((y - yhat) * (y - yhat)) AS mse, "
               "SQRT(AVG((y - yhat) * (y - yhat))) AS rmse, AVG(ABS(y - yhat)) AS mae, "
               "CASE WHEN VAR_POP(y) * COUNT(y) = 0 THEN (CASE WHEN SUM((y - yhat) * (y - yhat)) = 0 THEN 1.0 "
               "ELSE 0.0 END) ELSE 1 - SUM((y - yhat) * (y - yhat)) / (VAR_POP(y) * COUNT(y)) END AS r2, "
               "AVG(ABS(CASE WHEN y <> 0 THEN (y - yhat) / y ELSE 0.0 END)) * 100 AS mape, "
               "AVG(CASE WHEN SIGN(y) = SIGN(yhat) THEN 1.0 ELSE 0.0 END) * 100 AS directional_accuracy "
               "FROM pr")
METRIC_D = ("mse", "rmse", "mae", "r2", "mape", "directional_accuracy")


def flagship_df(spark, sf):
    weekly = W.weekly_feature_table(FX.daily_metrics(spark, sf))
    model = M.fit_single_feature(weekly, "weekly_posting_frequency", "weekly_growth")
    pred = M.predict_single(model, weekly, "weekly_posting_frequency").select(
        F.col("weekly_growth").alias("y_true"), "y_pred")
    return regression_metrics(pred)


@register("ml11", doubles=METRIC_D, sql=q(METRICS_SQL, "f1", extra=weekly_ctes("f1") + ",\n" + ML_SQL_FIT))
def ml11(spark, sf):
    """ML11 flagship: F1 -> weekly features -> one-feature OLS -> metric row."""
    return flagship_df(spark, sf)


@register("ml4", doubles=("coef", "intercept"),
          sql=q("SELECT 'weekly_posting_frequency' AS feature, b AS coef, a AS intercept, "
                "(SELECT COUNT(*) FROM wk) AS n FROM fit", "f1",
                extra=weekly_ctes("f1") + ",\n" + ML_SQL_FIT))
def ml4(spark, sf):
    """ML4 (one-feature form): OLS slope and intercept from regr_slope/regr_intercept."""
    weekly = W.create_weekly_features(FX.daily_metrics(spark, sf))
    return M.fit_single_feature(weekly, "weekly_posting_frequency", "weekly_growth")
