"""Registered queries: feature engineering FE4-FE14, AG12."""

from __future__ import annotations

from .. import config as C
from ..operators import features as FE
from ..operators import weekly as W
from ..sources import fixtures as FX
from .q_functions import _cut_sql
from .registry import register
from .sqlparts import F1_SUMS, clip_sql, mix_cols, q, sdiv, weekly_feature_ctes

WK = ["username", "week_start"]
WIN7 = "(PARTITION BY username ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
WW = "PARTITION BY username ORDER BY week_start"


def _roll(c, agg, size=7, cast=None):
    inner = f"{agg}({c}) OVER {WIN7 if size == 7 else '(PARTITION BY username ORDER BY date ROWS BETWEEN ' + str(size - 1) + ' PRECEDING AND CURRENT ROW)'}"
    if cast:
        inner = f"CAST({inner} AS {cast})"
    w = WIN7 if size == 7 else f"(PARTITION BY username ORDER BY date ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN COUNT({c}) OVER {w} = {size} THEN {inner} END"


FE4_COLS = ["daily_posting_frequency", "daily_posting_frequency_7d_avg", "daily_posting_frequency_7d_std",
            "daily_posting_frequency_7d_sum", "engagement_rate_7d_avg", "engagement_rate_7d_std", "growth_7d_avg",
            "growth_7d_sum", "followers_7d_avg", "reach_7d_sum", "reach_7d_avg", "total_content", "share_posts",
            "share_reels", "share_stories", "content_diversity", "dominant_content_type", "reels_focused",
            "growth_momentum", "growth_acceleration", "engagement_trend"]
FE4_SQL = (
    "SELECT username, date, dpf AS daily_posting_frequency, "
    f"{_roll('dpf', 'AVG')} AS daily_posting_frequency_7d_avg, {_roll('dpf', 'STDDEV_SAMP')} AS daily_posting_frequency_7d_std, "
    f"{_roll('dpf', 'SUM', cast='BIGINT')} AS daily_posting_frequency_7d_sum, {_roll('engagement_rate', 'AVG')} AS "
    f"engagement_rate_7d_avg, {_roll('engagement_rate', 'STDDEV_SAMP')} AS engagement_rate_7d_std, "
    f"{_roll('growth', 'AVG')} AS growth_7d_avg, {_roll('growth', 'SUM', cast='BIGINT')} AS growth_7d_sum, "
    f"{_roll('followers', 'AVG')} AS followers_7d_avg, {_roll('reach', 'SUM', cast='BIGINT')} AS reach_7d_sum, "
    f"{_roll('reach', 'AVG')} AS reach_7d_avg, {mix_cols()}, {_roll('growth', 'AVG', size=3)} AS growth_momentum, "
    "growth - LAG(growth) OVER (PARTITION BY username ORDER BY date) AS growth_acceleration, "
    f"CASE WHEN COUNT(engagement_rate) OVER {WIN7} = 7 THEN regr_slope(engagement_rate, pos) OVER {WIN7} END "
    "AS engagement_trend FROM (SELECT *, posts + reels + stories AS dpf, CAST(ROW_NUMBER() OVER (PARTITION BY "
    "username ORDER BY date) AS DOUBLE) AS pos FROM f1) a")


@register("fe4", doubles=tuple(c for c in FE4_COLS if c not in (
    "daily_posting_frequency", "daily_posting_frequency_7d_sum", "growth_7d_sum", "reach_7d_sum", "total_content",
    "dominant_content_type", "reels_focused", "growth_acceleration")), sql=q(FE4_SQL, "f1"))
def fe4(spark, sf):
    """FE4 create_daily_features on F1: rolling stats, content mix, momentum, 7-day trend."""
    d = FE.create_daily_features(FX.daily_metrics(spark, sf))
    return d.select("username", "date", *FE4_COLS)


# ----------------------------------------------------------------- FE5-FE10
EQ = " + ".join(f"{c} * {w}" for c, w in C.ENGAGEMENT_WEIGHTS)
AQ = (f"0.4 * {sdiv('follows', 'profile_visits')} + 0.3 * {sdiv('profile_visits', 'reach')} + "
      f"0.3 * {sdiv('follows', 'reach')}")


def adv_ctes() -> str:
    """``adv`` = weekly features + FE5-FE9 (thresholds from one quantile CTE)."""
    return weekly_feature_ctes("f1") + ",\n" + (
        f"adv0 AS (SELECT *, {sdiv(EQ, 'reach')} AS _eq, {AQ} AS _aq, "
        f"{sdiv('weekly_growth', 'weekly_posting_frequency')} AS growth_efficiency FROM wf),\n"
        "advq AS (SELECT quantile_cont(_eq, 0.95) AS eq95, quantile_cont(_aq, 0.95) AS aq95, "
        "quantile_cont(growth_efficiency, 0.7) AS eff70, quantile_cont(growth_efficiency, 0.3) AS eff30, "
        "quantile_cont(weekly_posting_frequency, 0.8) AS wpf80, quantile_cont(engagement_rate, 0.3) AS rate30, "
        "quantile_cont(minutes_spent, 0.8) AS min80, quantile_cont(roi_follows_per_hour, 0.3) AS roi30 FROM adv0),\n"
        "adv AS (SELECT adv0.* EXCLUDE (_eq, _aq), "
        f"CASE WHEN eq95 > 0 THEN {clip_sql('_eq / eq95', '0.0', '1.0')} ELSE _eq END AS engagement_quality_score, "
        f"CASE WHEN aq95 > 0 THEN {clip_sql('_aq / aq95', '0.0', '1.0')} ELSE _aq END AS audience_quality_score, "
        "CAST(COALESCE(growth_efficiency > eff70, FALSE) AND COALESCE(posting_regularity_score > 0.5, FALSE) "
        "AS INTEGER) AS sustainable_growth_indicator, "
        f"{_cut_sql('weekly_posting_frequency', C.POSTING_TIER_BINS, C.POSTING_TIER_LABELS)} AS posting_tier, "
        "CAST(COALESCE(growth_efficiency < eff30, FALSE) OR (COALESCE(weekly_posting_frequency > wpf80, FALSE) AND "
        "COALESCE(engagement_rate < rate30, FALSE)) OR (COALESCE(minutes_spent > min80, FALSE) AND "
        "COALESCE(roi_follows_per_hour < roi30, FALSE)) AS INTEGER) AS potential_saturation, "
        f"{_cut_sql('engagement_rate', C.ENGAGEMENT_TIER_BINS, C.ENGAGEMENT_TIER_LABELS)} AS engagement_tier "
        "FROM adv0, advq)")


def _adv(spark, sf):
    return FE.add_advanced_features(W.weekly_feature_table(FX.daily_metrics(spark, sf)))


@register("fe5", doubles=("engagement_quality_score",),
          sql=q("SELECT username, week_start, engagement_quality_score FROM adv", "f1", extra=adv_ctes()))
def fe5(spark, sf):
    """FE5 engagement quality: weighted interactions / reach, / q95, clipped to [0, 1]."""
    return _adv(spark, sf).select(*WK, "engagement_quality_score")


@register("fe6", doubles=("audience_quality_score",),
          sql=q("SELECT username, week_start, audience_quality_score FROM adv", "f1", extra=adv_ctes()))
def fe6(spark, sf):
    """FE6 audience quality: .4 visit conversion + .3 reach-to-visit + .3 conversion, / q95."""
    return _adv(spark, sf).select(*WK, "audience_quality_score")


@register("fe7", doubles=("growth_efficiency",),
          sql=q("SELECT username, week_start, growth_efficiency, sustainable_growth_indicator FROM adv", "f1",
                extra=adv_ctes()))
def fe7(spark, sf):
    """FE7 growth efficiency and the sustainable-growth flag (> q70 and regularity > .5)."""
    return _adv(spark, sf).select(*WK, "growth_efficiency", "sustainable_growth_indicator")


@register("fe8", sql=q("SELECT username, week_start, posting_tier, engagement_tier FROM adv", "f1", extra=adv_ctes()))
def fe8(spark, sf):
    """FE8 posting and engagement tiers."""
    return _adv(spark, sf).select(*WK, "posting_tier", "engagement_tier")


@register("fe9", sql=q("SELECT username, week_start, potential_saturation FROM adv", "f1", extra=adv_ctes()))
def fe9(spark, sf):
    """FE9 saturation signals from six quantile thresholds."""
    return _adv(spark, sf).select(*WK, "potential_saturation")


ADV_COLS = ["engagement_quality_score", "audience_quality_score", "growth_efficiency",
            "sustainable_growth_indicator", "posting_tier", "potential_saturation", "engagement_tier"]


@register("fe10", doubles=("engagement_quality_score", "audience_quality_score", "growth_efficiency"),
          sql=q("SELECT username, week_start, " + ", ".join(ADV_COLS) + " FROM adv", "f1", extra=adv_ctes()))
def fe10(spark, sf):
    """FE10 add_advanced_features (FE5-FE9 in one quantile pass)."""
    return _adv(spark, sf).select(*WK, *ADV_COLS)


# ----------------------------------------------------------------- FE11, FE12
INTER = {
    "posting_freq_x_reels_share": "weekly_posting_frequency * share_reels",
    "posting_freq_x_posts_share": "weekly_posting_frequency * share_posts",
    "posting_freq_x_stories_share": "weekly_posting_frequency * share_stories",
    "posting_freq_x_regularity": "weekly_posting_frequency * posting_regularity_score",
    "posting_freq_x_consistency": "weekly_posting_frequency * (1.0 / (1 + posting_consistency_variance))",
    "reels_share_x_engagement": "share_reels * engagement_rate",
    "posts_share_x_engagement": "share_posts * engagement_rate",
    "roi_x_posting_freq": "roi_follows_per_hour * weekly_posting_frequency",
}


@register("fe11", doubles=tuple(INTER),
          sql=q("SELECT username, week_start, " + ", ".join(f"{v} AS {k}" for k, v in INTER.items()) + " FROM wf",
                "f1", extra=weekly_feature_ctes("f1")))
def fe11(spark, sf):
    """FE11 eight interaction products."""
    w = FE.add_interaction_features(W.weekly_feature_table(FX.daily_metrics(spark, sf)))
    return w.select(*WK, *INTER)


TEMPORAL = {
    "year": "CAST(year(week_start) AS INTEGER)", "month": "CAST(month(week_start) AS INTEGER)",
    "quarter": "CAST(quarter(week_start) AS INTEGER)", "week_of_year": "CAST(weekofyear(week_start) AS INTEGER)",
    "day_of_week": "CAST(isodow(week_start) - 1 AS INTEGER)", "day_of_month": "CAST(day(week_start) AS INTEGER)",
    "is_weekend": "CAST(isodow(week_start) >= 6 AS INTEGER)", "is_month_start": "CAST(day(week_start) = 1 AS INTEGER)",
    "is_month_end": "CAST(week_start = last_day(week_start) AS INTEGER)",
    "is_beginning_of_month": "CAST(day(week_start) <= 7 AS INTEGER)",
    "is_end_of_month": "CAST(day(week_start) >= 24 AS INTEGER)",
    "is_holiday_season": "CAST(month(week_start) IN (11, 12, 1) AS INTEGER)",
    "is_summer": "CAST(month(week_start) IN (6, 7, 8) AS INTEGER)",
    "is_back_to_school": "CAST(month(week_start) IN (8, 9) AS INTEGER)",
    "month_sin": "SIN(2 * PI() * month(week_start) / 12)", "month_cos": "COS(2 * PI() * month(week_start) / 12)",
    "week_sin": "SIN(2 * PI() * weekofyear(week_start) / 52)", "week_cos": "COS(2 * PI() * weekofyear(week_start) / 52)",
    "prev_week_growth": f"LAG(weekly_growth) OVER ({WW})",
    "prev_week_posting": f"LAG(weekly_posting_frequency) OVER ({WW})",
    "prev_week_engagement": f"LAG(engagement_rate) OVER ({WW})",
    "growth_momentum_3w": f"CASE WHEN COUNT(weekly_growth) OVER ({WW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 "
                          f"THEN AVG(weekly_growth) OVER ({WW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END",
    "performance_trend": f"CASE WHEN COUNT(weekly_growth) OVER ({WW} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 "
                         f"THEN regr_slope(weekly_growth, _pos) OVER ({WW} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END",
}
TEMPORAL_D = ("month_sin", "month_cos", "week_sin", "week_cos", "prev_week_engagement", "growth_momentum_3w",
              "performance_trend")


@register("fe12", doubles=TEMPORAL_D,
          sql=q("SELECT username, week_start, " + ", ".join(f"{v} AS {k}" for k, v in TEMPORAL.items()) +
                f" FROM (SELECT *, CAST(ROW_NUMBER() OVER ({WW}) AS DOUBLE) AS _pos FROM wf) t", "f1",
                extra=weekly_feature_ctes("f1")))
def fe12(spark, sf):
    """FE12 temporal features: calendar, flags, cyclic, weekly lags, momentum, 4-week trend."""
    w = FE.add_temporal_features(W.weekly_feature_table(FX.daily_metrics(spark, sf)))
    return w.select(*WK, *TEMPORAL)


# ----------------------------------------------------------------- FE13, FE14
WF_NUMERIC = (F1_SUMS + ["engagement_rate", "avg_hashtag_count", "roi_follows_per_hour", "followers",
                         "posting_consistency_variance", "posting_consistency_days", "weekly_posting_frequency",
                         "weekly_growth", "max_gap_days", "posting_regularity_score", "total_content", "share_posts",
                         "share_reels", "share_stories", "content_diversity", "reels_focused", "follows_per_minute",
                         "engagement_per_minute", "follows_per_post", "engagement_per_post", "reach_per_post",
                         "reach_efficiency", "profile_visit_conversion", "roi_score"])
FULL_NUMERIC = (WF_NUMERIC + ["engagement_quality_score", "audience_quality_score", "growth_efficiency",
                              "sustainable_growth_indicator", "potential_saturation"] + list(INTER)
                + [k for k in TEMPORAL])


def finalize_ctes(src: str, numeric: list[str], name: str, by: str = "") -> str:
    """FE13 in SQL: inf -> NULL, clip to q.001..q.999, fill 0 / clipped median, round_even 6; ``by``: per key."""
    x = {c: f"CASE WHEN isinf(CAST({c} AS DOUBLE)) OR isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END"
         for c in numeric}
    a = f"{name}_a"
    parts = [f"{a} AS (SELECT * REPLACE ({', '.join(f'{x[c]} AS {c}' for c in numeric)}) FROM {src})"]
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    beside = lambda one, two: f"{one} JOIN {two} USING ({by})" if by else f"{one}, {two}"
    parts.append(f"{name}_q AS (SELECT {key}" + ", ".join(
        f"quantile_cont({c}, 0.001) AS {c}__lo, quantile_cont({c}, 0.999) AS {c}__hi" for c in numeric) + f" FROM {a}{group})")
    parts.append(f"{name}_c AS (SELECT {a}.* REPLACE (" + ", ".join(
        f"{clip_sql(c, c + '__lo', c + '__hi')} AS {c}" for c in numeric) + f") FROM {beside(a, name + '_q')})")
    parts.append(f"{name}_m AS (SELECT {key}" + ", ".join(f"quantile_cont({c}, 0.5) AS {c}__md" for c in numeric)
                 + f" FROM {name}_c{group})")
    rep = []
    for c in numeric:
        fill = "0.0" if FE._fill_zero(c) else f"{c}__md"
        rep.append(f"round_even(COALESCE({c}, {fill}), 6) AS {c}")
    parts.append(f"{name} AS (SELECT {name}_c.* REPLACE ({', '.join(rep)}) FROM {beside(name + '_c', name + '_m')})")
    return ",\n".join(parts)


@register("fe13", doubles=tuple(WF_NUMERIC),
          sql=q("SELECT * FROM fin", "f1", extra=weekly_feature_ctes("f1") + ",\n" + finalize_ctes("wf", WF_NUMERIC, "fin")))
def fe13(spark, sf):
    """FE13 finalize_features on the weekly feature table."""
    return FE.finalize_features(W.weekly_feature_table(FX.daily_metrics(spark, sf)))


@register("fe13c", doubles=tuple(WF_NUMERIC),
          sql=q("SELECT * FROM fin", "f1", extra=weekly_feature_ctes("f1") + ",\n" + finalize_ctes("wf", WF_NUMERIC, "fin", by="username")))
def fe13c(spark, sf):
    """FE13 per creator: clip bounds and medians of the creator's own weeks."""
    return FE.finalize_features(W.weekly_feature_table(FX.daily_metrics(spark, sf)), scope=["username"])


FULL_SQL_CTES = (adv_ctes() + ",\n" + "full0 AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in INTER.items()) +
                 " FROM adv),\n" + f"full1 AS (SELECT * EXCLUDE (_pos), " + ", ".join(f"{v} AS {k}" for k, v in TEMPORAL.items())
                 + f" FROM (SELECT *, CAST(ROW_NUMBER() OVER ({WW}) AS DOUBLE) AS _pos FROM full0) t),\n"
                 + finalize_ctes("full1", FULL_NUMERIC, "fin"))


@register("fe14", doubles=tuple(FULL_NUMERIC), sql=q("SELECT * FROM fin", "f1", extra=FULL_SQL_CTES))
def fe14(spark, sf):
    """FE14 transform_to_model_ready (weekly, advanced): AG1-AG2, FE1-FE3, FE10-FE13."""
    return FE.transform_to_model_ready(FX.daily_metrics(spark, sf))


DAILY_NUMERIC = (F1_SUMS + ["followers", "engagement_rate", "roi_follows_per_hour", "avg_hashtag_count"]
                 + [c for c in FE4_COLS if c != "dominant_content_type"] + ["engagement_quality_score", "audience_quality_score"]
                 + list(TEMPORAL)[:18])
DAILY_CTES = (
    f"d4 AS ({FE4_SQL}),\nd0 AS (SELECT f1.*, d4.* EXCLUDE (username, date), {sdiv(EQ, 'reach')} AS _eq, {AQ} AS _aq FROM f1 JOIN d4 USING (username, date)),\n"
    "dq AS (SELECT username, quantile_cont(_eq, 0.95) AS eq95, quantile_cont(_aq, 0.95) AS aq95 FROM d0 GROUP BY username),\n"
    f"d1 AS (SELECT d0.* EXCLUDE (_eq, _aq), CASE WHEN eq95 > 0 THEN {clip_sql('_eq / eq95', '0.0', '1.0')} ELSE _eq END AS engagement_quality_score, "
    f"CASE WHEN aq95 > 0 THEN {clip_sql('_aq / aq95', '0.0', '1.0')} ELSE _aq END AS audience_quality_score, "
    f"{_cut_sql('engagement_rate', C.ENGAGEMENT_TIER_BINS, C.ENGAGEMENT_TIER_LABELS)} AS engagement_tier, "
    + ", ".join(f"{v.replace('week_start', 'date')} AS {k}" for k, v in list(TEMPORAL.items())[:18])
    + " FROM d0 JOIN dq USING (username)),\n" + finalize_ctes("d1", DAILY_NUMERIC, "fin", by="username"))


@register("fe14d", doubles=(*DAILY_NUMERIC, "weekly_growth"), sql=q("SELECT *, growth AS weekly_growth FROM fin", "f1", extra=DAILY_CTES))
def fe14d(spark, sf):
    """FE14 on the daily path, per creator: FE4, FE5-FE6 and FE13 by the creator's own quantiles, FE12."""
    return FE.transform_to_model_ready(FX.daily_metrics(spark, sf), "daily", scope=["username"])


@register("ag12", doubles=("mean", "std"),
          sql=q(" UNION ALL ".join(
              f"SELECT '{c}' AS feature, COUNT({c}) AS n, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS "
              f"missing, AVG(CAST({c} AS DOUBLE)) AS mean, STDDEV_SAMP(CAST({c} AS DOUBLE)) AS std FROM wf"
              for c in WF_NUMERIC), "f1", extra=weekly_feature_ctes("f1")))
def ag12(spark, sf):
    """AG12 feature summary: count, missing, mean, sample std per numeric feature."""
    return FE.feature_summary(W.weekly_feature_table(FX.daily_metrics(spark, sf)))


OVERVIEW_COLS = ["username", "week_start", "week_end", "weekly_posting_frequency", "weekly_growth", "share_posts", "share_reels",
                 "engagement_rate", "roi_follows_per_hour", "max_gap_days"]


@register("ag12s", sql=q(
    "SELECT 'total_samples' AS item, CAST(NULL AS VARCHAR) AS name, CAST(COUNT(*) AS VARCHAR) AS value FROM wf UNION ALL "
    "SELECT 'missing_values', NULL, CAST(" + " + ".join(f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in OVERVIEW_COLS) + " AS VARCHAR) FROM wf UNION ALL "
    "SELECT 'date_range', 'start', CAST(MIN(week_start) AS VARCHAR) FROM wf UNION ALL SELECT 'date_range', 'end', CAST(MAX(week_start) AS VARCHAR) FROM wf UNION ALL "
    "SELECT 'date_range', 'periods', CAST(COUNT(*) AS VARCHAR) FROM wf UNION ALL SELECT * FROM (VALUES ('total_features', NULL, '10'), "
    "('numeric_features', NULL, '7'), ('feature_type', 'bigint', '2'), ('feature_type', 'date', '2'), ('feature_type', 'double', '4'), "
    "('feature_type', 'int', '1'), ('feature_type', 'string', '1'), ('feature_category', 'primary_features', '1'), "
    "('feature_category', 'content_mix', '2'), ('feature_category', 'engagement', '1'), ('feature_category', 'roi_metrics', '1'), "
    "('feature_category', 'target', '1')) v", "f1", extra=weekly_feature_ctes("f1")))
def ag12s(spark, sf):
    """AG12 overview: totals, missing values, column types and categories, date range."""
    return FE.feature_overview(W.weekly_feature_table(FX.daily_metrics(spark, sf)).select(*OVERVIEW_COLS))


@register("dq12t", doubles=("engagement_rate_smoothed", "posted_in_optimal_window"), sql=q(
    "SELECT username, CAST(date - CAST(isodow(date) - 1 AS INTEGER) AS DATE) AS week_start, AVG(e) AS engagement_rate_smoothed, "
    "AVG(CAST(post_time IN (" + ", ".join(f"'{t}'" for t in C.OPTIMAL_POST_TIMES) + ") AS INTEGER)) AS posted_in_optimal_window FROM (SELECT *, "
    "AVG(engagement_rate) OVER (PARTITION BY username ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS e FROM f1) d GROUP BY 1, 2", "f1"))
def dq12t(spark, sf):
    """DQ12 columns of the full processed table: smoothed engagement rate, share of optimal post times."""
    d = FX.daily_metrics(spark, sf)
    full = W.add_processed_columns(W.weekly_feature_table(d, checkpoint=False), d)
    return full.select("username", "week_start", "engagement_rate_smoothed", "posted_in_optimal_window")
