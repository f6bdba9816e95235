"""Registered queries: scalar functions FN1-FN24 on the daily projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..operators import weekly as W
from ..sources import fixtures as FX
from .registry import register
from .sqlparts import q, sdiv, weekly_ctes

KEY = ["username", "date"]
H = "(CAST(date - DATE '1995-01-01' AS BIGINT) + CAST(regexp_extract(username, '(\\d+)$', 1) AS BIGINT))"


def _h():
    """Stand-in input key: day number + supplier number (as in F3)."""
    return (F.datediff(F.col("date"), F.lit("1995-01-01").cast("date"))
            + F.regexp_extract("username", r"(\d+)$", 1).cast("long"))


@register("fn1", doubles=("follow_ratio", "growth_per_post"),
          sql=q(f"SELECT username, date, {sdiv('follows', 'unfollows')} AS follow_ratio, "
                f"{sdiv('growth', 'posts', '-1.0')} AS growth_per_post FROM f1", "f1"))
def fn1(spark, sf):
    """FN1 safe_divide with zero denominators (default 0 and -1)."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, X.safe_divide("follows", "unfollows").alias("follow_ratio"),
                    X.safe_divide("growth", "posts", -1.0).alias("growth_per_post"))


PCT_SQL = ("CASE WHEN unfollows = 0 THEN (CASE WHEN follows = 0 THEN 0.0 ELSE CAST('inf' AS DOUBLE) END) "
           "ELSE (follows - unfollows) / CAST(ABS(unfollows) AS DOUBLE) * 100 END")


@register("fn2", doubles=("pct",),
          sql=q(f"SELECT username, date, {PCT_SQL} AS pct FROM f1", "f1"))
def fn2(spark, sf):
    """FN2 percentage change unfollows -> follows (old 0: 0 or +inf)."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, X.pct_change("unfollows", "follows").alias("pct"))


# stand-in texts in six formats plus junk, chosen by key arithmetic
_TXT_SQL = (f"CASE {H} % 7 WHEN 0 THEN strftime(date, '%Y-%m-%d') WHEN 1 THEN strftime(date, '%d-%m-%Y') "
            f"WHEN 2 THEN strftime(date, '%m/%d/%Y') WHEN 3 THEN strftime(date, '%d/%m/%Y') "
            f"WHEN 4 THEN strftime(date, '%Y-%m-%d') || ' 10:30:15' "
            f"WHEN 5 THEN strftime(date, '%d-%m-%Y') || ' 23:05:09' ELSE 'bad' END")
_PARSE_SQL = ("COALESCE(try_strptime(txt, '%Y-%m-%d'), try_strptime(txt, '%d-%m-%Y'), "
              "try_strptime(txt, '%m/%d/%Y'), try_strptime(txt, '%d/%m/%Y'), "
              "try_strptime(txt, '%Y-%m-%d %H:%M:%S'), try_strptime(txt, '%d-%m-%Y %H:%M:%S'))")


def _txt():
    k = F.pmod(_h(), F.lit(7))
    return (F.when(k == 0, F.date_format("date", "yyyy-MM-dd"))
            .when(k == 1, F.date_format("date", "dd-MM-yyyy"))
            .when(k == 2, F.date_format("date", "MM/dd/yyyy"))
            .when(k == 3, F.date_format("date", "dd/MM/yyyy"))
            .when(k == 4, F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 10:30:15")))
            .when(k == 5, F.concat(F.date_format("date", "dd-MM-yyyy"), F.lit(" 23:05:09")))
            .otherwise(F.lit("bad")))


@register("fn3", sql=q(f"SELECT username, date, txt, CAST(p AS DATE) AS parsed_date, "
                       f"CAST(hour(p) AS INTEGER) AS parsed_hour FROM (SELECT *, {_PARSE_SQL} AS p FROM "
                       f"(SELECT username, date, {_TXT_SQL} AS txt FROM f1) a) b", "f1"))
def fn3(spark, sf):
    """FN3 parse_date_string: first of six formats that parses (m/d before d/m)."""
    d = FX.daily_metrics(spark, sf).select(*KEY, _txt().alias("txt"))
    p = X.parse_date_string("txt")
    return d.select(*KEY, "txt", F.to_date(p).alias("parsed_date"), F.hour(p).alias("parsed_hour"))


@register("fn4", sql=q("SELECT username, date, CAST(date - CAST(isodow(date) - 1 AS INTEGER) AS DATE) AS "
                       "week_start, CAST(date - CAST(isodow(date) - 1 AS INTEGER) + 6 AS DATE) AS week_end "
                       "FROM f2", "f2"))
def fn4(spark, sf):
    """FN4 week boundaries (Monday, Sunday)."""
    return FX.daily_dense(spark, sf).select(*KEY, X.week_start("date").alias("week_start"),
                                            X.week_end("date").alias("week_end"))


@register("fn5", sql=q("SELECT username, date, CAST(year(date) AS INTEGER) AS year, "
                       "CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, "
                       "CAST(weekofyear(date) AS INTEGER) AS week_of_year, "
                       "CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS "
                       "day_of_month, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, "
                       "CAST(day(date) = 1 AS INTEGER) AS is_month_start, "
                       "CAST(date = last_day(date) AS INTEGER) AS is_month_end FROM f1", "f1"))
def fn5(spark, sf):
    """FN5 create_date_features."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, *[v.alias(k) for k, v in X.date_feature_columns("date").items()])


def _fmt_sql(v):
    return (f"CASE WHEN ABS({v}) >= 1e9 THEN printf('%.1fB', {v} / 1e9) WHEN ABS({v}) >= 1e6 THEN "
            f"printf('%.1fM', {v} / 1e6) WHEN ABS({v}) >= 1e3 THEN printf('%.1fK', {v} / 1e3) "
            f"ELSE printf('%.1f', CAST({v} AS DOUBLE)) END")


@register("fn6", sql=q(f"SELECT username, date, {_fmt_sql('reach')} AS reach_fmt, {_fmt_sql('growth')} AS "
                       f"growth_fmt, {_fmt_sql('reach * 10000')} AS big_fmt, "
                       f"{_fmt_sql('reach * 10')} AS mid_fmt FROM f1", "f1"))
def fn6(spark, sf):
    """FN6 format_large_numbers (K/M/B, Python rounding)."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, X.format_large_number("reach").alias("reach_fmt"),
                    X.format_large_number("growth").alias("growth_fmt"),
                    X.format_large_number(F.col("reach") * 10000).alias("big_fmt"),
                    X.format_large_number(F.col("reach") * 10).alias("mid_fmt"))


_RAW_SQL = (f"CASE {H} % 5 WHEN 0 THEN 'x' || CAST(reach AS VARCHAR) WHEN 1 THEN CAST(reach AS VARCHAR) || '.7' "
            f"WHEN 2 THEN '-' || CAST(posts AS VARCHAR) || '.5' WHEN 3 THEN ' ' || CAST(reach AS VARCHAR) "
            f"ELSE CAST(reach AS VARCHAR) END")


def _raw_txt():
    k = F.pmod(_h(), F.lit(5))
    r, p = F.col("reach").cast("string"), F.col("posts").cast("string")
    return (F.when(k == 0, F.concat(F.lit("x"), r)).when(k == 1, F.concat(r, F.lit(".7")))
            .when(k == 2, F.concat(F.lit("-"), p, F.lit(".5"))).when(k == 3, F.concat(F.lit(" "), r))
            .otherwise(r))


@register("fn7", doubles=("as_float",),
          sql=q("SELECT username, date, raw, COALESCE(CAST(trunc(TRY_CAST(TRIM(raw) AS DOUBLE)) AS BIGINT), 0) "
                "AS as_int, TRY_CAST(TRIM(raw) AS DOUBLE) AS as_float, "
                "TRY_CAST(strptime(strftime(date, '%d-%m-%Y'), '%d-%m-%Y') AS DATE) AS as_date "
                f"FROM (SELECT username, date, {_RAW_SQL} AS raw FROM f1) a", "f1"))
def fn7(spark, sf):
    """FN7 type coercion: ints (fail -> 0, truncate), floats (fail -> NULL), dd-mm-yyyy dates."""
    d = FX.daily_metrics(spark, sf).select(*KEY, _raw_txt().alias("raw"))
    return d.select(*KEY, "raw", X.coerce_int(F.trim("raw")).alias("as_int"),
                    X.coerce_float(F.trim("raw")).alias("as_float"),
                    X.parse_raw_date(F.date_format("date", "dd-MM-yyyy")).alias("as_date"))


@register("fn8", doubles=("rate_capped",),
          sql=q("SELECT username, date, seq, posts, CASE WHEN posts IS NULL THEN NULL ELSE GREATEST(0, LEAST(20, posts)) "
                "END AS posts_capped, CASE WHEN engagement_rate IS NULL THEN NULL ELSE "
                "GREATEST(0.0, LEAST(0.5, engagement_rate)) END AS rate_capped FROM f3", "f3"))
def fn8(spark, sf):
    """FN8 clip that keeps NULL (T4) on the damaged F3."""
    d = FX.daily_dirty(spark, sf)
    return d.select("username", "date", "seq", "posts", X.clip("posts", 0, 20).alias("posts_capped"),
                    X.clip("engagement_rate", 0.0, 0.5).alias("rate_capped"))


def _cut_sql(v, bins, labels):
    parts = []
    for lo, hi, lab in zip(bins[:-1], bins[1:], labels):
        cond = f"{v} > {lo}" + ("" if hi == float("inf") else f" AND {v} <= {hi}")
        parts.append(f"WHEN {cond} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


@register("fn9", sql=q(f"SELECT username, week_start, "
                       f"{_cut_sql('weekly_posting_frequency', C.POSTING_TIER_BINS, C.POSTING_TIER_LABELS)} "
                       f"AS posting_tier, {_cut_sql('engagement_rate', C.ENGAGEMENT_TIER_BINS, C.ENGAGEMENT_TIER_LABELS)} "
                       f"AS engagement_tier FROM wk", "f1", extra=weekly_ctes("f1")))
def fn9(spark, sf):
    """FN9 right-closed binning (posting and engagement tiers); 0 -> NULL."""
    w = W.create_weekly_features(FX.daily_metrics(spark, sf))
    return w.select("username", "week_start",
                    X.cut("weekly_posting_frequency", C.POSTING_TIER_BINS, C.POSTING_TIER_LABELS).alias("posting_tier"),
                    X.cut("engagement_rate", C.ENGAGEMENT_TIER_BINS, C.ENGAGEMENT_TIER_LABELS).alias("engagement_tier"))


_SH = {s: sdiv(s, "(posts + reels + stories)") for s in ("posts", "reels", "stories")}


@register("fn10", sql=q(f"SELECT username, date, CASE WHEN {_SH['posts']} >= {_SH['reels']} AND {_SH['posts']} >= "
                        f"{_SH['stories']} THEN 'posts' WHEN {_SH['reels']} >= {_SH['stories']} THEN 'reels' ELSE "
                        f"'stories' END AS dominant FROM f2", "f2"))
def fn10(spark, sf):
    """FN10 row arg-max over shares, ties -> first (F2 days have many ties)."""
    d = FX.daily_dense(spark, sf)
    for k, v in X.content_share_columns().items():
        d = d.withColumn(k, v)
    return d.select(*KEY, X.row_argmax(C.SHARE_COLUMNS, ["posts", "reels", "stories"]).alias("dominant"))


def _entropy_sql():
    sp, sr, ss = _SH["posts"], _SH["reels"], _SH["stories"]
    k = " + ".join(f"(CASE WHEN {s} > 0 THEN 1 ELSE 0 END)" for s in (sp, sr, ss))
    h = " + ".join(f"(CASE WHEN {s} > 0 THEN -{s} * LN({s}) ELSE 0.0 END)" for s in (sp, sr, ss))
    return f"CASE WHEN ({k}) <= 1 THEN 0.0 ELSE ({h}) / LN({k}) END"


@register("fn11", doubles=("diversity",), sql=q(f"SELECT username, date, {_entropy_sql()} AS diversity FROM f2", "f2"))
def fn11(spark, sf):
    """FN11 normalised Shannon entropy of the non-zero content shares."""
    d = FX.daily_dense(spark, sf)
    for k, v in X.content_share_columns().items():
        d = d.withColumn(k, v)
    return d.select(*KEY, X.share_entropy(C.SHARE_COLUMNS).alias("diversity"))


@register("fn12", doubles=("month_sin", "month_cos", "week_sin", "week_cos"),
          sql=q("SELECT username, date, SIN(2 * PI() * month(date) / 12) AS month_sin, "
                "COS(2 * PI() * month(date) / 12) AS month_cos, SIN(2 * PI() * weekofyear(date) / 52) AS week_sin, "
                "COS(2 * PI() * weekofyear(date) / 52) AS week_cos FROM f1", "f1"))
def fn12(spark, sf):
    """FN12 cyclic encodings of month and ISO week."""
    d = FX.daily_metrics(spark, sf)
    ms, mc = X.cyclic(F.month("date"), 12)
    ws, wc = X.cyclic(F.weekofyear("date"), 52)
    return d.select(*KEY, ms.alias("month_sin"), mc.alias("month_cos"), ws.alias("week_sin"), wc.alias("week_cos"))


@register("fn13", sql=q("SELECT username, date, CAST(day(date) <= 7 AS INTEGER) AS is_beginning_of_month, "
                        "CAST(day(date) >= 24 AS INTEGER) AS is_end_of_month, "
                        "CAST(month(date) IN (11, 12, 1) AS INTEGER) AS is_holiday_season, "
                        "CAST(month(date) IN (6, 7, 8) AS INTEGER) AS is_summer, "
                        "CAST(month(date) IN (8, 9) AS INTEGER) AS is_back_to_school FROM f1", "f1"))
def fn13(spark, sf):
    """FN13 calendar flags."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, *[v.alias(k) for k, v in
                            X.calendar_flag_columns(F.dayofmonth("date"), F.month("date")).items()])


@register("fn14", sql=q("SELECT username, date, seq, post_time, CASE WHEN post_time IS NULL THEN '12:00' "
                        "WHEN contains(post_time, ':') THEN substr(post_time, 1, 5) ELSE '12:00' END AS post_time_clean "
                        "FROM f3", "f3"))
def fn14(spark, sf):
    """FN14 post-time clean-up on F3 (NULL, '0830', '08:30:00')."""
    d = FX.daily_dirty(spark, sf)
    return d.select("username", "date", "seq", "post_time", X.standardize_time("post_time").alias("post_time_clean"))


@register("fn15", doubles=("log_reach", "log_followers"),
          sql=q("SELECT username, date, LN(1 + reach) AS log_reach, LN(1 + followers) AS log_followers FROM f1", "f1"))
def fn15(spark, sf):
    """FN15 log1p transform."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, X.log1p("reach").alias("log_reach"), X.log1p("followers").alias("log_followers"))


@register("fn16", doubles=("reach_8th",),
          sql=q("SELECT username, date, round_even(CAST(reach AS DOUBLE) / 8, 2) AS reach_8th, "
                "CAST(round_even(CAST(reach AS DOUBLE) / 2, 0) AS BIGINT) AS reach_half FROM f1", "f1"))
def fn16(spark, sf):
    """FN16 half-to-even rounding (x.125 -> x.12, 2.5 -> 2)."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, X.round_half_even(F.col("reach") / 8.0, 2).alias("reach_8th"),
                    X.round_to_long(F.col("reach") / 2.0).alias("reach_half"))


@register("fn17", doubles=("pct_finite",),
          sql=q(f"SELECT username, date, CASE WHEN isinf(p) OR isnan(p) THEN NULL ELSE p END AS pct_finite "
                f"FROM (SELECT username, date, {PCT_SQL} AS p FROM f1) a", "f1"))
def fn17(spark, sf):
    """FN17 +-inf / NaN -> NULL."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, X.finite_or_null(X.pct_change("unfollows", "follows")).alias("pct_finite"))


@register("fn18", sql=q("SELECT username, date, post_time, CAST(COALESCE(post_time IN ('08:00', '18:30', '21:00'), "
                        "FALSE) AS INTEGER) AS posted_in_optimal_window FROM f1", "f1"))
def fn18(spark, sf):
    """FN18 optimal posting window flag."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, "post_time", X.optimal_window_flag("post_time").alias("posted_in_optimal_window"))


@register("fn19", sql=q("SELECT username, date, CAST(posts * 45 + reels * 120 + stories * 8 AS BIGINT) AS "
                        "minutes_cost FROM f2", "f2"))
def fn19(spark, sf):
    """FN19 time cost 45 / 120 / 8 minutes per post / reel / story."""
    d = FX.daily_dense(spark, sf)
    return d.select(*KEY, X.time_cost_minutes().alias("minutes_cost"))


@register("fn20", doubles=("roi",),
          sql=q("SELECT username, date, follows / (CASE WHEN m > 0 THEN m / 60.0 ELSE 1.0 END) AS roi FROM "
                "(SELECT username, date, follows, CAST(posts * 45 + reels * 120 + stories * 8 AS DOUBLE) AS m "
                "FROM f2) a", "f2"))
def fn20(spark, sf):
    """FN20 follows per hour (one hour assumed when no time spent) on F2."""
    d = FX.daily_dense(spark, sf).withColumn("minutes_spent", X.time_cost_minutes())
    return d.select(*KEY, X.roi_follows_per_hour().alias("roi"))


@register("fn21", sql=q("SELECT username, date, CAST(posts + reels >= 5 AND engagement_rate < 0.05 AS INTEGER) "
                        "AS saturation_flag FROM f1", "f1"))
def fn21(spark, sf):
    """FN21 daily saturation flag."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, X.saturation_flag().alias("saturation_flag"))


@register("fn22", doubles=("engagement_rate_fn",),
          sql=q("SELECT username, date, (post_likes + 0 + 0 + saves + shares + comments) / "
                "CAST(GREATEST(reach, 1) AS DOUBLE) AS engagement_rate_fn FROM f1", "f1"))
def fn22(spark, sf):
    """FN22 engagement rate; F1 has no reel/story engagement (stand-in zeros)."""
    d = (FX.daily_metrics(spark, sf).withColumn("reel_engagement", F.lit(0).cast("long"))
         .withColumn("story_engagement", F.lit(0).cast("long")))
    return d.select(*KEY, X.engagement_rate().alias("engagement_rate_fn"))


@register("fn23", doubles=("share_posts", "share_reels", "share_stories", "avg_hashtags"),
          sql=q(f"SELECT username, date, {_SH['posts']} AS share_posts, {_SH['reels']} AS share_reels, "
                f"{_SH['stories']} AS share_stories, {sdiv('hashtags_used', 'posts')} AS avg_hashtags FROM f1", "f1"))
def fn23(spark, sf):
    """FN23 daily content shares and hashtags per post."""
    d = FX.daily_metrics(spark, sf)
    return d.select(*KEY, *[v.alias(k) for k, v in X.content_share_columns().items()],
                    X.avg_hashtags().alias("avg_hashtags"))


@register("fn24", sql=q(f"SELECT username, week_start, {_fmt_sql('followers')} AS value_fmt, "
                        f"CASE WHEN prev IS NULL THEN NULL ELSE {_fmt_sql('(followers - prev)')} END AS delta_fmt, "
                        f"CASE WHEN prev IS NULL OR followers - prev >= 0 THEN 'normal' ELSE 'inverse' END AS delta_color "
                        f"FROM (SELECT username, week_start, followers, LAG(followers) OVER (PARTITION BY username "
                        f"ORDER BY week_start) AS prev FROM wk) a", "f1", extra=weekly_ctes("f1")))
def fn24(spark, sf):
    """FN24 metric card per creator-week: formatted followers and delta to the previous week."""
    from ..operators.report import metric_card
    w = W.create_weekly_features(FX.daily_metrics(spark, sf))
    return metric_card(w, "followers", order="week_start").select(
        "username", "week_start", "value_fmt", "delta_fmt", "delta_color")
