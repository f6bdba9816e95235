"""Registered queries: scoring SC1-SC8, report data RP1-RP7, remaining
aggregates (AG4, AG8-AG11, AG13, AG14), sources / sinks / catalog, streams.

Round-trip queries write to a fresh folder below the shared checkpoint
directory (``session.scratch_path``) and read back through the library's
readers; their oracle states the same rows from the driver's tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..operators import aggregates as A
from ..operators import models as M
from ..operators import report as R
from ..operators import score as SC
from ..operators import weekly as W
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources import io as IO
from ..streaming import stream as ST
from . import sql_clean as S
from .q_eval import PRED_CTE, predictions, qp
from .q_models import MF_SQL, PRED_SQL, _MARGIN, fixed_model, model_frame
from .registry import register
from .sqlparts import q, sdiv, weekly_ctes, weekly_feature_ctes

REQ_FIELDS = ["weekly_posting_frequency", "share_posts", "share_reels", "share_stories", "engagement_rate",
              "avg_hashtag_count", "roi_follows_per_hour", "minutes_spent", "month", "quarter"]


def requests(spark, sf):
    """Stand-in request rows: one per creator-week from the weekly features (request schema)."""
    w = W.weekly_feature_table(FX.daily_metrics(spark, sf))
    return w.select("username", "week_start", "weekly_posting_frequency", "share_posts", "share_reels",
                    "share_stories", "engagement_rate", "avg_hashtag_count", "roi_follows_per_hour", "minutes_spent",
                    F.month("week_start").alias("month"), F.quarter("week_start").alias("quarter"))


REQ_CTE = weekly_feature_ctes("f1") + (
    ",\nrq AS (SELECT username, week_start, " + ", ".join(REQ_FIELDS[:-2]) +
    ", CAST(month(week_start) AS INTEGER) AS month, CAST(quarter(week_start) AS INTEGER) AS quarter FROM wf)")


def _reasons_sql():
    parts = []
    for name, default, lo, hi in C.REQUEST_FIELDS:
        if name not in REQ_FIELDS:
            continue
        if lo is not None:
            parts.append(f"CASE WHEN {name} < {lo} THEN '{name}: below {lo}' END")
        if hi is not None:
            parts.append(f"CASE WHEN {name} > {hi} THEN '{name}: above {hi}' END")
    return "concat_ws('; ', " + ", ".join(parts) + ")"


def _score_sql(src: str) -> str:
    """SC1-SC5 in SQL over a request CTE ``src``."""
    s = "(share_posts + share_reels + share_stories)"
    norm = {c: f"CASE WHEN ABS({s} - 1.0) > 0.01 AND {s} > 0 THEN {c} / {s} ELSE CAST({c} AS DOUBLE) END"
            for c in C.SHARE_COLUMNS}
    cat = ("CASE WHEN predicted_growth IS NULL THEN NULL " + " ".join(
        f"WHEN predicted_growth >= {t} THEN '{lab}'" for t, lab in C.GROWTH_CATEGORIES) +
        f" ELSE '{C.GROWTH_CATEGORY_FLOOR}' END")
    rec = ("CASE WHEN predicted_growth IS NULL THEN NULL ELSE COALESCE(NULLIF(concat_ws('; ', CASE WHEN "
           "weekly_posting_frequency < 5 THEN 'Consider increasing posting frequency' WHEN weekly_posting_frequency > 15 "
           "THEN 'Monitor for posting saturation' END, CASE WHEN share_reels < 0.4 THEN 'Increase reels content for "
           "better reach' END, CASE WHEN engagement_rate < 0.03 THEN 'Focus on improving engagement quality' END, CASE "
           "WHEN predicted_growth < 0 THEN 'Review content strategy immediately' WHEN predicted_growth < 100 THEN "
           f"'Optimize posting timing and consistency' END), ''), '{C.DEFAULT_RECOMMENDATION}') END")
    pred = "(-5.0 + 2.5 * weekly_posting_frequency - 4.0 * share_reels + 3.0 * share_posts)"
    return (f"sc0 AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in norm.items())}), {_reasons_sql()} "
            f"AS reasons FROM {src}),\n"
            f"sc1 AS (SELECT *, CASE WHEN reasons = '' THEN {pred} END AS predicted_growth, reasons = '' AS accepted "
            f"FROM sc0),\n"
            f"sc AS (SELECT *, predicted_growth - {_MARGIN!r} AS confidence_interval_lower, predicted_growth + "
            f"{_MARGIN!r} AS confidence_interval_upper, {cat} AS growth_category, {rec} AS recommendation FROM sc1)")


SC_OUT = ["predicted_growth", "confidence_interval_lower", "confidence_interval_upper", "growth_category",
          "recommendation", "accepted"]
SC_D = ("predicted_growth", "confidence_interval_lower", "confidence_interval_upper")


@register("sc1", doubles=("post_consistency_variance_7d",),
          sql=q("SELECT username, week_start, 0.0 AS post_consistency_variance_7d, 0 AS posted_in_optimal_window, "
                "0 AS saturation_flag FROM rq", "f1", extra=REQ_CTE))
def sc1(spark, sf):
    """SC1 request defaults for the optional fields the rows do not carry."""
    return SC.apply_request_defaults(requests(spark, sf)).select(
        "username", "week_start", F.col("post_consistency_variance_7d").cast("double").alias("post_consistency_variance_7d"),
        F.col("posted_in_optimal_window").cast("int").alias("posted_in_optimal_window"),
        F.col("saturation_flag").cast("int").alias("saturation_flag"))


def _skewed_requests(spark, sf):
    """Stand-in with shares that do not sum to 1 (stories scaled by the supplier number mod 3 + 1)."""
    r = requests(spark, sf)
    k = F.pmod(F.regexp_extract("username", r"(\d+)$", 1).cast("long"), F.lit(3)) + 1
    return r.withColumn("share_stories", F.col("share_stories") * k)


@register("sc2", doubles=("share_posts", "share_reels", "share_stories"),
          sql=q("SELECT username, week_start, CASE WHEN ABS(s - 1.0) > 0.01 AND s > 0 THEN share_posts / s ELSE share_posts "
                "END AS share_posts, CASE WHEN ABS(s - 1.0) > 0.01 AND s > 0 THEN share_reels / s ELSE share_reels END AS "
                "share_reels, CASE WHEN ABS(s - 1.0) > 0.01 AND s > 0 THEN share_stories / s ELSE share_stories END AS "
                "share_stories FROM (SELECT *, share_posts + share_reels + share_stories AS s FROM (SELECT * REPLACE "
                "(share_stories * ((CAST(regexp_extract(username, '(\\d+)$', 1) AS BIGINT) % 3) + 1) AS share_stories) "
                "FROM rq) a) b", "f1", extra=REQ_CTE))
def sc2(spark, sf):
    """SC2 request share normalisation when the shares are off 1 by more than .01."""
    return SC.normalise_request_shares(_skewed_requests(spark, sf)).select(
        "username", "week_start", "share_posts", "share_reels", "share_stories")


@register("sc3", sql=qp("SELECT username, date, " + ("CASE " + " ".join(
    f"WHEN y_pred >= {t} THEN '{lab}'" for t, lab in C.GROWTH_CATEGORIES) + f" ELSE '{C.GROWTH_CATEGORY_FLOOR}' END") +
    " AS growth_category FROM pred"))
def sc3(spark, sf):
    """SC3 growth category of each prediction."""
    from ..functions import exprs as X
    return predictions(spark, sf).select("username", "date", X.growth_category("y_pred").alias("growth_category"))


@register("sc5", doubles=SC_D, sql=q("SELECT username, week_start, " + ", ".join(SC_OUT) + " FROM sc", "f1",
                                     extra=REQ_CTE + ",\n" + _score_sql("rq")))
def sc5(spark, sf):
    """SC5 batch prediction: defaults, bounds, shares, interval, category, advice (one codegen stage)."""
    return SC.predict_batch(requests(spark, sf), fixed_model()).select("username", "week_start", *SC_OUT)


@register("sc4", sql=q("SELECT username, week_start, recommendation FROM sc", "f1",
                       extra=REQ_CTE + ",\n" + _score_sql("rq")))
def sc4(spark, sf):
    """SC4 recommendation text rules joined by '; '."""
    return SC.predict_batch(requests(spark, sf), fixed_model()).select("username", "week_start", "recommendation")


@register("sc6", doubles=SC_D,
          sql=q("SELECT " + ", ".join(SC_OUT) + " FROM sc", "f1",
                extra=REQ_CTE + ",\nrq1 AS (SELECT " + ", ".join(f"AVG({c}) AS {c}" for c in REQ_FIELDS[:-2]) +
                ", CAST(1 AS INTEGER) AS month, CAST(1 AS INTEGER) AS quarter FROM rq),\n" + _score_sql("rq1")))
def sc6(spark, sf):
    """SC6 single prediction: one request row (the average creator-week of the table)."""
    fields = requests(spark, sf).agg(*[F.avg(c).alias(c) for c in REQ_FIELDS[:-2]]).first().asDict()
    return SC.predict_single(spark, fixed_model(), **fields, month=1, quarter=1).select(*SC_OUT)


@register("sc7")
def sc7(spark, sf):
    """SC7 model status / feature list of a model fitted on the weekly table (rows-only)."""
    m = M.fit_model(model_frame(spark, sf), "linear", validate=False)
    return SC.model_status(spark, m)


LATEST_CTE = ("base AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY username ORDER BY week_start DESC) "
              "AS rn FROM rq) x WHERE rn = 1),\nmix AS (SELECT * FROM (VALUES " + ", ".join(
                  f"('{n}', {a}, {b}, {c})" for n, a, b, c in SC.SCENARIO_MIXES) +
              ") v(scenario, share_posts, share_reels, share_stories)),\nswp AS (SELECT base.* EXCLUDE (rn, share_posts, "
              "share_reels, share_stories), mix.* FROM base, mix)")


@register("sc8", doubles=SC_D, sql=q("SELECT username, scenario, " + ", ".join(SC_OUT) + " FROM sc", "f1",
                                     extra=REQ_CTE + ",\n" + LATEST_CTE + ",\n" + _score_sql("swp")))
def sc8(spark, sf):
    """SC8 scenario sweep: each creator's latest week under three content mixes."""
    r = requests(spark, sf)
    latest = r.withColumn("_rn", F.row_number().over(Window.partitionBy("username").orderBy(F.col("week_start").desc())))
    base = latest.where(F.col("_rn") == 1).drop("_rn")
    return SC.scenario_sweep(base, fixed_model()).select("username", "scenario", *SC_OUT)


# ---------------------------------------------------------------- reports
@register("rp1", doubles=("y_true", "y_pred", "lower_bound", "upper_bound"),
          sql=qp(f"SELECT username, date, y_true, y_pred, y_pred - {_MARGIN!r} AS lower_bound, y_pred + {_MARGIN!r} AS "
                 "upper_bound FROM pred"))
def rp1(spark, sf):
    """RP1 growth history series: actual, predicted and interval bounds by date."""
    pred = predictions(spark, sf)
    margin = F.lit(_MARGIN)
    return R.growth_history(pred.withColumn("lower_bound", F.col("y_pred") - margin)
                            .withColumn("upper_bound", F.col("y_pred") + margin))


@register("rp2", sql=q("SELECT username, date, posts, reels, stories, posts + reels + stories AS total_content FROM f2", "f2"))
def rp2(spark, sf):
    """RP2 posting trend: the three stacked daily counts (F2)."""
    return R.posting_trend(FX.daily_dense(spark, sf))


@register("rp3", doubles=("share",),
          sql=q("SELECT engagement_type, total, total / CAST(SUM(total) OVER () AS DOUBLE) AS share FROM (SELECT "
                "UNNEST(['post_likes', 'comments', 'saves', 'shares']) AS engagement_type, UNNEST([CAST(SUM(post_likes) AS "
                "BIGINT), CAST(SUM(comments) AS BIGINT), CAST(SUM(saves) AS BIGINT), CAST(SUM(shares) AS BIGINT)]) AS total "
                "FROM f1) t", "f1"))
def rp3(spark, sf):
    """RP3 / AG4 engagement breakdown: totals by type and share of the total."""
    return R.engagement_breakdown(FX.daily_metrics(spark, sf))


@register("rp4", doubles=("bin_left",),
          sql=qp("SELECT bin, COUNT(*) AS n, MIN(lo) + bin * (MIN(hi) - MIN(lo)) / 30 AS bin_left FROM (SELECT CASE WHEN "
                 "(hi - lo) / 30 > 0 THEN CAST(LEAST(FLOOR((e - lo) / ((hi - lo) / 30)), 29) AS INTEGER) ELSE 0 END AS "
                 "bin, lo, hi FROM pe, (SELECT MIN(e) AS lo, MAX(e) AS hi FROM pe) z) b GROUP BY bin"))
def rp4(spark, sf):
    """RP4 residual histogram (30 equal-width bins)."""
    return R.residual_histogram(predictions(spark, sf), 30)


@register("rp4s", doubles=("fitted", "residual", "standardized"),
          sql=qp("SELECT username, date, p AS fitted, e AS residual, e / NULLIF(s, 0) AS standardized FROM pe, "
                 "(SELECT STDDEV_POP(e) AS s FROM pe) z"))
def rp4s(spark, sf):
    """RP4 residual series by fitted value and by date."""
    return R.residual_series(predictions(spark, sf))


@register("rp4p", doubles=("fitted", "residual", "standardized"),
          sql=qp("SELECT band, username, date, fitted, residual, standardized FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY band ORDER BY "
                 "md5(username || '|' || CAST(date AS VARCHAR)), username, date) AS n FROM (SELECT username, date, p AS fitted, e AS residual, "
                 "e / NULLIF(STDDEV_POP(e) OVER (), 0) AS standardized, CAST(LEAST(floor((p - MIN(p) OVER ()) / ((MAX(p) OVER () - MIN(p) OVER ()) / 20)), 19) "
                 "AS INTEGER) AS band FROM pe) a) b WHERE n <= 100"))
def rp4p(spark, sf):
    """RP4 sampled scatter: up to 100 residuals from each of 20 bands of the fitted value, by smallest digest."""
    return R.residual_sample(predictions(spark, sf))


@register("rp5l")
def rp5l(spark, sf):
    """RP5 reference line of the residuals' Q-Q points (rows-only)."""
    return R.qq_line(R.qq_points(predictions(spark, sf)))


@register("rp5")
def rp5(spark, sf):
    """RP5 Q-Q points of the residuals (rows-only; the importance bars are ML12, the interval series ML10)."""
    return R.qq_points(predictions(spark, sf))


@register("rp5b")
def rp5b(spark, sf):
    """RP5 importance bars of the OLS fit on the weekly table (rows-only)."""
    return R.importance_bars(M.fit_model(model_frame(spark, sf), "linear", validate=False), spark)


@register("rp5i", doubles=("prediction", "lower", "upper", "actual"),
          sql=q(f"SELECT week_start, AVG({PRED_SQL}) AS prediction, AVG({PRED_SQL} - {_MARGIN!r}) AS lower, AVG({PRED_SQL} + {_MARGIN!r}) AS upper, "
                "AVG(weekly_growth) AS actual, COUNT(*) AS n_rows FROM wf GROUP BY week_start", "f1", extra=weekly_feature_ctes("f1")))
def rp5i(spark, sf):
    """RP5 prediction interval series: prediction, interval and actual growth by week."""
    return R.interval_series(fixed_model().predict_with_confidence(W.weekly_feature_table(FX.daily_metrics(spark, sf))))


@register("cat2", sql=q("SELECT 'processed' AS zone, username, COUNT(*) AS n_weeks FROM wk GROUP BY username UNION ALL "
                        "SELECT 'interim', username, COUNT(*) FROM f1 GROUP BY username", "f1", extra=weekly_ctes("f1")))
def cat2(spark, sf):
    """CAT2 data zones: tables saved at their zone's path and found there again."""
    root, daily = _scratch(spark, "zones"), FX.daily_metrics(spark, sf)
    tables = {"processed": W.create_weekly_features(daily), "interim": daily}
    out = None
    for zone, table in tables.items():
        path = IO.get_data_path(root, zone)
        IO.save_dataframe(table.select("username"), path)
        found = spark.read.parquet(IO.current_version(spark, path)).groupBy("username").agg(F.count(F.lit(1)).alias("n_weeks"))
        found = found.select(F.lit(zone).alias("zone"), "username", "n_weeks")
        out = found if out is None else out.unionByName(found)
    return out


@register("rp6", doubles=("x", "y_trend", "slope", "intercept"),
          sql=q("SELECT k, x_min + k * (x_max - x_min) / 99 AS x, intercept + slope * (x_min + k * (x_max - x_min) / 99) "
                "AS y_trend, slope, intercept FROM (SELECT regr_slope(roi_follows_per_hour, weekly_posting_frequency) AS "
                "slope, regr_intercept(roi_follows_per_hour, weekly_posting_frequency) AS intercept, "
                "CAST(MIN(weekly_posting_frequency) AS DOUBLE) AS x_min, CAST(MAX(weekly_posting_frequency) AS DOUBLE) "
                "AS x_max FROM wf) f, (SELECT CAST(range AS INTEGER) AS k FROM range(100)) r", "f1",
                extra=weekly_feature_ctes("f1")))
def rp6(spark, sf):
    """RP6 ROI vs frequency with a degree-1 trend and its 100-point line."""
    return R.roi_vs_frequency(W.weekly_feature_table(FX.daily_metrics(spark, sf)))


@register("rp7", doubles=("posts_pct", "reels_pct", "stories_pct"),
          sql=q("SELECT username, week_start, share_posts * 100 AS posts_pct, share_reels * 100 AS reels_pct, "
                "share_stories * 100 AS stories_pct, weekly_growth FROM wf", "f1", extra=weekly_feature_ctes("f1")))
def rp7(spark, sf):
    """RP7 content-mix points (shares x 100) with growth."""
    return R.content_mix_points(W.weekly_feature_table(FX.daily_metrics(spark, sf)))


@register("rp8", sql=q("SELECT username, week_start, weekly_posting_frequency, weekly_growth FROM wk", "f1",
                       extra=weekly_ctes("f1")))
def rp8(spark, sf):
    """RP2 weekly comparison: frequency and growth by creator-week."""
    return R.weekly_comparison(W.create_weekly_features(FX.daily_metrics(spark, sf)))


# ---------------------------------------------------------------- aggregates
AG8_P = (0.05, 0.25, 0.5, 0.75, 0.95)


@register("ag8", doubles=("p", "value"),
          sql=q(" UNION ALL ".join(f"SELECT {p} AS p, quantile_cont(weekly_growth, {p}) AS value FROM wk" for p in AG8_P),
                "f1", extra=weekly_ctes("f1")))
def ag8(spark, sf):
    """AG8 exact percentiles of weekly growth (linear interpolation)."""
    return A.percentiles(W.create_weekly_features(FX.daily_metrics(spark, sf)), "weekly_growth", AG8_P)


AG9_COLS = ["weekly_posting_frequency", "engagement_rate", "roi_follows_per_hour", "weekly_growth"]


@register("ag9", doubles=("correlation",),
          sql=q(" UNION ALL ".join(
              f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, COVAR_POP({a}, {b}) / NULLIF(STDDEV_POP({a}) * "
              f"STDDEV_POP({b}), 0) AS correlation FROM wf" for a in AG9_COLS for b in AG9_COLS), "f1",
              extra=weekly_feature_ctes("f1")))
def ag9(spark, sf):
    """AG9 Pearson correlation matrix (one aggregate of moments, T2-safe)."""
    return A.pearson_matrix(W.weekly_feature_table(FX.daily_metrics(spark, sf)), AG9_COLS)


def _avg_rank_sql(c):
    return (f"(RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0)")


@register("ag9s", doubles=("correlation",),
          sql=q(" UNION ALL ".join(
              f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, COVAR_POP(ra_{i}, ra_{j}) / NULLIF(STDDEV_POP(ra_{i}) * "
              f"STDDEV_POP(ra_{j}), 0) AS correlation FROM rk" for i, a in enumerate(AG9_COLS)
              for j, b in enumerate(AG9_COLS)), "f1",
              extra=weekly_feature_ctes("f1") + ",\nrk AS (SELECT " + ", ".join(
                  f"{_avg_rank_sql(c)} AS ra_{i}" for i, c in enumerate(AG9_COLS)) + " FROM (SELECT " + ", ".join(
                  f"ROUND(CAST({c} AS DOUBLE), 9) AS {c}" for c in AG9_COLS) + " FROM wf) z)"))
def ag9s(spark, sf):
    """AG9 Spearman matrix: Pearson of distributed average ranks of values at 9 decimals (equal values tie)."""
    w = W.weekly_feature_table(FX.daily_metrics(spark, sf))
    w = w.select("username", "week_start", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in AG9_COLS])
    return A.spearman_matrix(w, AG9_COLS, ["username", "week_start"])


AG9K_COLS = ["weekly_posting_frequency", "posting_consistency_days", "max_gap_days", "weekly_growth"]


def _tau_sql(a, b):
    two = lambda n: f"SUM({n} * ({n} - 1)) / 2"
    return (f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, (n0 - n1 - n2 + n3 - 2.0 * d) / NULLIF(SQRT(1.0 * (n0 - n1) * (n0 - n2)), 0) "
            f"AS correlation FROM (SELECT SUM(c) * (SUM(c) - 1) / 2 AS n0, {two('c')} AS n3 FROM (SELECT {a} AS x, {b} AS y, COUNT(*) AS c FROM wf "
            f"GROUP BY 1, 2) p), (SELECT {two('c')} AS n1 FROM (SELECT COUNT(*) AS c FROM wf GROUP BY {a}) p), "
            f"(SELECT {two('c')} AS n2 FROM (SELECT COUNT(*) AS c FROM wf GROUP BY {b}) p), "
            f"(SELECT COALESCE(SUM(p.c * o.c), 0) AS d FROM (SELECT {a} AS x, {b} AS y, COUNT(*) AS c FROM wf GROUP BY 1, 2) p JOIN "
            f"(SELECT {a} AS x, {b} AS y, COUNT(*) AS c FROM wf GROUP BY 1, 2) o ON p.x < o.x AND p.y > o.y)")


@register("ag9k", doubles=("correlation",),
          sql=q(" UNION ALL ".join(_tau_sql(a, b) for a in AG9K_COLS for b in AG9K_COLS), "f1", extra=weekly_feature_ctes("f1")))
def ag9k(spark, sf):
    """AG9 Kendall's tau-b matrix: inversions counted in ranges, no pairs (the SQL twin joins pairs of distinct points)."""
    return A.kendall_matrix(W.weekly_feature_table(FX.daily_metrics(spark, sf)), AG9K_COLS)


@register("ag10")
def ag10(spark, sf):
    """AG10 95 % confidence interval of mean weekly growth (t quantile on the driver; rows-only)."""
    return A.confidence_interval(W.create_weekly_features(FX.daily_metrics(spark, sf)), "weekly_growth")


@register("ag11", doubles=("total_growth", "average_change", "growth_rate", "volatility"),
          sql=q("SELECT username, arg_max(v, date) - arg_min(v, date) AS total_growth, AVG(step) AS average_change, "
                "CASE WHEN arg_min(v, date) > 0 AND COUNT(*) - 1 > 0 THEN POW(arg_max(v, date) / arg_min(v, date), 1.0 / "
                "(COUNT(*) - 1)) - 1 ELSE 0.0 END AS growth_rate, STDDEV_POP(step) AS volatility, COUNT(*) AS periods FROM "
                "(SELECT username, date, CAST(followers AS DOUBLE) AS v, followers - LAG(followers) OVER (PARTITION BY "
                "username ORDER BY date) AS step FROM f1) s GROUP BY username", "f1"))
def ag11(spark, sf):
    """AG11 growth metrics per creator: total, mean step, compound rate, volatility, periods."""
    return A.growth_metrics(FX.daily_metrics(spark, sf))


@register("ag13", doubles=("range",),
          sql=qp("SELECT CAST(arg_min(m, mae) AS INTEGER) AS best, CAST(arg_max(m, mae) AS INTEGER) AS worst, MAX(mae) - "
                 "MIN(mae) AS range FROM (SELECT month(date) AS m, AVG(ae) AS mae FROM pe GROUP BY 1) x"))
def ag13(spark, sf):
    """AG13 best and worst calendar month by MAE (min_by / max_by)."""
    from ..operators.kpi import monthly_errors
    return A.best_worst(monthly_errors(predictions(spark, sf)), "month", "mae")


@register("ag14")
def ag14(spark, sf):
    """AG14 top-5 features by absolute coefficient (rows-only)."""
    m = M.fit_model(model_frame(spark, sf), "linear", validate=False)
    return m.feature_importance(spark).orderBy(F.col("abs_coefficient").desc()).limit(5)


CAT3_COLS = ["posts", "reels", "stories", "reach", "engagement_rate", "followers"]


@register("cat3", doubles=("mean", "std", "min", "q25", "q50", "q75", "max"),
          sql=q(" UNION ALL ".join(
              f"SELECT '{c}' AS column, COUNT({c}) AS count, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
              f"AS nulls, AVG(CAST({c} AS DOUBLE)) AS mean, STDDEV_SAMP(CAST({c} AS DOUBLE)) AS std, CAST(MIN({c}) AS "
              f"DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) "
              f"AS q50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, CAST(MAX({c}) AS DOUBLE) AS max FROM f3"
              for c in CAT3_COLS), "f3"))
def cat3(spark, sf):
    """CAT3 data summary (describe) of the damaged raw table, one aggregate + exact quartiles."""
    return A.data_summary(FX.daily_dirty(spark, sf).select(*CAT3_COLS))


# ---------------------------------------------------------------- sources / sinks
def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


RAW_TEXT_SQL = ("SELECT username, CAST(try_strptime(date, '%d-%m-%Y') AS DATE) AS date, followers, posts, reels, stories, "
                "reach, engagement_rate, post_time FROM f3")


@register("src1", doubles=("engagement_rate",), sql=q(RAW_TEXT_SQL, "f3"))
def src1(spark, sf):
    """SRC1 + SNK1: F3 written as CSV (versioned folder), read back by load_raw_data (d-M-yyyy dates)."""
    raw = FX.daily_dirty(spark, sf).select("username", "date", "followers", "posts", "reels", "stories", "reach",
                                           "engagement_rate", "post_time")
    path = IO.save_dataframe(raw, _scratch(spark, "raw"), "csv")
    df, _, _ = IO.load_raw_data(spark, path, validate=False)
    return df.select("username", "date", "followers", "posts", "reels", "stories", "reach", "engagement_rate", "post_time")


@register("src2", doubles=("share_posts", "roi_score"),
          sql=q("SELECT username, week_start, weekly_posting_frequency, weekly_growth, share_posts, roi_score FROM wf", "f1",
                extra=weekly_feature_ctes("f1")))
def src2(spark, sf):
    """SRC2 + SNK3: the weekly feature table saved as parquet and loaded back (validated, returned anyway)."""
    w = W.weekly_feature_table(FX.daily_metrics(spark, sf)).select(
        "username", "week_start", "weekly_posting_frequency", "weekly_growth", "share_posts", "roi_score")
    path = IO.save_dataframe(w, _scratch(spark, "processed"), "parquet")
    df, _ = IO.load_processed_data(spark, path, "core")
    return df


@register("src3", doubles=("value",),
          sql=qp("SELECT UNNEST(['rmse', 'mae']) AS metric, UNNEST([SQRT(AVG((y - baseline_pred) * (y - baseline_pred))), "
                 "AVG(ABS(y - baseline_pred))]) AS value FROM pe"))
def src3(spark, sf):
    """SRC3: a benchmark-metrics CSV (from the naive baseline) written and read with inferred schema."""
    pred = predictions(spark, sf)
    b = pred.agg(F.sqrt(F.avg((F.col("y_true") - F.col("baseline_pred")) ** 2)).alias("rmse"),
                 F.avg(F.abs(F.col("y_true") - F.col("baseline_pred"))).alias("mae"))
    long = b.select(F.explode(F.array(F.struct(F.lit("rmse").alias("metric"), F.col("rmse").alias("value")),
                                      F.struct(F.lit("mae").alias("metric"), F.col("mae").alias("value")))).alias("x")
                    ).select("x.*")
    path = IO.save_dataframe(long, _scratch(spark, "external"), "csv")
    return IO.load_external_data(spark, path).select("metric", F.col("value").cast("double").alias("value"))


@register("src4", sql=q("SELECT CASE WHEN week_start < (SELECT d FROM (SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS pos, "
                        "COUNT(*) OVER () AS n FROM (SELECT DISTINCT week_start AS d FROM wk) x) r WHERE pos = "
                        "CAST(floor(n * 0.8) AS BIGINT)) THEN 'train' ELSE 'test' END AS split, COUNT(*) AS n_rows FROM wk "
                        "GROUP BY 1", "f1", extra=weekly_ctes("f1")))
def src4(spark, sf):
    """SRC4 + SNK2: 80/20 time split saved as two parquet folders and loaded back."""
    from ..operators import validate as V
    w = V.train_test_split_by_time(W.create_weekly_features(FX.daily_metrics(spark, sf)), 0.2)
    root = _scratch(spark, "split")
    IO.save_train_test_split(w.where(F.col("split") == "train"), w.where(F.col("split") == "test"), root)
    tr, te = IO.load_train_test_data(spark, root)
    return tr.unionByName(te).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("src5", sql=q("SELECT username, CAST(COUNT(*) AS BIGINT) AS n_days, CAST(SUM(posts) AS BIGINT) AS posts FROM f2 "
                        "GROUP BY username", "f2"))
def src5(spark, sf):
    """SRC5 format dispatch: JSON round trip of F2 via load_dataframe."""
    d = FX.daily_dense(spark, sf).select("username", "date", "posts")
    path = IO.save_dataframe(d, _scratch(spark, "any") + ".json", "json")
    back = IO.load_dataframe(spark, path, "json")
    return back.groupBy("username").agg(F.count(F.lit(1)).alias("n_days"), F.sum("posts").cast("long").alias("posts"))


@register("src5a", sql=q("SELECT username, CAST(COUNT(*) AS BIGINT) AS n_days, CAST(SUM(posts) AS BIGINT) AS posts FROM f2 "
                         "GROUP BY username", "f2"))
def src5a(spark, sf):
    """SRC5 / SNK3 records arrays: F2 written as JSON arrays, read back cut at record borders."""
    d = FX.daily_dense(spark, sf).select("username", "date", "posts")
    path = IO.save_dataframe(d, _scratch(spark, "array") + ".json", "records")
    back = IO.load_dataframe(spark, path, "json")
    return back.groupBy("username").agg(F.count(F.lit(1)).alias("n_days"), F.sum("posts").cast("long").alias("posts"))


@register("snk4")
def snk4(spark, sf):
    """SNK4 model table save + load round trip: coefficients of the restored model (rows-only)."""
    m = M.fit_model(model_frame(spark, sf), "ridge", validate=False)
    path = IO.save_model(m, spark, _scratch(spark, "model"))
    return IO.load_model(spark, path).coefficient_table(spark)


@register("cat1")
def cat1(spark, sf):
    """CAT1 dataset listing per zone (binaryFile path listing; rows-only)."""
    root = _scratch(spark, "catalog")
    import os
    IO.save_dataframe(FX.daily_dense(spark, sf).select("username", "date"), os.path.join(root, "raw", "events_daily"))
    IO.save_dataframe(FX.daily_dense(spark, sf).select("username"), os.path.join(root, "processed", "users"))
    return IO.list_available_datasets(spark, root)


# ---------------------------------------------------------------- streams
@register("sc5_stream", doubles=SC_D, sql=q("SELECT username, week_start, " + ", ".join(SC_OUT) + " FROM sc", "f1",
                                            extra=REQ_CTE + ",\n" + _score_sql("rq")))
def sc5_stream(spark, sf):
    """SC5 on Structured Streaming: request rows arrive as parquet files, scored by the same code."""
    r = requests(spark, sf)
    src = _scratch(spark, "req_stream")
    r.write.parquet(src)
    name = f"scored_{uuid.uuid4().hex[:8]}"
    out = ST.score_stream(spark, src, r.schema, fixed_model(), name)
    return out.select("username", "week_start", *SC_OUT)


@register("ag1_stream",
          sql=q("SELECT username, week_start, " + ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in
                                                             ["posts", "reels", "stories", "growth", "follows", "unfollows",
                                                              "reach"]) +
                " FROM dw GROUP BY username, week_start", "f2",
                extra=weekly_ctes("f2", sums=["posts"], means=[], followers=False, post_time=False)))
def ag1_stream(spark, sf):
    """AG1 weekly sums on a stream of the dense daily table: every week, late days included."""
    d = FX.daily_dense(spark, sf)
    src = _scratch(spark, "daily_stream")
    d.write.parquet(src)
    name = f"weekly_{uuid.uuid4().hex[:8]}"
    out = ST.weekly_stream(spark, src, d.schema, name)
    return out.select("username", "week_start", "posts", "reels", "stories", "growth", "follows", "unfollows", "reach")


@register("ag1_late", doubles=("engagement_rate", "avg_hashtag_count", "roi_follows_per_hour",
                               "posting_consistency_variance", "posting_regularity_score"),
          sql=q("SELECT * FROM wk", "f1", extra=weekly_ctes("f1")))
def ag1_late(spark, sf):
    """AG1 whole on a stream: a quarter of the days, spread over all weeks, comes a run after the others."""
    days = _scratch(spark, "late_days")
    FX.daily_metrics(spark, sf).write.parquet(days)
    d = spark.read.parquet(days)
    src, name = _scratch(spark, "late_stream"), f"weeks_{uuid.uuid4().hex[:8]}"
    late = F.pmod(F.xxhash64("username", "date"), F.lit(4)) == 0
    d.where(~late).write.parquet(src)
    ST.weekly_stream(spark, src, d.schema, name)
    d.where(late).write.mode("append").parquet(src)
    return ST.weekly_stream(spark, src, d.schema, name)


# ---------------------------------------------------------------- inventory IDs whose work lives in another query
def _alias(new: str, old: str, doc: str):
    from .registry import REGISTRY, Query
    q0 = REGISTRY[old]
    REGISTRY[new] = Query(new, q0.fn, q0.sql, q0.doubles, doc, q0.raw)


_alias("ag4", "rp3", "AG4 engagement totals by type and share of the total (computed by RP3).")
_alias("ag5", "kp2", "AG5 conditional accuracy buckets (computed by KP2).")
_alias("ag6", "kp9", "AG6 overlapping categories via explode (computed by KP9).")
_alias("ag7", "kp12", "AG7 threshold agreement with a broadcast 6-row table (computed by KP12).")
_alias("wn12", "dg2", "WN12 residual sum of squared steps per creator (computed by DG2).")
_alias("jn3", "kp15", "JN3 metric-to-benchmark inner join on metric (computed by KP15).")
_alias("snk1", "src1", "SNK1 versioned CSV write (round trip with SRC1).")
_alias("snk2", "src4", "SNK2 train/test split write (round trip with SRC4).")
_alias("snk3", "src5", "SNK3 format-dispatched write (JSON round trip with SRC5).")


@register("wn10", sql=qp("SELECT seg, COUNT(*) AS n_rows, MIN(date) AS date_from, MAX(date) AS date_to FROM (SELECT date, "
                         "CASE WHEN date < (SELECT d FROM (SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS pos, COUNT(*) "
                         "OVER () AS nd FROM (SELECT DISTINCT date AS d FROM pe) x) r WHERE pos = LEAST(nd - 1, (nd * 1) // 5)) "
                         "THEN 'first_fifth' WHEN date >= (SELECT d FROM (SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS "
                         "pos, COUNT(*) OVER () AS nd FROM (SELECT DISTINCT date AS d FROM pe) x) r WHERE pos = LEAST(nd - "
                         "1, (nd * 4) // 5)) THEN 'last_fifth' ELSE 'middle' END AS seg FROM pe) s GROUP BY seg"))
def wn10(spark, sf):
    """WN10 position split on the distinct dates: first fifth, middle, last fifth."""
    from ..operators.kpi import date_cut
    pred = predictions(spark, sf)
    early, late = date_cut(pred, 1, 5), date_cut(pred, 4, 5)
    seg = (F.when(F.col("date") < F.lit(early), "first_fifth").when(F.col("date") >= F.lit(late), "last_fifth")
           .otherwise("middle"))
    return pred.groupBy(seg.alias("seg")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("date_from"),
                                              F.max("date").alias("date_to"))


@register("wn9")
def wn9(spark, sf):
    """WN9 average descending rank of the compared models by CV R2 (rows-only)."""
    rows = M.compare_models(model_frame(spark, sf))
    return spark.createDataFrame([(r["model_type"], r["cv_r2_mean"], r["rank"]) for r in rows],
                                 "model_type string, cv_r2_mean double, rank double")


# ---------------------------------------------------------------- KP18
COMP_CLASSES = [("comp_posts", "1-URGENT"), ("comp_reels", "2-HIGH"), ("comp_stories", "3-MEDIUM")]
MAX_BROADCAST_DAYS = 100_000  # a per-day table is bounded by the calendar; checked before the hint


def _daily_with_competitors(spark, sf):
    """Stand-in competitor cadence: per-day order counts by priority class (from ``orders``)."""
    o = spark.read.parquet(f"{sf.rstrip('/')}/orders.parquet").select("o_orderdate", "o_orderpriority")
    comp = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        *[F.sum((F.col("o_orderpriority") == p).cast("long")).alias(c) for c, p in COMP_CLASSES])
    n_days = comp.count()
    comp_side = F.broadcast(comp) if n_days <= MAX_BROADCAST_DAYS else comp
    d = FX.daily_metrics(spark, sf).join(comp_side, "date", "left")
    return d.fillna(0, subset=[c for c, _ in COMP_CLASSES])


@register("kp18", doubles=("content_ratio",),
          sql=q("SELECT username, week_start, own_content, competitor_content, own_content - competitor_content AS "
                "content_difference, CASE WHEN competitor_content <> 0 THEN own_content / CAST(competitor_content AS "
                "DOUBLE) ELSE 0.0 END AS content_ratio FROM (SELECT username, CAST(date - CAST(isodow(date) - 1 AS INTEGER) "
                "AS DATE) AS week_start, CAST(SUM(posts + reels + stories) AS BIGINT) AS own_content, CAST(SUM(COALESCE(cp, 0) "
                "+ COALESCE(cr, 0) + COALESCE(cs, 0)) AS BIGINT) AS competitor_content FROM f1 LEFT JOIN (SELECT "
                "CAST(o_orderdate AS DATE) AS date, SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS cp, "
                "SUM(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS cr, SUM(CASE WHEN o_orderpriority = "
                "'3-MEDIUM' THEN 1 ELSE 0 END) AS cs FROM orders GROUP BY 1) c USING (date) GROUP BY 1, 2) w", "f1"))
def kp18(spark, sf):
    """KP18 own vs competitor cadence per creator-week: totals, difference, ratio."""
    from ..operators.kpi import competitor_benchmark
    return competitor_benchmark(_daily_with_competitors(spark, sf))
