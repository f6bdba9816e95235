"""Registered queries: KPIs KP1-KP17 and diagnostics DG1-DG18 on F4 predictions.

F4: weekly F1 features scored by the fixed-coefficient model
(y_pred = -5 + 2.5 frequency - 4 share_reels + 3 share_posts), baseline =
previous week's growth of the creator (0 if none).  Fixed coefficients make
every statistic here exactly expressible in SQL.
"""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..operators import diagnostics as D
from ..operators import kpi as K
from ..operators import models as M
from ..operators import weekly as W
from ..sources import fixtures as FX
from .q_models import MF_SQL, MODEL_FEATURES, PRED_SQL, fixed_model, model_frame
from .registry import register
from .sqlparts import q, weekly_feature_ctes


def predictions(spark, sf):
    """F4 predictions table (stand-in model output through the library's predict)."""
    w = W.weekly_feature_table(FX.daily_metrics(spark, sf))
    w = fixed_model().predict(w)
    lag = F.lag("weekly_growth").over(Window.partitionBy("username").orderBy("week_start"))
    return w.select("username", F.col("week_start").alias("date"), F.col("weekly_growth").cast("double").alias("y_true"),
                    "y_pred", F.coalesce(lag, F.lit(0)).cast("double").alias("baseline_pred"),
                    F.col("weekly_posting_frequency").alias("posting_frequency"),
                    F.col("follows_per_post").alias("roi_actual"))


PRED_CTE = weekly_feature_ctes("f1") + (
    ",\npred AS (SELECT username, week_start AS date, CAST(weekly_growth AS DOUBLE) AS y_true, "
    f"{PRED_SQL} AS y_pred, CAST(COALESCE(LAG(weekly_growth) OVER (PARTITION BY username ORDER BY week_start), 0) "
    "AS DOUBLE) AS baseline_pred, weekly_posting_frequency AS posting_frequency, follows_per_post AS roi_actual "
    "FROM wf),\npe AS (SELECT *, y_true AS y, y_pred AS p, y_true - y_pred AS e, ABS(y_true - y_pred) AS ae FROM pred)")


def qp(body: str, extra: str = "") -> str:
    return q(body, "f1", extra=PRED_CTE + (",\n" + extra if extra else ""))


def corr_sql(a, b):
    return f"(COVAR_POP({a}, {b}) / NULLIF(STDDEV_POP({a}) * STDDEV_POP({b}), 0))"


R2 = ("CASE WHEN VAR_POP(y) * COUNT(y) = 0 THEN (CASE WHEN SUM(e * e) = 0 THEN 1.0 ELSE 0.0 END) "
      "ELSE 1 - SUM(e * e) / (VAR_POP(y) * COUNT(y)) END")
MAPE = "AVG(ABS(CASE WHEN y <> 0 THEN e / y ELSE 0.0 END)) * 100"
DIRECTION = "AVG(CASE WHEN SIGN(y) = SIGN(p) THEN 1.0 ELSE 0.0 END) * 100"
KP1_COLS = ("mse", "rmse", "mae", "r2", "mape", "explained_variance", "median_absolute_error", "smape",
            "mean_bias_error", "normalized_rmse", "normalized_mae", "pearson_correlation")
KP1_SQL = (
    f"SELECT COUNT(*) AS n, AVG(e * e) AS mse, SQRT(AVG(e * e)) AS rmse, AVG(ae) AS mae, {R2} AS r2, {MAPE} AS mape, "
    "CASE WHEN VAR_POP(y) = 0 THEN (CASE WHEN VAR_POP(e) = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - VAR_POP(e) / VAR_POP(y) "
    "END AS explained_variance, quantile_cont(ae, 0.5) AS median_absolute_error, "
    "AVG(CASE WHEN ABS(y) + ABS(p) <> 0 THEN ae / (ABS(y) + ABS(p)) END) * 200 AS smape, AVG(p - y) AS mean_bias_error, "
    "CASE WHEN STDDEV_POP(y) > 0 THEN SQRT(AVG(e * e)) / STDDEV_POP(y) END AS normalized_rmse, "
    "CASE WHEN STDDEV_POP(y) > 0 THEN AVG(ae) / STDDEV_POP(y) END AS normalized_mae, "
    f"{corr_sql('y', 'p')} AS pearson_correlation FROM pe")


@register("kp1", doubles=KP1_COLS, sql=qp(KP1_SQL))
def kp1(spark, sf):
    """KP1 statistical KPIs (MSE ... Pearson r) in one aggregate + an exact median."""
    return K.statistical_kpis(predictions(spark, sf))


def _bucket_sql(col, spec):
    parts = []
    for name, lo, hi in spec:
        cond = " AND ".join([x for x in ([f"{col} >= {lo}"] if lo is not None else []) +
                             ([f"{col} < {hi}"] if hi is not None else [])]) or "TRUE"
        parts.append(f"WHEN {cond} THEN '{name}'")
    return "CASE " + " ".join(parts) + " END"


KP2_SQL = (f"SELECT 'growth' AS kind, {_bucket_sql('y', C.GROWTH_RANGES)} AS bucket, COUNT(*) AS n, {DIRECTION} AS "
           f"directional_accuracy, AVG(ae) AS mae FROM pe GROUP BY 2 UNION ALL "
           f"SELECT 'posting', {_bucket_sql('CAST(posting_frequency AS DOUBLE)', C.POSTING_RANGES)}, COUNT(*), "
           f"{DIRECTION}, AVG(ae) FROM pe GROUP BY 2 UNION ALL SELECT 'all', 'all', COUNT(*), {DIRECTION}, AVG(ae) FROM pe")


@register("kp2", doubles=("directional_accuracy", "mae"), sql=qp(KP2_SQL))
def kp2(spark, sf):
    """KP2 business KPIs: direction per growth range, MAE per posting range (AG5)."""
    return K.business_kpis(predictions(spark, sf))


ROI_PRED = "(CASE WHEN posting_frequency <> 0 THEN p / posting_frequency ELSE 0.0 END)"


@register("kp3", doubles=("roi_prediction_error", "roi_correlation"),
          sql=qp(f"SELECT AVG(ABS(roi_actual - {ROI_PRED})) AS roi_prediction_error, "
                 f"{corr_sql('roi_actual', ROI_PRED)} AS roi_correlation FROM pe"))
def kp3(spark, sf):
    """KP3 ROI accuracy: MAE and r of roi_actual vs y_hat / frequency."""
    return K.roi_kpis(predictions(spark, sf))


@register("kp4", doubles=("low_posting_mae", "high_posting_mae", "positive_growth_accuracy", "negative_growth_accuracy"),
          sql=qp("SELECT AVG(CASE WHEN posting_frequency < 5 THEN ae END) AS low_posting_mae, "
                 "AVG(CASE WHEN posting_frequency >= 5 THEN ae END) AS high_posting_mae, "
                 "AVG(CASE WHEN y > 0 THEN CAST(p > 0 AS DOUBLE) END) * 100 AS positive_growth_accuracy, "
                 "AVG(CASE WHEN y <= 0 THEN CAST(p <= 0 AS DOUBLE) END) * 100 AS negative_growth_accuracy FROM pe"))
def kp4(spark, sf):
    """KP4 decision support metrics."""
    return K.decision_support(predictions(spark, sf))


KP5_COLS = ("prediction_std", "residual_std", "coefficient_of_variation", "max_absolute_error", "min_absolute_error",
            "error_range", "mae_95th_percentile", "mae_75th_percentile", "mae_25th_percentile", "prediction_consistency")


@register("kp5", doubles=KP5_COLS,
          sql=qp("SELECT STDDEV_POP(p) AS prediction_std, STDDEV_POP(e) AS residual_std, STDDEV_POP(p) / "
                 "GREATEST(ABS(AVG(p)), 1e-10) AS coefficient_of_variation, MAX(ae) AS max_absolute_error, "
                 "MIN(ae) AS min_absolute_error, MAX(ae) - MIN(ae) AS error_range, quantile_cont(ae, 0.95) AS "
                 "mae_95th_percentile, quantile_cont(ae, 0.75) AS mae_75th_percentile, quantile_cont(ae, 0.25) AS "
                 "mae_25th_percentile, 1 - STDDEV_POP(ae) / GREATEST(AVG(ae), 1e-10) AS prediction_consistency FROM pe"))
def kp5(spark, sf):
    """KP5 prediction quality (B14: max(x, 1e-10) as greatest)."""
    return K.prediction_quality(predictions(spark, sf))


@register("kp6", doubles=("within_1_std_percentage", "within_2_std_percentage", "within_3_std_percentage",
                          "prediction_uncertainty"),
          sql=qp("SELECT AVG(CAST(ae <= s AS DOUBLE)) * 100 AS within_1_std_percentage, AVG(CAST(ae <= 2 * s AS DOUBLE)) "
                 "* 100 AS within_2_std_percentage, AVG(CAST(ae <= 3 * s AS DOUBLE)) * 100 AS within_3_std_percentage, "
                 "MAX(s) AS prediction_uncertainty, AVG(CAST(ae <= s AS DOUBLE)) * 100 >= 68 AS confidence_68, "
                 "AVG(CAST(ae <= 2 * s AS DOUBLE)) * 100 >= 95 AS confidence_95 FROM pe, (SELECT STDDEV_POP(e) AS s "
                 "FROM pe) z"))
def kp6(spark, sf):
    """KP6 share of residuals within 1, 2, 3 residual standard deviations."""
    return K.confidence_kpis(predictions(spark, sf))


def _date_cut_sql(num, den, src="pe"):
    return (f"(SELECT d FROM (SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS pos, COUNT(*) OVER () AS nd FROM "
            f"(SELECT DISTINCT date AS d FROM {src}) x) r WHERE pos = LEAST(nd - 1, (nd * {num}) // {den}))")


KP7_SQL = (
    "SELECT sd / NULLIF(mean, 0) AS seasonal_consistency, CASE WHEN n > 2 THEN tr ELSE 0.0 END AS "
    "performance_trend_correlation, best_month, worst_month, monthly_performance_range, CASE WHEN n >= 30 THEN fh END "
    "AS first_half_mae, CASE WHEN n >= 30 THEN lh END AS last_half_mae, (CASE WHEN n >= 30 THEN lh END - "
    "CASE WHEN n >= 30 THEN fh END) / NULLIF(CASE WHEN n >= 30 THEN fh END, 0) AS performance_change, "
    "ABS((CASE WHEN n >= 30 THEN lh END - CASE WHEN n >= 30 THEN fh END) / NULLIF(CASE WHEN n >= 30 THEN fh END, 0)) "
    "< 0.2 AS stable FROM (SELECT STDDEV_SAMP(mae) AS sd, AVG(mae) AS mean, CAST(arg_min(m, mae) AS INTEGER) AS best_month, "
    "CAST(arg_max(m, mae) AS INTEGER) AS worst_month, MAX(mae) - MIN(mae) AS monthly_performance_range FROM "
    "(SELECT month(date) AS m, AVG(ae) AS mae FROM pe GROUP BY 1) mo) a, (SELECT COUNT(*) AS n, "
    f"{corr_sql('CAST(date - d0 AS DOUBLE)', 'ae')} AS tr, AVG(CASE WHEN date < {_date_cut_sql(1, 2)} THEN ae END) AS fh, "
    f"AVG(CASE WHEN date >= {_date_cut_sql(1, 2)} THEN ae END) AS lh FROM pe, (SELECT MIN(date) AS d0 FROM pe) z) b")


@register("kp7", doubles=("seasonal_consistency", "performance_trend_correlation", "monthly_performance_range",
                          "first_half_mae", "last_half_mae", "performance_change"), sql=qp(KP7_SQL))
def kp7(spark, sf):
    """KP7 temporal: monthly profile (AG3), trend, half split on distinct dates."""
    return K.temporal_kpis(predictions(spark, sf))


@register("ag3", doubles=("mae", "residual_mean", "residual_std"),
          sql=qp("SELECT CAST(month(date) AS INTEGER) AS month, COUNT(*) AS n, AVG(ae) AS mae, AVG(e) AS residual_mean, "
                 "STDDEV_SAMP(e) AS residual_std FROM pe GROUP BY 1"))
def ag3(spark, sf):
    """AG3 monthly error profile."""
    return K.monthly_errors(predictions(spark, sf))


def _r2_of(pcol):
    return (f"CASE WHEN VAR_POP(y) * COUNT(y) = 0 THEN (CASE WHEN SUM((y - {pcol}) * (y - {pcol})) = 0 THEN 1.0 ELSE 0.0 "
            f"END) ELSE 1 - SUM((y - {pcol}) * (y - {pcol})) / (VAR_POP(y) * COUNT(y)) END")


KP8_SQL = (
    "SELECT *, (baseline_mae - model_mae) / NULLIF(baseline_mae, 0) * 100 AS mae_improvement, "
    "(baseline_rmse - model_rmse) / NULLIF(baseline_rmse, 0) * 100 AS rmse_improvement, "
    "(model_r2 - baseline_r2) / GREATEST(ABS(baseline_r2), 1e-10) * 100 AS r2_improvement, "
    "model_mae < baseline_mae AS model_better_mae, model_rmse < baseline_rmse AS model_better_rmse, "
    "model_r2 > baseline_r2 AS model_better_r2, (COALESCE(CAST((baseline_mae - model_mae) / NULLIF(baseline_mae, 0) > 0 "
    "AS INTEGER), 0) + COALESCE(CAST((baseline_rmse - model_rmse) / NULLIF(baseline_rmse, 0) > 0 AS INTEGER), 0) + "
    "COALESCE(CAST((model_r2 - baseline_r2) > 0 AS INTEGER), 0)) / 3.0 AS overall_improvement_score FROM (SELECT "
    f"AVG(ae) AS model_mae, SQRT(AVG(e * e)) AS model_rmse, {_r2_of('p')} AS model_r2, AVG(ABS(y - baseline_pred)) AS "
    f"baseline_mae, SQRT(AVG((y - baseline_pred) * (y - baseline_pred))) AS baseline_rmse, {_r2_of('baseline_pred')} "
    "AS baseline_r2 FROM pe) m")


@register("kp8", doubles=("model_mae", "model_rmse", "model_r2", "baseline_mae", "baseline_rmse", "baseline_r2",
                          "mae_improvement", "rmse_improvement", "r2_improvement", "overall_improvement_score"),
          sql=qp(KP8_SQL))
def kp8(spark, sf):
    """KP8 comparison with the previous-week baseline."""
    return K.comparative_kpis(predictions(spark, sf))


def _in(c, lo, hi):
    parts = ([f"{c} >= {lo}"] if lo is not None else []) + ([f"{c} < {hi}"] if hi is not None else [])
    return "(" + " AND ".join(parts) + ")"


KP9_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS category, COUNT(*) AS n, COUNT(*) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM pe) * 100 AS "
    f"percentage, AVG(ae) AS mae, 1 / (1 + AVG(ae) / 100) AS accuracy_score FROM pe WHERE {_in('y', lo, hi)} OR "
    f"{_in('p', lo, hi)} HAVING COUNT(*) > 0" for name, lo, hi in K.CATEGORY_RULES)


@register("kp9", doubles=("percentage", "mae", "accuracy_score"), sql=qp(KP9_SQL))
def kp9(spark, sf):
    """KP9 overlapping growth categories (AG6): a row counts for its actual and predicted class."""
    return K.growth_categories(predictions(spark, sf))


@register("kp10", doubles=("roi_prediction_mae", "roi_correlation", "high_frequency_mae", "low_frequency_mae",
                           "median_posting_frequency"),
          sql=qp("SELECT AVG(ABS(ar - pr)) AS roi_prediction_mae, " + corr_sql("ar", "pr") + " AS roi_correlation, "
                 "AVG(CASE WHEN posting_frequency > md THEN ae END) AS high_frequency_mae, AVG(CASE WHEN NOT "
                 "(posting_frequency > md) THEN ae END) AS low_frequency_mae, MAX(md) AS median_posting_frequency FROM "
                 "(SELECT *, CASE WHEN posting_frequency <> 0 THEN y / posting_frequency ELSE 0.0 END AS ar, "
                 f"{ROI_PRED} AS pr FROM pe) x, (SELECT quantile_cont(posting_frequency, 0.5) AS md FROM pe) z"))
def kp10(spark, sf):
    """KP10 strategy KPIs: ROI error, MAE above / not above the median frequency."""
    return K.strategy_kpis(predictions(spark, sf))


KP11_SQL = ("SELECT AVG(ABS(aa - pa)) AS acceleration_mae, " + corr_sql("aa", "pa") + " AS acceleration_correlation, "
            "AVG(CASE WHEN SIGN(aa) = SIGN(pa) THEN 1.0 ELSE 0.0 END) * 100 AS momentum_direction_accuracy FROM (SELECT "
            "y - 2 * LAG(y, 1) OVER w + LAG(y, 2) OVER w AS aa, p - 2 * LAG(p, 1) OVER w + LAG(p, 2) OVER w AS pa FROM pe "
            "WINDOW w AS (PARTITION BY username ORDER BY date)) x WHERE aa IS NOT NULL AND pa IS NOT NULL")


@register("kp11", doubles=("acceleration_mae", "acceleration_correlation", "momentum_direction_accuracy"),
          sql=qp(KP11_SQL))
def kp11(spark, sf):
    """KP11 momentum: second differences per creator (WN8)."""
    return K.momentum_kpis(predictions(spark, sf))


KP12_SQL = ("SELECT threshold, AVG(CAST((y > threshold) = (p > threshold) AS DOUBLE)) * 100 AS accuracy, "
            "CAST(SUM(CAST(y > threshold AS INTEGER)) AS BIGINT) AS actual_exceeds_count, CAST(SUM(CAST(p > threshold "
            "AS INTEGER)) AS BIGINT) AS pred_exceeds_count FROM pe, (SELECT CAST(t AS DOUBLE) AS threshold FROM "
            "(VALUES " + ", ".join(f"({t})" for t in C.AGREEMENT_THRESHOLDS) + ") v(t)) th GROUP BY threshold "
            "HAVING SUM(CAST(y > threshold AS INTEGER)) > 0 OR SUM(CAST(p > threshold AS INTEGER)) > 0")


@register("kp12", doubles=("threshold", "accuracy"), sql=qp(KP12_SQL))
def kp12(spark, sf):
    """KP12 threshold agreement at 0/50/100/200/500/1000 (AG7, broadcast threshold table)."""
    return K.threshold_accuracy(predictions(spark, sf))


def _grade_sql(s):
    return "CASE " + " ".join(f"WHEN {s} >= {cut} THEN '{g}'" for cut, g in C.GRADE_CUTS) + f" ELSE '{C.GRADE_FLOOR}' END"


def _clip01(x):
    return f"GREATEST(0.0, LEAST(1.0, {x}))"


OVERALL_CTE = (
    f"ov0 AS (SELECT s.r2, s.mape, b.directional_accuracy, qk.prediction_consistency, t.seasonal_consistency, t.stable "
    f"FROM ({KP1_SQL}) s, (SELECT {DIRECTION} AS directional_accuracy FROM pe) b, (SELECT 1 - STDDEV_POP(ae) / "
    f"GREATEST(AVG(ae), 1e-10) AS prediction_consistency FROM pe) qk, ({KP7_SQL}) t),\n"
    f"ov AS (SELECT *, 0.4 * {_clip01('(r2 + 1) / 2')} + 0.3 * (directional_accuracy / 100) + 0.2 * "
    f"{_clip01('prediction_consistency')} + 0.1 * {_clip01('1 - COALESCE(seasonal_consistency, 1.0)')} AS overall_score "
    "FROM ov0)")
RECS_SQL = ("COALESCE(NULLIF(concat_ws('; ', CASE WHEN r2 < 0.7 THEN 'Consider feature engineering to improve R² score' END, "
            "CASE WHEN mape > 30 THEN 'High MAPE indicates need for better feature selection' END, CASE WHEN "
            "directional_accuracy < 75 THEN 'Improve directional accuracy for better decision support' END, CASE WHEN "
            "stable = FALSE THEN 'Model showing instability over time - consider retraining' END), ''), "
            "'KPI performance looks good')")


@register("kp13", doubles=("r2", "mape", "directional_accuracy", "prediction_consistency", "seasonal_consistency",
                           "overall_score"),
          sql=qp(f"SELECT *, {_grade_sql('overall_score')} AS performance_grade, {RECS_SQL} AS recommendations FROM ov",
                 extra=OVERALL_CTE))
def kp13(spark, sf):
    """KP13 overall score (.4/.3/.2/.1) and grade A+ ... D (B15: from current results)."""
    return K.overall_score(predictions(spark, sf))


@register("kp14", doubles=("overall_score", "r2", "directional_accuracy", "rmse", "mae"),
          sql=qp(f"SELECT overall_score, {_grade_sql('overall_score')} AS performance_grade, {RECS_SQL} AS "
                 "recommendations, r2, directional_accuracy, rmse, mae FROM ov, (SELECT SQRT(AVG(e * e)) AS rmse, AVG(ae) AS mae FROM pe) k",
                 extra=OVERALL_CTE))
def kp14(spark, sf):
    """KP14 KPI summary: score, grade, the joined rule recommendations and the key metrics."""
    return K.kpi_summary(predictions(spark, sf))


KP15_SQL = (
    "SELECT *, AVG(CAST(better_than_benchmark AS DOUBLE)) OVER () AS benchmark_score, CASE WHEN AVG(CAST("
    "better_than_benchmark AS DOUBLE)) OVER () >= 0.75 THEN 'excellent' WHEN AVG(CAST(better_than_benchmark AS DOUBLE)) "
    "OVER () >= 0.5 THEN 'good' WHEN AVG(CAST(better_than_benchmark AS DOUBLE)) OVER () >= 0.25 THEN 'average' ELSE "
    "'below_average' END AS performance_vs_benchmark FROM (SELECT metric, our_value, benchmark_value, CASE WHEN metric = "
    "'r2' THEN our_value > benchmark_value ELSE our_value < benchmark_value END AS better_than_benchmark, CASE WHEN "
    "benchmark_value = 0 THEN 0.0 WHEN metric = 'r2' THEN (our_value - benchmark_value) / benchmark_value * 100 ELSE "
    "(benchmark_value - our_value) / benchmark_value * 100 END AS improvement_percentage FROM (SELECT o.metric, o.v AS "
    "our_value, b.v AS benchmark_value FROM (SELECT UNNEST(['r2', 'rmse', 'mae', 'mape']) AS metric, UNNEST([r2, rmse, "
    "mae, mape]) AS v FROM (SELECT " + R2 + " AS r2, SQRT(AVG(e * e)) AS rmse, AVG(ae) AS mae, " + MAPE + " AS mape "
    "FROM pe)) o JOIN (SELECT UNNEST(['r2', 'rmse', 'mae', 'mape']) AS metric, UNNEST([r2, rmse, mae, mape]) AS v FROM "
    "(SELECT " + R2.replace("e * e", "(y - baseline_pred) * (y - baseline_pred)") + " AS r2, SQRT(AVG((y - baseline_pred) "
    "* (y - baseline_pred))) AS rmse, AVG(ABS(y - baseline_pred)) AS mae, AVG(ABS(CASE WHEN y <> 0 THEN (y - "
    "baseline_pred) / y ELSE 0.0 END)) * 100 AS mape FROM pe)) b USING (metric)) j) c")


@register("kp15", doubles=("our_value", "benchmark_value", "improvement_percentage", "benchmark_score"), sql=qp(KP15_SQL))
def kp15(spark, sf):
    """KP15 compare_against_benchmarks: the benchmark here is the naive previous-week baseline."""
    pred = predictions(spark, sf)
    ours = K.metrics_long(K.statistical_kpis(pred))
    base = K.metrics_long(K.statistical_kpis(pred.withColumn("y_pred", F.col("baseline_pred"))))
    return K.compare_against_benchmarks(ours, base)


@register("kp16")
def kp16(spark, sf):
    """KP16 calculate_all_kpis: KP1-KP13 as long rows (rows-only)."""
    return K.all_kpis(predictions(spark, sf))


@register("kp17", doubles=("rolling_mae", "rolling_direction"),
          sql=qp("SELECT username, date, AVG(ae) OVER w AS rolling_mae, AVG(CASE WHEN SIGN(y) = SIGN(p) THEN 1.0 ELSE "
                 "0.0 END) OVER w * 100 AS rolling_direction, COUNT(*) OVER w AS rolling_n FROM pe WINDOW w AS (PARTITION "
                 "BY username ORDER BY CAST(date - DATE '1970-01-01' AS BIGINT) RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)"))
def kp17(spark, sf):
    """KP17 rolling 30-day accuracy per creator (rangeBetween on day numbers)."""
    return K.rolling_accuracy(predictions(spark, sf))


# ---------------------------------------------------------------- DG
@register("dg1", doubles=("mean", "std", "min", "max", "median", "q25", "q75", "iqr"),
          sql=qp("SELECT AVG(e) AS mean, STDDEV_POP(e) AS std, MIN(e) AS min, MAX(e) AS max, quantile_cont(e, 0.5) AS "
                 "median, quantile_cont(e, 0.25) AS q25, quantile_cont(e, 0.75) AS q75, quantile_cont(e, 0.75) - "
                 "quantile_cont(e, 0.25) AS iqr, ABS(AVG(e)) < 0.01 * STDDEV_POP(y) AS mean_near_zero, ABS(AVG(e) - "
                 "quantile_cont(e, 0.5)) < 0.1 * STDDEV_POP(e) AS symmetric_distribution FROM pe"))
def dg1(spark, sf):
    """DG1 residual statistics and the near-zero-mean / symmetry flags."""
    return D.residual_statistics(predictions(spark, sf))


@register("dg2", doubles=("dw_numerator", "dw_denominator", "durbin_watson_statistic"),
          sql=qp("SELECT *, dw_numerator / NULLIF(dw_denominator, 0) AS durbin_watson_statistic, dw_numerator / "
                 "NULLIF(dw_denominator, 0) BETWEEN 1.5 AND 2.5 AS passed, CASE WHEN dw_numerator / NULLIF(dw_denominator,"
                 " 0) < 1.5 THEN 'Positive autocorrelation detected' WHEN dw_numerator / NULLIF(dw_denominator, 0) > 2.5 "
                 "THEN 'Negative autocorrelation detected' ELSE 'No significant autocorrelation' END AS interpretation "
                 "FROM (SELECT SUM(d * d) AS dw_numerator, SUM(e * e) AS dw_denominator FROM (SELECT e, e - LAG(e) OVER "
                 "(PARTITION BY username ORDER BY date) AS d FROM pe) x) s"))
def dg2(spark, sf):
    """DG2 Durbin-Watson statistic (B19), lags per creator."""
    return D.durbin_watson(predictions(spark, sf))


def _dict_row(spark, d: dict):
    return M.rows_to_df(spark, [{k: v for k, v in d.items()}])


# least squares of e on 1, t, t^2 with t = (p - mean) / deviation, by Cramer's rule (the sum of t is 0)
DG3_SQL = f"""SELECT r AS correlation_with_fitted, quad AS quadratic_coefficient, ABS(r) < 0.1 AND quad < 0.01 AS passed FROM (
  SELECT r, ABS((n * (t2 * e2 - t3 * e1) - e0 * t2 * t2) / (n * (t2 * t4 - t3 * t3) - t2 * t2 * t2)) / (s * s) AS quad FROM (
    SELECT COUNT(*) AS n, SUM(POW(t, 2)) AS t2, SUM(POW(t, 3)) AS t3, SUM(POW(t, 4)) AS t4, SUM(e) AS e0, SUM(e * t) AS e1,
           SUM(e * t * t) AS e2, ANY_VALUE(s) AS s, {corr_sql('p', 'e')} AS r
    FROM (SELECT p, e, s, (p - m) / s AS t FROM pe, (SELECT AVG(p) AS m, STDDEV_POP(p) AS s FROM pe) z) x) y) w"""


@register("dg3", doubles=("correlation_with_fitted", "quadratic_coefficient"), sql=qp(DG3_SQL))
def dg3(spark, sf):
    """DG3 linearity: r(y_hat, e) and quadratic coefficient from moments."""
    return _dict_row(spark, D.linearity(predictions(spark, sf)))


@register("dg4")
def dg4(spark, sf):
    """DG4 constant variance: r(y_hat, |e|) and its t-test p-value (rows-only)."""
    return _dict_row(spark, D.homoscedasticity(predictions(spark, sf)))


DG5_SQL = ("SELECT sk AS skewness, ku AS kurtosis, n / 6.0 * (sk * sk + ku * ku / 4.0) AS statistic, "
           "EXP(-(n / 6.0 * (sk * sk + ku * ku / 4.0)) / 2) AS p_value, EXP(-(n / 6.0 * (sk * sk + ku * ku / 4.0)) / 2) "
           "> 0.05 AS passed FROM (SELECT COUNT(*) AS n, AVG(POW(e - m, 3)) / POW(AVG(POW(e - m, 2)), 1.5) AS sk, "
           "AVG(POW(e - m, 4)) / POW(AVG(POW(e - m, 2)), 2) - 3 AS ku FROM pe, (SELECT AVG(e) AS m FROM pe) z) s")


@register("dg5", doubles=("skewness", "kurtosis", "statistic", "p_value"), sql=qp(DG5_SQL))
def dg5(spark, sf):
    """DG5 Jarque-Bera with population skewness and excess kurtosis."""
    return D.jarque_bera(predictions(spark, sf))


@register("dg6")
def dg6(spark, sf):
    """DG6 Anderson-Darling A^2 via distributed ranks of distinct values (rows-only)."""
    return _dict_row(spark, D.anderson_darling(predictions(spark, sf)))


@register("dg7")
def dg7(spark, sf):
    """DG7 Shapiro-Wilk per creator; creators whose size it is not defined for come with a status (rows-only)."""
    return D.shapiro_wilk_by(predictions(spark, sf), "username")


@register("dg8")
def dg8(spark, sf):
    """DG8 normality vote (B18: passes >= total // 2; rows-only)."""
    n = D.normality(predictions(spark, sf))
    return M.rows_to_df(spark, [{"test": k, "passed": bool(v.get("passed")),
                                 "detail": json.dumps({a: b for a, b in v.items() if a != "passed"}, default=str)}
                                for k, v in n.items()])


@register("dg9")
def dg9(spark, sf):
    """DG9 multicollinearity of the model features from the Gram (rows-only)."""
    des = M.build_design(model_frame(spark, sf), n_splits=None)
    r = D.multicollinearity(des.total)
    return M.rows_to_df(spark, [{"condition_number": r["condition_number"], "passed": r["passed"],
                                 "n_high_pairs": len(r["high_correlations"]), "pairs": r["high_correlations"]}])


@register("dg10")
def dg10(spark, sf):
    """DG10 assumption score: linearity, independence, homoscedasticity, normality / 4 (rows-only)."""
    a = D.test_assumptions(predictions(spark, sf))
    return M.rows_to_df(spark, [{"overall_score": a["overall_score"], "summary": a["summary"],
                                 "linearity": a["linearity"]["passed"], "independence": bool(a["independence"]["passed"]),
                                 "homoscedasticity": a["homoscedasticity"]["passed"],
                                 "normality": a["normality"]["overall"]["passed"]}])


DG11_SQL = (
    "SELECT username, date, e AS residual, e / s AS std_residual, ABS(e / s) > 3 AS z_outlier, (e < lo OR e > hi) AS "
    "iqr_outlier, (e / s) * (e / s) * (1.0 / n) / (1 - 1.0 / n) AS cooks_distance, COALESCE((e / s) * (e / s) * "
    "(1.0 / n) / (1 - 1.0 / n) > 4.0 / n, FALSE) AS cooks_outlier, ABS(e / s) > 4 AS severe, (ABS(e / s) > 3) OR "
    "(e < lo OR e > hi) OR COALESCE((e / s) * (e / s) * (1.0 / n) / (1 - 1.0 / n) > 4.0 / n, FALSE) AS outlier FROM pe, "
    "(SELECT STDDEV_POP(e) AS s, COUNT(*) AS n, quantile_cont(e, 0.25) - 1.5 * (quantile_cont(e, 0.75) - "
    "quantile_cont(e, 0.25)) AS lo, quantile_cont(e, 0.75) + 1.5 * (quantile_cont(e, 0.75) - quantile_cont(e, 0.25)) "
    "AS hi FROM pe) z")


@register("dg11", doubles=("residual", "std_residual", "cooks_distance"), sql=qp(DG11_SQL))
def dg11(spark, sf):
    """DG11 residual outlier flags per row: z, IQR, simplified Cook's distance, severe."""
    return D.residual_outliers(predictions(spark, sf))


DG12_SQL = (
    "SELECT CASE WHEN n > 2 THEN rt ELSE 0.0 END AS residual_trend_correlation, CASE WHEN n > 2 THEN art ELSE 0.0 END AS "
    "abs_residual_trend_correlation, ch > 0.2 AS performance_degradation, ch * 100 AS performance_change_percentage, "
    "cv_of_monthly_mae, max_monthly_mae, min_monthly_mae FROM (SELECT *, CASE WHEN n >= 10 AND early_mae > 0 THEN "
    "(late_mae - early_mae) / early_mae ELSE 0.0 END AS ch FROM (SELECT COUNT(*) AS n, "
    f"{corr_sql('CAST(date - d0 AS DOUBLE)', 'e')} AS rt, {corr_sql('CAST(date - d0 AS DOUBLE)', 'ae')} AS art, "
    f"AVG(CASE WHEN date < {_date_cut_sql(1, 5)} THEN ae END) AS early_mae, AVG(CASE WHEN date >= {_date_cut_sql(4, 5)} "
    "THEN ae END) AS late_mae FROM pe, (SELECT MIN(date) AS d0 FROM pe) z) t) t2, (SELECT STDDEV_SAMP(mae) / AVG(mae) AS "
    "cv_of_monthly_mae, MAX(mae) AS max_monthly_mae, MIN(mae) AS min_monthly_mae FROM (SELECT month(date) AS m, AVG(ae) "
    "AS mae FROM pe GROUP BY 1) mo) ms")


@register("dg12", doubles=("residual_trend_correlation", "abs_residual_trend_correlation", "performance_change_percentage",
                           "cv_of_monthly_mae", "max_monthly_mae", "min_monthly_mae"), sql=qp(DG12_SQL))
def dg12(spark, sf):
    """DG12 temporal patterns: trends, first vs last fifth of the distinct dates, monthly CV."""
    return D.temporal_patterns(predictions(spark, sf))


@register("dg13", doubles=("mean", "std", "min", "max", "zero_percentage", "missing_percentage"),
          sql=q(" UNION ALL ".join(
              f"SELECT '{c}' AS feature, AVG(CAST({c} AS DOUBLE)) AS mean, STDDEV_POP(CAST({c} AS DOUBLE)) AS std, "
              f"CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, AVG(CAST({c} = 0 AS DOUBLE)) * 100 AS "
              f"zero_percentage, AVG(CAST({c} IS NULL AS DOUBLE)) * 100 AS missing_percentage FROM mf"
              for c in MODEL_FEATURES), "f1", extra=MF_SQL))
def dg13(spark, sf):
    """DG13 feature diagnostics: mean, std, min, max, zero %, missing % per model feature."""
    return D.feature_diagnostics(model_frame(spark, sf), MODEL_FEATURES)


@register("dg14", doubles=("mse", "rmse", "mae", "r2", "mape", "directional_accuracy", "mean_bias_error"),
          sql=qp(f"SELECT COUNT(*) AS n, AVG(e * e) AS mse, SQRT(AVG(e * e)) AS rmse, AVG(ae) AS mae, {R2} AS r2, "
                 f"{MAPE} AS mape, {DIRECTION} AS directional_accuracy, AVG(p - y) AS mean_bias_error FROM pe"))
def dg14(spark, sf):
    """DG14 performance metrics (ML11 + bias)."""
    return D.performance_metrics(predictions(spark, sf))


@register("dg15")
def dg15(spark, sf):
    """DG15 health score and recommendations (rows-only)."""
    r = D.run_full_diagnostics(predictions(spark, sf), M.build_design(model_frame(spark, sf), n_splits=None).total)
    return M.rows_to_df(spark, [{"overall_health_score": r["overall_health_score"],
                                 "recommendations": "; ".join(r["recommendations"])}])


@register("dg16")
def dg16(spark, sf):
    """DG16 run_full_diagnostics: all sections as JSON rows (rows-only)."""
    mf = model_frame(spark, sf)
    r = D.run_full_diagnostics(predictions(spark, sf), M.build_design(mf, n_splits=None).total, features=mf.select(*MODEL_FEATURES))
    return M.rows_to_df(spark, [{"section": k, "value": json.dumps(v, default=str)} for k, v in r.items()])


def _half_metrics(pred, first: bool, cut):
    part = pred.where(F.col("date") < F.lit(cut)) if first else pred.where(F.col("date") >= F.lit(cut))
    from ..operators.metrics import regression_metrics
    m = regression_metrics(part)
    return m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"))
                                         for k in ("r2", "rmse", "mae", "directional_accuracy")])).alias("x")).select("x.*")


def _half_sql(cond):
    return (f"SELECT UNNEST(['r2', 'rmse', 'mae', 'directional_accuracy']) AS metric, UNNEST([r2, rmse, mae, da]) AS value "
            f"FROM (SELECT {R2} AS r2, SQRT(AVG(e * e)) AS rmse, AVG(ae) AS mae, {DIRECTION} AS da FROM pe WHERE {cond}) h")


DG17_SQL = (
    "SELECT *, SUM(drift_score) OVER () / 4.0 AS overall_drift_score, SUM(drift_score) OVER () / 4.0 > 0.1 AS "
    "drift_detected FROM (SELECT metric, b.value AS baseline, c.value AS current, rel AS relative_change, CASE WHEN "
    "metric IN ('r2', 'directional_accuracy') THEN (CASE WHEN rel < 0 THEN -rel ELSE 0.0 END) ELSE (CASE WHEN rel > 0 "
    "THEN rel ELSE 0.0 END) END AS drift_score, ABS(rel) > 0.1 AS significant, CASE WHEN ABS(rel) > 0.1 THEN (CASE WHEN "
    "ABS(rel) > 0.2 THEN 'high' ELSE 'medium' END) END AS severity FROM (SELECT b.metric, b.value, c.value AS cv, CASE "
    "WHEN b.value <> 0 THEN (c.value - b.value) / ABS(b.value) ELSE 0.0 END AS rel FROM (" + _half_sql(
        f"date < {_date_cut_sql(1, 2)}") + ") b JOIN (" + _half_sql(f"date >= {_date_cut_sql(1, 2)}") +
    ") c USING (metric)) b JOIN (" + _half_sql(f"date >= {_date_cut_sql(1, 2)}") + ") c USING (metric)) x")


@register("dg17", doubles=("baseline", "current", "relative_change", "drift_score", "overall_drift_score"),
          sql=qp(DG17_SQL))
def dg17(spark, sf):
    """DG17 detect_model_drift: first half of the distinct dates (baseline) vs second half (current)."""
    pred = predictions(spark, sf)
    cut = K.date_cut(pred, 1, 2)
    return D.detect_model_drift(_half_metrics(pred, True, cut), _half_metrics(pred, False, cut))


PSI_FEATS = ["weekly_posting_frequency", "engagement_rate", "roi_follows_per_hour", "share_reels"]


def _psi_sql():
    parts = []
    for c in PSI_FEATS:
        parts.append(
            f"SELECT '{c}' AS feature, CAST(len(list_filter(edges, lambda x: CAST({c} AS DOUBLE) > x)) AS INTEGER) "
            f"AS bin, period FROM pw, "
            f"(SELECT quantile_cont(CAST({c} AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM pw "
            f"WHERE period = 'baseline') q WHERE {c} IS NOT NULL")
    return (f"wdates AS (SELECT week_start AS date FROM wf),\npw AS (SELECT *, CASE WHEN week_start < "
            f"{_date_cut_sql(1, 2, 'wdates')} THEN 'baseline' ELSE 'current' END AS period FROM wf),\nbins AS (" +
            " UNION ALL ".join(parts) +
            "),\ncnt AS (SELECT feature, bin, SUM(CAST(period = 'baseline' AS BIGINT)) AS nb, SUM(CAST(period = 'current' "
            "AS BIGINT)) AS nc FROM bins GROUP BY feature, bin),\ntot AS (SELECT feature, SUM(nb) AS tb, SUM(nc) AS tc FROM "
            "cnt GROUP BY feature)")


@register("dg18", doubles=("psi",),
          sql=q("SELECT feature, SUM((GREATEST(nc / tc, 0.0001) - GREATEST(nb / tb, 0.0001)) * LN(GREATEST(nc / tc, "
                "0.0001) / GREATEST(nb / tb, 0.0001))) AS psi FROM cnt JOIN tot USING (feature) GROUP BY feature", "f1",
                extra=weekly_feature_ctes("f1") + ",\n" + _psi_sql()))
def dg18(spark, sf):
    """DG18 input drift: PSI per feature over baseline deciles, first vs second half of the weeks."""
    w = W.weekly_feature_table(FX.daily_metrics(spark, sf))
    cut = K.date_cut(w.withColumnRenamed("week_start", "date"), 1, 2)
    w = w.withColumn("period", F.when(F.col("week_start") < F.lit(cut), "baseline").otherwise("current"))
    return D.population_stability(w, PSI_FEATS, "period", "baseline", "current")
