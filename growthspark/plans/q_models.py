"""Registered queries: models ML1-ML18, validation CV1-CV11, selection FS1-FS8.

The model frame is the weekly feature table of F1 plus month and quarter.
Queries whose answer is a function of fitted coefficients are rows-only
checks (their numeric parity is tested against numpy in tests/); queries
with fixed coefficients or plain statistics have DuckDB oracles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import dist
from ..operators import gram as G
from ..operators import models as M
from ..operators import select as S
from ..operators import validate as V
from ..operators import weekly as W
from ..session import write_once
from ..sources import fixtures as FX
from .q_weekly import METRICS_SQL, ML_SQL_FIT, flagship_df
from .registry import register
from .sqlparts import q, weekly_ctes, weekly_feature_ctes

MODEL_FEATURES = ["weekly_posting_frequency", "share_posts", "share_reels", "share_stories", "engagement_rate",
                  "avg_hashtag_count", "roi_follows_per_hour", "minutes_spent", "month", "quarter"]
MF_SQL = weekly_feature_ctes("f1") + (",\nmf AS (SELECT *, CAST(month(week_start) AS INTEGER) AS month, "
                                      "CAST(quarter(week_start) AS INTEGER) AS quarter FROM wf)")


def model_frame(spark, sf):
    """The keys, the model's features and its target: the weekly table narrowed first, then written once."""
    w = W.weekly_feature_table(FX.daily_metrics(spark, sf), checkpoint=False)
    w = w.withColumn("month", F.month("week_start")).withColumn("quarter", F.quarter("week_start"))
    return write_once(w.select("username", "week_start", *MODEL_FEATURES, "weekly_growth"))


@register("ml1", doubles=tuple(c for c in MODEL_FEATURES if c not in ("month", "quarter", "weekly_posting_frequency",
                                                                      "minutes_spent")),
          sql=q("SELECT username, week_start, " + ", ".join(MODEL_FEATURES) + ", weekly_growth FROM mf", "f1",
                extra=MF_SQL))
def ml1(spark, sf):
    """ML1 prepare_features: the candidate features present plus the target (design rows)."""
    mf = model_frame(spark, sf)
    feats, tgt = M.prepare_features(mf)
    return mf.select("username", "week_start", *feats, tgt)


@register("ml2", doubles=("median",),
          sql=q(" UNION ALL ".join(f"SELECT '{c}' AS feature, quantile_cont({c}, 0.5) AS median FROM mf"
                                   for c in MODEL_FEATURES + ["weekly_growth"]), "f1", extra=MF_SQL))
def ml2(spark, sf):
    """ML2 medians of the design columns (exact distributed selection)."""
    from ..functions.stats import global_quantiles
    mf = model_frame(spark, sf)
    cols = MODEL_FEATURES + ["weekly_growth"]
    med = global_quantiles(mf, {c: (c, 0.5) for c in cols})
    return spark.createDataFrame([(c, float(med[c])) for c in cols], "feature string, median double")


@register("ml3", doubles=("mean", "scale"),
          sql=q(" UNION ALL ".join(f"SELECT '{c}' AS feature, AVG({c}) AS mean, CASE WHEN STDDEV_POP({c}) = 0 THEN 1.0 "
                                   f"ELSE STDDEV_POP({c}) END AS scale FROM mf" for c in MODEL_FEATURES), "f1",
                extra=MF_SQL))
def ml3(spark, sf):
    """ML3 standardisation parameters (mean, population std, 0 -> 1) from the Gram aggregate."""
    des = M.build_design(model_frame(spark, sf), n_splits=None)
    mu, sd = G.scaler_from(des.total)
    return spark.createDataFrame([(f, float(mu[j]), float(sd[j])) for j, f in enumerate(des.features)],
                                 "feature string, mean double, scale double")


def _coef_rows(spark, models: dict):
    rows = []
    for name, m in models.items():
        b0, b = m.fit.raw()
        rows.append((name, "__intercept__", float(b0)))
        rows += [(name, f, float(v)) for f, v in zip(m.features, b)]
    return spark.createDataFrame(rows, "model string, feature string, raw_coef double")


@register("ml5")
def ml5(spark, sf):
    """ML5 linear / ridge / lasso (alpha 1) on one Gram set: raw-scale coefficients (rows-only)."""
    des = M.build_design(model_frame(spark, sf), n_splits=None)
    return _coef_rows(spark, {mt: M.fit_on_design(des, mt, 1.0, validate=False) for mt in ("linear", "ridge", "lasso")})


@register("ml6")
def ml6(spark, sf):
    """ML6 RegularizedRegression: ridge, lasso, elastic net (alpha 1, l1 .5) with metrics (rows-only)."""
    des = M.build_design(model_frame(spark, sf), n_splits=None)
    rows = []
    for mt in ("ridge", "lasso", "elasticnet"):
        m = M.fit_on_design(des, mt, 1.0, 0.5, validate=False)
        rows.append({"model_type": mt, **m.train_metrics, "intercept": m.fit.intercept})
    return M.rows_to_df(spark, rows)


@register("ml7")
def ml7(spark, sf):
    """ML7 regularisation facts: non-zero count, max, L1, L2, sparsity (rows-only)."""
    des = M.build_design(model_frame(spark, sf), n_splits=None)
    return reduce(DataFrame.unionByName, [M.fit_on_design(des, mt, 1.0, validate=False).regularization_info(spark)
                                          for mt in ("ridge", "lasso", "elasticnet")])


@register("ml8")
def ml8(spark, sf):
    """ML8 lasso-selected features (|coef| > 1e-10) (rows-only)."""
    des = M.build_design(model_frame(spark, sf), n_splits=None)
    m = M.fit_on_design(des, "lasso", 1.0, validate=False)
    return spark.createDataFrame([(f,) for f in m.selected_features()], "feature string")


# fixed-coefficient model (F4 formula) so prediction has an exact SQL twin
FIXED = {"weekly_posting_frequency": 2.5, "share_reels": -4.0, "share_posts": 3.0}
FIXED_B0 = -5.0
FIXED_N, FIXED_MSE = 100, 2500.0


def fixed_model() -> M.GrowthModel:
    feats = list(FIXED)
    fit = G.Fit(feats, np.array([FIXED[f] for f in feats]), FIXED_B0, np.zeros(len(feats)), np.ones(len(feats)),
                FIXED_N, FIXED_MSE * FIXED_N, 0.0)
    return M.GrowthModel(fit, "linear", "weekly_growth", train_metrics={"mse": FIXED_MSE})


PRED_SQL = "(-5.0 + 2.5 * weekly_posting_frequency - 4.0 * share_reels + 3.0 * share_posts)"


@register("ml9", doubles=("y_pred",),
          sql=q(f"SELECT username, week_start, {PRED_SQL} AS y_pred FROM wf", "f1", extra=weekly_feature_ctes("f1")))
def ml9(spark, sf):
    """ML9 predict: a Column expression from the coefficient table (codegen, no Python worker)."""
    w = W.weekly_feature_table(FX.daily_metrics(spark, sf))
    return fixed_model().predict(w).select("username", "week_start", "y_pred")


_MARGIN = dist.critical_value(0.95, FIXED_N - len(FIXED) - 1) * float(np.sqrt(FIXED_MSE))


@register("ml10", doubles=("y_pred", "lower_bound", "upper_bound"),
          sql=q(f"SELECT username, week_start, {PRED_SQL} AS y_pred, {PRED_SQL} - {_MARGIN!r} AS lower_bound, "
                f"{PRED_SQL} + {_MARGIN!r} AS upper_bound FROM wf", "f1", extra=weekly_feature_ctes("f1")))
def ml10(spark, sf):
    """ML10 prediction interval: t(0.975, n-p-1) x sqrt(train MSE) around y_hat."""
    w = W.weekly_feature_table(FX.daily_metrics(spark, sf))
    return fixed_model().predict_with_confidence(w).select("username", "week_start", "y_pred", "lower_bound",
                                                           "upper_bound")


@register("ml12")
def ml12(spark, sf):
    """ML12 feature importance of the OLS fit: coefficient, rank, direction, meaning (rows-only)."""
    m = M.fit_model(model_frame(spark, sf), "linear", validate=False)
    return m.feature_importance(spark)


@register("ml13", doubles=("r2", "directional_accuracy"),
          sql=q("SELECT r2, directional_accuracy, r2 < 0.6 AS low_r2, directional_accuracy < 75.0 AS low_direction, "
                "CASE WHEN (CAST(r2 < 0.6 AS INTEGER) + CAST(directional_accuracy < 75.0 AS INTEGER)) = 0 THEN "
                "'Excellent' WHEN (CAST(r2 < 0.6 AS INTEGER) + CAST(directional_accuracy < 75.0 AS INTEGER)) = 1 THEN "
                "'Good' ELSE 'Poor' END AS overall_quality, concat_ws('; ', CASE WHEN r2 < 0.6 THEN "
                f"'{C.LOW_R2_ADVICE}' END, CASE WHEN directional_accuracy < 75.0 THEN '{C.LOW_DIRECTION_ADVICE}' END) AS recommendations "
                "FROM (" + METRICS_SQL + ") m", "f1",
                extra=weekly_ctes("f1") + ",\n" + ML_SQL_FIT))
def ml13(spark, sf):
    """ML13 quality verdict (R2 >= .60, direction >= 75 %) on the flagship fit."""
    from ..operators.metrics import quality_verdict
    return quality_verdict(flagship_df(spark, sf)).select("r2", "directional_accuracy", "low_r2", "low_direction",
                                                           "overall_quality", "recommendations")


@register("ml14")
def ml14(spark, sf):
    """ML14 train_model_pipeline: fit, 5 time folds, summary with top 5 and verdict (rows-only)."""
    m, summary = M.train_model_pipeline(model_frame(spark, sf), "linear")
    return M.rows_to_df(spark, [{"model_type": summary["model_type"], "n_samples": summary["n_samples"],
                                 "n_features": summary["n_features"], **summary["train_metrics"],
                                 "cv_r2_mean": summary["cv_results"]["r2_mean"],
                                 "cv_mse_mean": summary["cv_results"]["mse_mean"],
                                 "top_features": summary["top_features"],
                                 "overall_quality": summary["quality"]["overall_quality"]}])


@register("ml15")
def ml15(spark, sf):
    """ML15 compare_models: linear, ridge, lasso from one Gram set, ranked by CV R2 (rows-only)."""
    return M.rows_to_df(spark, M.compare_models(model_frame(spark, sf)))


@register("ml16")
def ml16(spark, sf):
    """ML16 tune_alpha: 50 log-spaced alphas x 5 time folds for ridge, grid (rows-only)."""
    t = M.tune_alpha(model_frame(spark, sf), "ridge")
    return M.rows_to_df(spark, [{"best_alpha": t["best_params"]["alpha"], "best_cv_mse": t["best_cv_mse"],
                                 "best_cv_rmse": t["best_cv_rmse"], "n_candidates": t["n_candidates"]}])


@register("ml17")
def ml17(spark, sf):
    """ML17 compare_regularization_strengths for lasso, alphas .001 ... 100 (rows-only)."""
    return M.rows_to_df(spark, M.compare_regularization_strengths(model_frame(spark, sf), "lasso"))


@register("ml18")
def ml18(spark, sf):
    """ML18 compare_regularization_methods: tuned ridge, lasso, elastic net (rows-only)."""
    return M.rows_to_df(spark, M.compare_regularization_methods(model_frame(spark, sf)))


# ---------------------------------------------------------------- CV
CV1_SQL = ("SELECT fold, split, MIN(d) AS date_from, MAX(d) AS date_to, COUNT(*) AS n_dates FROM (SELECT d, "
           "ROW_NUMBER() OVER (ORDER BY d) - 1 AS pos, COUNT(*) OVER () AS n FROM (SELECT DISTINCT week_start AS d "
           "FROM wk) x) r, (SELECT CAST(range + 1 AS INTEGER) AS fold FROM range(5)) f, (SELECT 'train' AS split UNION ALL SELECT "
           "'test') s WHERE (split = 'train' AND pos < n - (5 - fold + 1) * (n // 6)) OR (split = 'test' AND "
           "pos >= n - (5 - fold + 1) * (n // 6) AND pos < n - (5 - fold) * (n // 6)) GROUP BY fold, split")


@register("cv1", sql=q(CV1_SQL, "f1", extra=weekly_ctes("f1")))
def cv1(spark, sf):
    """CV1 time_series_split on distinct weeks: fold, split, first/last date, number of dates."""
    return V.time_series_split(W.create_weekly_features(FX.daily_metrics(spark, sf)), 5)


@register("cv2")
def cv2(spark, sf):
    """CV2 cross_validate (5 time folds): R2, MSE, MAE mean and std (rows-only)."""
    m = M.fit_model(model_frame(spark, sf), "linear")
    cv = {k: v for k, v in m.cv.items() if not isinstance(v, list)}
    return M.rows_to_df(spark, [cv])


def _cv(spark, sf):
    return V.cross_validate(model_frame(spark, sf), "ridge")


@register("cv3")
def cv3(spark, sf):
    """CV3 summary: mean, std, min, max, CV, 95 % interval, train scores, overfitting (rows-only)."""
    return _cv(spark, sf)["summary"]


@register("cv4")
def cv4(spark, sf):
    """CV4 fold detail from one scoring pass (rows-only)."""
    return M.rows_to_df(spark, _cv(spark, sf)["fold_detail"])


@register("cv5")
def cv5(spark, sf):
    """CV5 stability per metric and overall assessment (rows-only)."""
    return _cv(spark, sf)["stability"]


@register("cv6")
def cv6(spark, sf):
    """CV6 coefficient consistency over folds (rows-only)."""
    return _cv(spark, sf)["coefficient_consistency"]


@register("cv7")
def cv7(spark, sf):
    """CV7 trend of fold scores, best and worst fold (rows-only)."""
    return _cv(spark, sf)["temporal"]


@register("cv8")
def cv8(spark, sf):
    """CV8 walk-forward validation: refit before every week after the first 156 (rows-only)."""
    return M.rows_to_df(spark, V.walk_forward_validation(model_frame(spark, sf), 156))


@register("cv9")
def cv9(spark, sf):
    """CV9 expanding-window validation: min 104 weeks, test windows of 52 (rows-only)."""
    return M.rows_to_df(spark, V.expanding_window_validation(model_frame(spark, sf), 104, 52))


@register("cv10")
def cv10(spark, sf):
    """CV10 CreatorTimeSeriesCV.cross_validate composition (fold detail of a linear model; rows-only)."""
    return M.rows_to_df(spark, V.cross_validate(model_frame(spark, sf), "linear")["fold_detail"])


CV11_SQL = ("SELECT split, COUNT(*) AS n_rows, MIN(week_start) AS date_from, MAX(week_start) AS date_to FROM (SELECT "
            "wk.*, CASE WHEN week_start < (SELECT d FROM (SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS pos, "
            "COUNT(*) OVER () AS n FROM (SELECT DISTINCT week_start AS d FROM wk) x) r WHERE pos = CAST(floor(n * 0.8) "
            "AS BIGINT)) THEN 'train' ELSE 'test' END AS split FROM wk) s GROUP BY split")


@register("cv11", sql=q(CV11_SQL, "f1", extra=weekly_ctes("f1")))
def cv11(spark, sf):
    """CV11 80/20 time split on the distinct-week rank."""
    w = V.train_test_split_by_time(W.create_weekly_features(FX.daily_metrics(spark, sf)), 0.2)
    return w.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("week_start").alias("date_from"),
                                  F.max("week_start").alias("date_to"))


# ---------------------------------------------------------------- FS
FS_FEATS = MODEL_FEATURES


@register("fs1", doubles=("correlation", "score"),
          sql=q(" UNION ALL ".join(
              f"SELECT '{c}' AS feature, corr({c}, weekly_growth) AS correlation, corr({c}, weekly_growth) * "
              f"corr({c}, weekly_growth) / (1 - corr({c}, weekly_growth) * corr({c}, weekly_growth)) * (COUNT(*) - 2) "
              f"AS score FROM mf" for c in FS_FEATS), "f1", extra=MF_SQL))
def fs1(spark, sf):
    """FS1 univariate F statistic per feature (r from the Gram aggregate)."""
    des = M.build_design(model_frame(spark, sf), n_splits=None)
    rows = S.univariate_scores(des.total)
    return spark.createDataFrame([(r["feature"], r["correlation"], r["score"]) for r in rows],
                                 "feature string, correlation double, score double")


@register("fs2")
def fs2(spark, sf):
    """FS2 recursive elimination to 5 features, ranking (rows-only)."""
    des = M.build_design(model_frame(spark, sf), n_splits=None)
    sel, ranking = S.recursive_elimination(des.total, 5)
    return spark.createDataFrame([(f, int(r), f in sel) for f, r in ranking.items()],
                                 "feature string, ranking int, selected boolean")


@register("fs3")
def fs3(spark, sf):
    """FS3 forward selection on 3 time folds (rows-only)."""
    des = M.build_design(model_frame(spark, sf), n_splits=3)
    r = S.forward_selection(des, 10)
    return spark.createDataFrame([(f, o) for f, o in r["selection_order"].items()],
                                 "feature string, selection_order int")


@register("fs4", doubles=("variance", "target_correlation"),
          sql=q(" UNION ALL ".join(f"SELECT '{c}' AS feature, VAR_POP({c}) AS variance, ABS(corr({c}, weekly_growth)) "
                                   f"AS target_correlation FROM mf" for c in FS_FEATS), "f1", extra=MF_SQL))
def fs4(spark, sf):
    """FS4 filter analysis: population variance and |r| with the target per feature."""
    des = M.build_design(model_frame(spark, sf), n_splits=None)
    return S.filter_selection(spark, des.total, 10).select("feature", "variance", "target_correlation")


@register("fs5")
def fs5(spark, sf):
    """FS5 RFE with time-series CV (min 5 features; rows-only)."""
    des = M.build_design(model_frame(spark, sf))
    r = S.rfe_cv(des, "ridge", 5)
    return spark.createDataFrame([(int(k), float(v), k == r["n_features_selected"]) for k, v in r["cv_scores"].items()],
                                 "n_features int, mean_neg_mse double, chosen boolean")


@register("fs6")
def fs6(spark, sf):
    """FS6 transform to the univariately selected features (rows-only)."""
    mf = model_frame(spark, sf)
    des = M.build_design(mf, n_splits=None)
    sel = S.select_features(des, "univariate", 5)
    return S.transform(mf, sel)


@register("fs7")
def fs7(spark, sf):
    """FS7 compare_selection_methods (rows-only)."""
    return M.rows_to_df(spark, S.compare_selection_methods(model_frame(spark, sf)))


@register("fs8")
def fs8(spark, sf):
    """FS8 bootstrap stability with seeded Poisson weights, 10 replicates in one pass over the rows (rows-only)."""
    r = S.feature_stability_analysis(model_frame(spark, sf), "univariate", 10, 5)
    return M.rows_to_df(spark, [{**x, "stability_score": r["stability_score"], "mean_jaccard": r["mean_jaccard"]}
                                for x in r["feature_stability"]])
