"""Registered queries: validation reports of the one-feature model, with DuckDB twins.

The folds, fits, fold scores and reports are the operators of CV2-CV10 as they
run on any feature set; on one feature the fold fits are ``regr_slope`` and
``regr_intercept``, so every number has a closed form in SQL.
"""

from __future__ import annotations

from .. import config as C
from ..functions import dist
from ..operators import models as M
from ..operators import validate as V
from .q_models import MF_SQL, model_frame
from .registry import register
from .sqlparts import q

FEATURE = "weekly_posting_frequency"
FOLDS = 5


def one_feature(spark, sf):
    return model_frame(spark, sf).select("username", "week_start", FEATURE, "weekly_growth")


def _scores(group: str) -> str:
    """Metric columns of rows (y, yhat)."""
    err = "(y - yhat)"
    sst = "(VAR_POP(y) * COUNT(y))"
    return (f"{group}, COUNT(*) AS n, AVG({err} * {err}) AS mse, AVG(ABS({err})) AS mae, CASE WHEN {sst} = 0 THEN (CASE WHEN "
            f"SUM({err} * {err}) = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - SUM({err} * {err}) / {sst} END AS r2, "
            "AVG(CASE WHEN SIGN(y) = SIGN(yhat) THEN 1.0 ELSE 0.0 END) * 100 AS directional_accuracy")


BASE = MF_SQL + f""",
u AS MATERIALIZED (SELECT week_start, CAST({FEATURE} AS DOUBLE) AS x, CAST(weekly_growth AS DOUBLE) AS y FROM mf),
ps AS MATERIALIZED (SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS pos, COUNT(*) OVER () AS n FROM (SELECT DISTINCT week_start AS d FROM u) z),
up AS MATERIALIZED (SELECT pos, n, x, y FROM u JOIN ps ON week_start = d)"""

FOLD_CTE = BASE + f""",
fr AS (SELECT fold, x, y, CASE WHEN pos < n - ({FOLDS} - fold + 1) * (n // {FOLDS + 1}) THEN 'train'
       WHEN pos < n - ({FOLDS} - fold) * (n // {FOLDS + 1}) THEN 'test' END AS split
       FROM up, (SELECT CAST(range + 1 AS INTEGER) AS fold FROM range({FOLDS})) f),
ft AS MATERIALIZED (SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM fr WHERE split = 'train' GROUP BY fold),
sc AS MATERIALIZED (SELECT {_scores('fold, split')} FROM (SELECT fr.fold, split, y, a + b * x AS yhat FROM fr JOIN ft ON fr.fold = ft.fold
       WHERE split IS NOT NULL) z GROUP BY fold, split),
fd AS MATERIALIZED (SELECT t.fold, t.n AS train_size, e.n AS test_size, t.mse AS train_mse, e.mse AS test_mse, t.mae AS train_mae, e.mae AS test_mae,
       t.r2 AS train_r2, e.r2 AS test_r2, e.directional_accuracy FROM sc t JOIN sc e ON t.fold = e.fold WHERE t.split = 'train' AND e.split = 'test'),
lm AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT fold, '{m}' AS metric, train_{m} AS train, test_{m} AS test FROM fd" for m in C.CV_METRICS) + ")"


def _cv(spark, sf):
    return V.cross_validate(one_feature(spark, sf), "linear", n_splits=FOLDS)


SIZES = ("train_size", "test_size")
DETAIL = ("train_mse", "test_mse", "train_mae", "test_mae", "train_r2", "test_r2", "directional_accuracy")


@register("cv4u", doubles=DETAIL, sql=q("SELECT CAST(fold AS BIGINT) AS fold_number, " + ", ".join(SIZES + DETAIL) + " FROM fd", "f1", extra=FOLD_CTE))
def cv4u(spark, sf):
    """CV4/CV10 fold detail of the one-feature model: every fold's sizes and scores."""
    rows = [{k: r[k] for k in ("fold_number", *SIZES, *DETAIL)} for r in _cv(spark, sf)["fold_detail"]]
    return M.rows_to_df(spark, rows)


SUMMARY_D = ("mean", "std", "min", "max", "cv", "ci95_lower", "ci95_upper", "train_mean", "train_std", "overfitting_score")
_HALF = f"STDDEV_SAMP(test) * {dist.t_ppf(0.975, FOLDS - 1)!r} / SQRT({FOLDS}.0)"
SUMMARY_SQL = (f"SELECT metric, AVG(test) AS mean, STDDEV_POP(test) AS std, MIN(test) AS min, MAX(test) AS max, STDDEV_POP(test) / ABS(AVG(test)) "
               f"AS cv, AVG(test) - {_HALF} AS ci95_lower, AVG(test) + {_HALF} AS ci95_upper, AVG(train) AS train_mean, STDDEV_POP(train) AS "
               "train_std, GREATEST(0.0, CASE WHEN metric = 'r2' THEN AVG(train) - AVG(test) ELSE AVG(test) - AVG(train) END) AS "
               "overfitting_score FROM lm GROUP BY metric")


@register("cv3u", doubles=SUMMARY_D, sql=q(SUMMARY_SQL, "f1", extra=FOLD_CTE))
def cv3u(spark, sf):
    """CV2/CV3 summary of the one-feature model's folds per metric."""
    return _cv(spark, sf)["summary"]


@register("cv5u", doubles=("coefficient_of_variation", "score_range", "stability_score"),
          sql=q(f"SELECT metric, cv AS coefficient_of_variation, cv < {C.CV_STABLE_BELOW} AS stable, max - min AS score_range, AVG(CASE WHEN cv < "
                f"{C.CV_STABLE_BELOW} THEN 1.0 ELSE 0.0 END) OVER () AS stability_score, CASE WHEN AVG(CASE WHEN cv < {C.CV_STABLE_BELOW} THEN 1.0 "
                f"ELSE 0.0 END) OVER () >= {C.CV_STABLE_SHARE} THEN 'Stable' ELSE 'Unstable' END AS assessment FROM ({SUMMARY_SQL}) s",
                "f1", extra=FOLD_CTE))
def cv5u(spark, sf):
    """CV5 stability of the one-feature model's folds."""
    return _cv(spark, sf)["stability"]


@register("cv6u", doubles=("coef_std", "coef_cv", "sign_consistency"),
          sql=q(f"SELECT '{FEATURE}' AS feature, STDDEV_POP(w) AS coef_std, STDDEV_POP(w) / ABS(AVG(w)) AS coef_cv, AVG(CASE WHEN SIGN(w) = SIGN(m) "
                "THEN 1.0 ELSE 0.0 END) AS sign_consistency FROM (SELECT b * s AS w, AVG(b * s) OVER () AS m FROM ft, (SELECT STDDEV_POP(x) AS s "
                "FROM u) k) z", "f1", extra=FOLD_CTE))
def cv6u(spark, sf):
    """CV6 consistency of the (scaled) coefficient over the folds."""
    return _cv(spark, sf)["coefficient_consistency"]


@register("cv7u", doubles=("r2_trend_correlation", "mae_trend_correlation", "r2_range", "mae_range"),
          sql=q("SELECT r AS r2_trend_correlation, m AS mae_trend_correlation, "
                f"r < -{C.CV_TREND_LIMIT} AS performance_degradation, r > {C.CV_TREND_LIMIT} AS performance_improvement, "
                f"ABS(r) < {C.CV_FLAT_LIMIT} AS consistent_performance, r2_range, mae_range, best_fold, worst_fold FROM (SELECT corr(fold, test_r2) "
                "AS r, corr(fold, test_mae) AS m, MAX(test_r2) - MIN(test_r2) AS r2_range, MAX(test_mae) - MIN(test_mae) AS mae_range, "
                "arg_max(fold, test_r2) AS best_fold, arg_min(fold, test_r2) AS worst_fold FROM fd) z", "f1", extra=FOLD_CTE))
def cv7u(spark, sf):
    """CV7 trend of the one-feature model's fold scores."""
    return _cv(spark, sf)["temporal"]


def _windows_sql(windows: str) -> str:
    """Scores of test windows (w, lo, hi): trained on all dates before lo."""
    return BASE + f""",
wn AS MATERIALIZED ({windows}),
cu AS MATERIALIZED (SELECT w, lo, hi, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM up JOIN wn ON pos < lo GROUP BY w, lo, hi),
ws AS (SELECT {_scores('w, lo, hi')} FROM (SELECT w, lo, hi, y, a + b * x AS yhat FROM up JOIN cu ON pos >= lo AND pos < hi) z GROUP BY w, lo, hi)"""


WINDOW_SELECT = ("SELECT CAST(w AS BIGINT) AS window_number, e.d AS train_end, s.d AS test_start, t.d AS test_end, ws.n AS n_test, mse, mae, r2, "
                 "directional_accuracy FROM ws JOIN ps e ON e.pos = lo - 1 JOIN ps s ON s.pos = lo JOIN ps t ON t.pos = hi - 1")
WINDOW_D = ("mse", "mae", "r2", "directional_accuracy")
WINDOW_SCHEMA = ("window_number long, train_end date, test_start date, test_end date, n_test long, mse double, mae double, r2 double, "
                 "directional_accuracy double")


def _window_rows(spark, rows):
    keys = ("window", "train_end", "test_start", "test_end", "n_test", *WINDOW_D)
    return spark.createDataFrame([tuple(r[k] for k in keys) for r in rows], WINDOW_SCHEMA)


@register("cv8u", doubles=WINDOW_D, sql=q(WINDOW_SELECT, "f1", extra=_windows_sql(
    "SELECT pos - 155 AS w, pos AS lo, pos + 1 AS hi FROM ps WHERE pos >= 156")))
def cv8u(spark, sf):
    """CV8 walk-forward of the one-feature model: refit before every week after the first 156."""
    return _window_rows(spark, V.walk_forward_validation(one_feature(spark, sf), 156))


@register("cv9u", doubles=WINDOW_D, sql=q(WINDOW_SELECT, "f1", extra=_windows_sql(
    "SELECT (pos - 104) // 52 + 1 AS w, pos AS lo, pos + 52 AS hi FROM ps WHERE pos >= 104 AND (pos - 104) % 52 = 0 AND pos + 52 <= n")))
def cv9u(spark, sf):
    """CV9 expanding windows of the one-feature model: at least 104 weeks, tests of 52."""
    return _window_rows(spark, V.expanding_window_validation(one_feature(spark, sf), 104, 52))
