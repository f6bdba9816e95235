"""Linear growth models (ML1-ML18) from Gram statistics.

A fit costs a fixed handful of Spark jobs whatever the number of candidate
models: means (for the shift), distinct dates (for time folds), ONE Gram
aggregate per time segment, and one scoring pass for the metrics that are
not functions of the Gram (MAE, MAPE, direction).  Scoring is a Column
expression built from the coefficients, so prediction stays inside
whole-stage codegen and works on a stream.

Engine decisions: B21 prediction imputes with the *training* medians; B22
``cv_scale='all'`` (reference cross_validate) fits the scaler on all rows,
``'fold'`` (pipeline: tuning, RFE-CV) per training fold; B24 lasso flags are
set before sorting; B27 folds cut on distinct dates.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import dist
from ..functions.stats import global_quantiles
from ..session import write_once
from . import gram as G
from .metrics import regression_metrics


# ---------------------------------------------------------------- one feature
def fit_single_feature(df: DataFrame, x: str, y: str) -> DataFrame:
    """One-feature OLS (ML4 special case): one row feature, coef, intercept, n."""
    return df.agg(
        F.lit(x).alias("feature"),
        F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("coef"),
        F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )


def predict_single(model: DataFrame, df: DataFrame, x: str, out: str = "y_pred") -> DataFrame:
    """Score with a one-row model table (broadcast: exactly one row)."""
    m = model.select(F.col("coef").alias("_b"), F.col("intercept").alias("_a"))
    from ..functions.stats import attach_row
    return (attach_row(df, m)
              .withColumn(out, F.col("_a") + F.col("_b") * F.col(x).cast("double"))
              .drop("_a", "_b"))


# ---------------------------------------------------------------- ML1 / ML2
def prepare_features(df: DataFrame, candidates=None) -> tuple[list, str]:
    """13 candidate features present in the frame; target weekly_growth else growth."""
    feats = [c for c in (candidates or C.FEATURE_CANDIDATES) if c in df.columns]
    target = next((t for t in C.TARGET_CANDIDATES if t in df.columns), None)
    if target is None:
        raise ValueError("no target column (weekly_growth / growth)")
    return feats, target


def training_medians(df: DataFrame, cols: list) -> dict:
    """ML2: medians only for columns that have a missing value (one count pass)."""
    nulls = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols]).collect()[0].asDict()
    need = [c for c in cols if nulls.get(c)]
    if not need:
        return {}
    return global_quantiles(df, {c: (c, 0.5) for c in need})


def impute(df: DataFrame, medians: dict) -> DataFrame:
    for c, m in medians.items():
        if m is not None:
            df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(float(m))))
    return df


# ---------------------------------------------------------------- model object
@dataclass
class GrowthModel:
    fit: G.Fit
    model_type: str
    target: str
    alpha: float = 1.0
    l1_ratio: float = 0.5
    medians: dict = field(default_factory=dict)
    train_metrics: dict = field(default_factory=dict)
    cv: dict | None = None
    date_col: str = "week_start"

    @property
    def features(self) -> list:
        return self.fit.features

    def predict_expr(self):
        return G.predict_expr(self.fit, self.medians)

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        """ML9: impute with training medians (B21), scale, dot product -- a Column."""
        return df.withColumn(out, self.predict_expr())

    def predict_with_confidence(self, df: DataFrame, level: float = C.CONFIDENCE_LEVEL,
                                out: str = "y_pred") -> DataFrame:
        """ML10: y_hat +- t(level, n-p-1) sqrt(train MSE) (B23: constant width);
        normal quantile if no residual df; +-10 % if no training statistics."""
        pred = self.predict(df, out)
        mse = self.train_metrics.get("mse")
        if mse is None:
            margin = 0.1 * F.abs(F.col(out))
        else:
            df_res = int(self.fit.n) - len(self.features) - 1
            margin = F.lit(dist.critical_value(level, df_res) * float(np.sqrt(mse)))
        return pred.withColumn("lower_bound", F.col(out) - margin).withColumn("upper_bound", F.col(out) + margin)

    # ML7 -------------------------------------------------------------------
    def regularization_info(self, spark: SparkSession) -> DataFrame:
        """Shrinkage facts of the fit, an aggregate of its coefficient table; the sparsity is the lasso's only."""
        size = F.abs("coef")
        kept = F.count(F.when(size > C.NONZERO_COEF_TOL, 1))
        zero_share = F.try_divide(F.count(F.lit(1)) - kept, F.count(F.lit(1)))
        return self.coefficient_table(spark).where("feature <> '__intercept__'").agg(
            F.lit(self.model_type).alias("model_type"), kept.alias("n_nonzero_coef"),
            F.coalesce(F.max(size), F.lit(0.0)).alias("max_abs_coef"),
            F.sqrt(F.coalesce(F.sum(F.col("coef") * F.col("coef")), F.lit(0.0))).alias("l2_norm"),
            F.coalesce(F.sum(size), F.lit(0.0)).alias("l1_norm"),
            (F.coalesce(zero_share, F.lit(0.0)) if self.model_type == "lasso" else F.lit(None).cast("double")).alias("sparsity_ratio"))

    # ML8 -------------------------------------------------------------------
    def selected_features(self) -> list:
        if self.model_type != "lasso":
            return list(self.features)
        return [f for f, w in zip(self.features, self.fit.coef) if abs(w) > C.NONZERO_COEF_TOL]

    # ML12 ------------------------------------------------------------------
    def feature_importance(self, spark: SparkSession) -> DataFrame:
        rows = []
        for f, w in zip(self.features, self.fit.coef):
            rows.append((f, float(w), float(abs(w)), "Positive" if w > 0 else "Negative",
                         C.BUSINESS_MEANINGS.get(f, C.DEFAULT_BUSINESS_MEANING),
                         int(abs(w) > C.NONZERO_COEF_TOL)))
        rows.sort(key=lambda r: -r[2])
        rows = [r[:3] + (i + 1,) + r[3:] for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double, "
                                           "importance_rank int, effect_direction string, business_meaning string, "
                                           "selected int")

    # SNK4 ------------------------------------------------------------------
    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f, float(w), float(self.fit.center[j]), float(self.fit.scale[j]),
                 None if self.medians.get(f) is None else float(self.medians[f]))
                for j, (f, w) in enumerate(zip(self.features, self.fit.coef))]
        rows.append(("__intercept__", float(self.fit.intercept), 0.0, 1.0, None))
        return spark.createDataFrame(rows, "feature string, coef double, center double, scale double, median double")

    def metadata(self) -> dict:
        return {"model_type": self.model_type, "target": self.target, "alpha": self.alpha,
                "l1_ratio": self.l1_ratio, "n_samples": int(self.fit.n), "n_features": len(self.features),
                "train_metrics": self.train_metrics, "cv": self.cv, "date_col": self.date_col,
                "target_median": self.medians.get(self.target)}

    # ML14 ------------------------------------------------------------------
    def summary(self) -> dict:
        top = sorted(zip(self.features, self.fit.coef), key=lambda t: -abs(t[1]))[:5]
        return {"model_type": self.model_type, "n_samples": int(self.fit.n),
                "n_features": len(self.features), "train_metrics": self.train_metrics,
                "intercept": self.fit.intercept, "top_features": [(f, float(w)) for f, w in top],
                "cv_results": self.cv, "quality": quality(self.train_metrics)}


def quality(metrics: dict) -> dict:
    """ML13: warnings for R2 < .60 and direction < 75 %; Excellent / Good / Poor."""
    warn = []
    if metrics.get("r2", 0) < C.MODEL_QUALITY_THRESHOLDS["min_r2_score"]:
        warn.append("low_r2")
    if metrics.get("directional_accuracy", 0) < C.MODEL_QUALITY_THRESHOLDS["min_directional_accuracy"] * 100:
        warn.append("low_directional_accuracy")
    q = "Excellent" if not warn else ("Good" if len(warn) == 1 else "Poor")
    return {"overall_quality": q, "warnings": warn}


# ---------------------------------------------------------------- design
@dataclass
class Design:
    """Imputed design frame + its Gram segments (one aggregate)."""
    df: DataFrame
    features: list
    target: str
    date_col: str
    medians: dict
    grams: dict                 # segment -> Gram
    plan: G.SegmentPlan | None
    shift: np.ndarray

    @property
    def total(self) -> G.Gram:
        return G.total(self.grams.values(), self.features + [self.target], self.shift)

    def seg_range(self, lo: int, hi: int) -> G.Gram:
        return G.total([g for s, g in self.grams.items() if s is not None and lo <= s < hi],
                       self.features + [self.target], self.shift)


def build_design(df: DataFrame, features=None, target=None, date_col: str | None = None,
                 n_splits: int | None = C.CV_FOLDS, folds_pos: list | None = None) -> Design:
    feats, tgt = prepare_features(df)
    feats = list(features or feats)
    tgt = target or tgt
    date_col = date_col or ("week_start" if "week_start" in df.columns else "date")
    keep = [c for c in ["username", date_col] if c in df.columns]
    # the narrow design frame (keys, p features, target) feeds ~5 passes
    # (nulls, medians, means, dates, Gram, scoring): write it once to the
    # shared checkpoint folder instead of recomputing the feature pipeline
    d = write_once(df.select(*keep, *[F.col(c).cast("double").alias(c) for c in feats + [tgt]]))
    med = training_medians(d, feats + [tgt])
    d = impute(d, med)
    shift = G.global_means(d, feats + [tgt])
    plan = None
    key = None
    if folds_pos is not None or n_splits:
        dates = G.distinct_dates(d, date_col)
        fp = folds_pos if folds_pos is not None else G.time_series_folds(len(dates), n_splits)
        plan = G.segment_plan(dates, fp)
        key = plan.seg_expr(date_col)
    grams = G.gram_by(d, feats, tgt, key=key, shift=shift)
    return Design(d, feats, tgt, date_col, med, grams, plan, shift)


def predicted(df: DataFrame, target: str, fits: dict, selector=None) -> DataFrame:
    """(_fid, y_true, y_pred): every row once per fit that it belongs to, with that fit's prediction.

    The prediction is made before the rows are exploded, so the aggregates
    after it read a column and do not compute it again.
    """
    made = [F.struct(F.lit(i).alias("_fid"), G.predict_expr(f).alias("y_pred")) for i, f in enumerate(fits.values())]
    if selector is not None:
        made = [F.when(selector[n], s) for n, s in zip(fits, made)]
    x = df.select(F.col(target).alias("y_true"), F.explode(F.array_compact(F.array(*made))).alias("_x"))
    return x.select("_x._fid", "y_true", "_x.y_pred")


def scored_metrics(df: DataFrame, target: str, fits: dict, selector=None) -> dict:
    """Metrics of several fits in ONE pass: {name: {n, mse, rmse, mae, r2, mape, direction}}.

    ``selector`` maps a fit name to a row filter (e.g. a fold's test segments);
    rows are exploded over the fits they belong to.
    """
    names = list(fits)
    rows = regression_metrics(predicted(df, target, fits, selector), by=["_fid"]).collect()
    return {names[r["_fid"]]: {k: r[k] for k in ("n", "mse", "rmse", "mae", "r2", "mape", "directional_accuracy")}
            for r in rows}


# ---------------------------------------------------------------- ML4-ML6, CV2
def fit_on_design(des: Design, model_type: str = "linear", alpha: float = 1.0, l1_ratio: float = 0.5,
                  validate: bool = True, cv_scale: str = "all") -> GrowthModel:
    total = des.total
    fit = G.solve(total, model_type, alpha, l1_ratio)
    fits = {"train": fit}
    cv = None
    sel = None
    if validate and des.plan is not None:
        seg = des.plan.seg_expr(des.date_col)
        sel = {"train": F.lit(True)}
        fold_fits = []
        for i, (a, b, c, d) in enumerate(des.plan.folds):
            tr = des.seg_range(a, b)
            center, scale = (fit.center, fit.scale) if cv_scale == "all" else G.scaler_from(tr)
            ff = G.solve(tr, model_type, alpha, l1_ratio, center, scale)
            fold_fits.append(ff)
            fits[f"fold{i}"] = ff
            sel[f"fold{i}"] = (seg >= c) & (seg < d)
    m = scored_metrics(des.df, des.target, fits, sel)
    if validate and des.plan is not None:
        k = len(des.plan.folds)
        r2 = np.array([m[f"fold{i}"]["r2"] for i in range(k)], float)
        mse = np.array([m[f"fold{i}"]["mse"] for i in range(k)], float)
        mae = np.array([m[f"fold{i}"]["mae"] for i in range(k)], float)
        cv = {"r2_mean": float(r2.mean()), "r2_std": float(r2.std()), "mse_mean": float(mse.mean()),
              "mse_std": float(mse.std()), "mae_mean": float(mae.mean()), "mae_std": float(mae.std()),
              "cv_folds": k, "fold_r2": r2.tolist(), "fold_mse": mse.tolist(), "fold_mae": mae.tolist(),
              "fold_direction": [m[f"fold{i}"]["directional_accuracy"] for i in range(k)],
              "fold_coefficients": [ff.coef.tolist() for ff in fold_fits]}
    return GrowthModel(fit, model_type, des.target, alpha, l1_ratio, des.medians, m["train"], cv, des.date_col)


def fit_model(df: DataFrame, model_type: str = "linear", alpha: float = 1.0, l1_ratio: float = 0.5,
              validate: bool = True, cv_folds: int = C.CV_FOLDS, features=None) -> GrowthModel:
    """ML4 (linear) / ML5 (ridge, lasso with alpha 1) / ML6 (regularised, any alpha)."""
    des = build_design(df, features=features, n_splits=cv_folds if validate else None)
    return fit_on_design(des, model_type, alpha, l1_ratio, validate)


def train_model_pipeline(df: DataFrame, model_type: str = "linear", validate: bool = True,
                         save_path: str | None = None) -> tuple[GrowthModel, dict]:
    """ML14: create, fit (with CV), optionally save; returns (model, summary)."""
    m = fit_model(df, model_type, validate=validate)
    if save_path:
        from ..sources.io import save_model
        save_model(m, df.sparkSession, save_path)
    return m, m.summary()


# ---------------------------------------------------------------- ML15
def compare_models(df: DataFrame, model_types=("linear", "ridge", "lasso")) -> list[dict]:
    """Train and CV metrics of several model types from ONE Gram set; rank by CV R2 (WN9)."""
    des = build_design(df)
    rows = []
    for mt in model_types:
        m = fit_on_design(des, mt, 1.0)
        rows.append({"model_type": mt, "train_r2": m.train_metrics["r2"], "train_rmse": m.train_metrics["rmse"],
                     "train_mae": m.train_metrics["mae"], "cv_r2_mean": m.cv["r2_mean"], "cv_r2_std": m.cv["r2_std"],
                     "cv_rmse_mean": float(np.sqrt(m.cv["mse_mean"])),
                     "directional_accuracy": m.train_metrics["directional_accuracy"]})
    vals = [r["cv_r2_mean"] for r in rows]
    for r in rows:  # average rank, descending
        greater = sum(1 for v in vals if v > r["cv_r2_mean"])
        ties = sum(1 for v in vals if v == r["cv_r2_mean"])
        r["rank"] = greater + (ties + 1) / 2.0
    return sorted(rows, key=lambda r: -r["cv_r2_mean"])


# ---------------------------------------------------------------- ML16-ML18
def alpha_grid():
    return list(np.logspace(-4, 2, 50))


def cv_mse_grid(des: Design, model_type: str, candidates: list) -> list:
    """Mean test MSE over the folds for each (alpha, l1_ratio); 'fold' scaling (pipeline).

    Pure driver algebra on the segment Grams: no Spark job per candidate.
    """
    folds = des.plan.folds
    trains = [des.seg_range(a, b) for a, b, _, _ in folds]
    tests = [des.seg_range(c, d) for _, _, c, d in folds]
    scalers = [G.scaler_from(t) for t in trains]
    scores = {}
    # warm starts: per l1 ratio, visit alphas from strong to weak penalty
    order = sorted(range(len(candidates)), key=lambda i: (candidates[i][1], -candidates[i][0]))
    warm = {}
    for i in order:
        alpha, l1 = candidates[i]
        mses = []
        for f, (tr, te, (center, scale)) in enumerate(zip(trains, tests, scalers)):
            ff = G.solve(tr, model_type, alpha, l1, center, scale, w0=warm.get((l1, f)))
            warm[(l1, f)] = ff.coef
            sse, _ = G.sse_on(te, ff)
            mses.append(sse / te.n)
        scores[i] = float(np.mean(mses))
    return [scores[i] for i in range(len(candidates))]


def tune_alpha(df: DataFrame, model_type: str = "ridge", alpha_range=None, search_type: str = "grid",
               random_state: int = 42, n_iter: int = 50, cv_folds: int = C.CV_FOLDS, des: Design | None = None) -> dict:
    """ML16: grid (50 log-spaced alphas; x 9 l1 ratios for elastic net) or seeded random search."""
    des = des or build_design(df, n_splits=cv_folds)
    alphas = list(alpha_range) if alpha_range is not None else alpha_grid()
    ratios = list(np.linspace(0.1, 0.9, 9)) if model_type == "elasticnet" else [0.5]
    cands = [(a, r) for a in alphas for r in ratios]
    if search_type != "grid" and len(cands) > n_iter:
        cands = random.Random(random_state).sample(cands, n_iter)
    scores = cv_mse_grid(des, model_type, cands)
    best = int(np.argmin(scores))
    alpha, l1 = cands[best]
    model = fit_on_design(des, model_type, alpha, l1, validate=False)
    return {"best_params": {"alpha": float(alpha), "l1_ratio": float(l1)}, "best_cv_mse": scores[best],
            "best_cv_rmse": float(np.sqrt(scores[best])), "cv_scores": scores, "n_candidates": len(cands),
            "search_type": search_type, "model": model}


def compare_regularization_strengths(df: DataFrame, model_type: str = "ridge", alphas=None) -> list[dict]:
    """ML17: fits at alpha .001 ... 100 on all rows; metrics from one scoring pass."""
    des = build_design(df, n_splits=None)
    alphas = alphas or C.ALPHA_STRENGTHS
    fits = {f"a{i}": G.solve(des.total, model_type, a) for i, a in enumerate(alphas)}
    m = scored_metrics(des.df, des.target, fits)
    rows = []
    for i, a in enumerate(alphas):
        r = {"alpha": a, "train_r2": m[f"a{i}"]["r2"], "train_rmse": m[f"a{i}"]["rmse"],
             "train_mae": m[f"a{i}"]["mae"], "n_features": len(des.features)}
        if model_type == "lasso":
            sel = int(np.sum(np.abs(fits[f"a{i}"].coef) > C.NONZERO_COEF_TOL))
            r["n_selected_features"] = sel
            r["sparsity"] = 1 - sel / len(des.features)
        rows.append(r)
    return sorted(rows, key=lambda r: -r["train_r2"])


def compare_regularization_methods(df: DataFrame) -> list[dict]:
    """ML18: ML16 grid for ridge, lasso, elastic net on one Gram set; sort by CV RMSE."""
    des = build_design(df)
    rows = []
    for method in ("ridge", "lasso", "elasticnet"):
        t = tune_alpha(df, method, des=des)
        best = fit_on_design(des, method, t["best_params"]["alpha"], t["best_params"]["l1_ratio"], validate=False)
        r = {"method": method, "best_alpha": t["best_params"]["alpha"], "cv_rmse": t["best_cv_rmse"],
             "train_r2": best.train_metrics["r2"], "train_rmse": best.train_metrics["rmse"],
             "train_mae": best.train_metrics["mae"],
             "directional_accuracy": best.train_metrics["directional_accuracy"]}
        if method == "lasso":
            sel = best.selected_features()
            r["n_selected_features"] = len(sel)
            r["sparsity_ratio"] = 1 - len(sel) / len(best.features)
        if method == "elasticnet":
            r["l1_ratio"] = t["best_params"]["l1_ratio"]
        rows.append(r)
    return sorted(rows, key=lambda r: r["cv_rmse"])


def rows_to_df(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Small result dictionaries -> DataFrame (JSON for nested values)."""
    if not rows:
        return spark.createDataFrame([], "empty string")
    keys = list(dict.fromkeys(k for r in rows for k in r))
    clean = []
    for r in rows:
        clean.append({k: (json.dumps(v) if isinstance(v, (list, dict, tuple)) else v) for k, v in
                      ((k, r.get(k)) for k in keys)})
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame(clean, columns=keys))
