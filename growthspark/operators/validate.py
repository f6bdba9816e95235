"""Time-ordered validation (CV1-CV11).

Folds are cut on the sorted *distinct dates* (B27: no date on both sides of
a border, many creators per date).  Every fold fit comes from prefix sums of
per-segment Gram statistics (one Spark aggregate); the metrics that need the
rows (MAE, direction, ranges) come from one scoring pass in which each row is
routed to the folds it belongs to.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import dist
from . import gram as G
from . import models as M
from .metrics import regression_metrics


# CV1 ------------------------------------------------------------------------
def time_series_split(df: DataFrame, n_splits: int = 5, test_size: int | None = None, gap: int = 0,
                      max_train_size: int | None = None, date_col: str = "week_start") -> DataFrame:
    """Fold table: fold, split, first and last date, number of dates.

    Distinct dates are ranked with a window over the small distinct-date
    table (bounded by the calendar); the folds are arithmetic on that rank.
    """
    dates = df.select(F.col(date_col).alias("d")).where(F.col("d").isNotNull()).distinct()
    ranked = dates.withColumn("pos", F.row_number().over(Window.orderBy("d")) - 1)
    n = ranked.agg(F.count(F.lit(1)).alias("n")).collect()[0]["n"]
    folds = G.time_series_folds(n, n_splits, test_size, gap, max_train_size)
    # fold membership as an expression (explode of the matching folds): no join
    member = F.array_compact(F.array(*[
        F.when((F.col("pos") >= lo) & (F.col("pos") < hi), F.struct(F.lit(i + 1).alias("fold"), F.lit(s).alias("split")))
        for i, (a, b, c, d) in enumerate(folds) for s, lo, hi in (("train", a, b), ("test", c, d))]))
    j = ranked.select("d", F.explode(member).alias("x")).select("d", "x.fold", "x.split")
    return j.groupBy("fold", "split").agg(F.min("d").alias("date_from"), F.max("d").alias("date_to"),
                                           F.count(F.lit(1)).alias("n_dates"))


# CV11 -----------------------------------------------------------------------
def train_test_split_by_time(df: DataFrame, test_fraction: float = 0.2, date_col: str = "week_start") -> DataFrame:
    """80/20 time split on the distinct-date rank; adds ``split`` (train/test)."""
    dates = df.select(F.col(date_col).alias("_d")).where(F.col("_d").isNotNull()).distinct()
    ranked = dates.withColumn("_pos", F.row_number().over(Window.orderBy("_d")) - 1)
    n = ranked.count()
    cut = int(np.floor(n * (1 - test_fraction)))
    border = ranked.where(F.col("_pos") == cut).select("_d").collect()
    if not border:
        return df.withColumn("split", F.lit("train"))
    b = border[0][0]
    return df.withColumn("split", F.when(F.col(date_col) < F.lit(b), "train").otherwise("test"))


# CV2-CV7, CV10 -----------------------------------------------------------------
def cross_validate(df: DataFrame, model_type: str = "linear", alpha: float = 1.0, l1_ratio: float = 0.5,
                   n_splits: int = 5, test_size=None, gap: int = 0, max_train_size=None,
                   cv_scale: str = "all") -> dict:
    """CV10: prepare X, y (training medians for gaps), fold fits, fold detail, summaries."""
    date_col = "week_start" if "week_start" in df.columns else "date"
    dates = G.distinct_dates(df, date_col)
    fp = G.time_series_folds(len(dates), n_splits, test_size, gap, max_train_size)
    des = M.build_design(df, folds_pos=fp)
    full = G.solve(des.total, model_type, alpha, l1_ratio)
    seg = des.plan.seg_expr(des.date_col)
    fits, sel = {}, {}
    for i, (a, b, c, d) in enumerate(des.plan.folds):
        tr = des.seg_range(a, b)
        center, scale = (full.center, full.scale) if cv_scale == "all" else G.scaler_from(tr)
        ff = G.solve(tr, model_type, alpha, l1_ratio, center, scale)
        fits[f"test{i}"] = ff
        fits[f"train{i}"] = ff
        sel[f"test{i}"] = (seg >= c) & (seg < d)
        sel[f"train{i}"] = (seg >= a) & (seg < b)
    detail = fold_detail(des, fits, sel)
    scores = fold_scores(des.df.sparkSession, detail)
    summary = cv_summary(scores, len(detail))
    weights = fold_weights(des.df.sparkSession, des.features, [fits[f"test{i}"].coef for i in range(len(detail))])
    return {"fold_detail": detail, "summary": summary, "stability": stability(summary),
            "coefficient_consistency": coefficient_consistency(weights), "temporal": fold_trend(scores),
            "features": des.features}


def fold_detail(des: M.Design, fits: dict, sel: dict) -> list[dict]:
    """CV4: per fold train/test MSE, MAE, R2, direction, mean actual/predicted, range, top 5."""
    names = list(fits)
    m = regression_metrics(M.predicted(des.df, des.target, fits, sel), by=["_fid"], extra={
        "mean_prediction": F.avg("y_pred"), "mean_actual": F.avg("y_true"),
        "prediction_range": F.max("y_pred") - F.min("y_pred")}).collect()
    by = {names[r["_fid"]]: r.asDict() for r in m}
    k = len([n for n in names if n.startswith("test")])
    out = []
    for i in range(k):
        te, tr = by.get(f"test{i}", {}), by.get(f"train{i}", {})
        ff = fits[f"test{i}"]
        top = sorted(zip(des.features, ff.coef), key=lambda t: -abs(t[1]))[:5]
        out.append({"fold_number": i + 1, "train_size": tr.get("n"), "test_size": te.get("n"),
                    "train_mse": tr.get("mse"), "test_mse": te.get("mse"), "train_mae": tr.get("mae"),
                    "test_mae": te.get("mae"), "train_r2": tr.get("r2"), "test_r2": te.get("r2"),
                    "directional_accuracy": te.get("directional_accuracy"),
                    "mean_prediction": te.get("mean_prediction"), "mean_actual": te.get("mean_actual"),
                    "prediction_range": te.get("prediction_range"),
                    "top_features": [(f, float(w)) for f, w in top]})
    return out


def fold_scores(spark: SparkSession, detail: list[dict]) -> DataFrame:
    """One row per fold and metric: the table that CV3, CV5 and CV7 are aggregates of."""
    rows = [(int(d["fold_number"]), m, d[f"train_{m}"], d[f"test_{m}"]) for d in detail for m in C.CV_METRICS]
    return spark.createDataFrame(rows, "fold int, metric string, train double, test double")


def fold_weights(spark: SparkSession, features: list, coefs: list) -> DataFrame:
    """One row per fold and feature: the table that CV6 is an aggregate of."""
    rows = [(i + 1, f, float(w)) for i, c in enumerate(coefs) for f, w in zip(features, c)]
    return spark.createDataFrame(rows, "fold int, feature string, coef double")


def cv_summary(scores: DataFrame, n_folds: int) -> DataFrame:
    """CV3 per metric: mean, std (population), min, max, CV, 95 % interval, train scores, overfitting gap.

    The interval is mean +- t(.975, n-1) * std_samp / sqrt(n) (AG10); with one
    fold it is the mean.  The gap is how much worse the test side is, at least 0.
    """
    half = F.coalesce(F.stddev_samp("test"), F.lit(0.0)) * F.lit(
        dist.t_ppf(0.975, n_folds - 1) / np.sqrt(n_folds) if n_folds > 1 else 0.0)
    t = scores.groupBy("metric").agg(
        F.avg("test").alias("mean"), F.stddev_pop("test").alias("std"), F.min("test").alias("min"),
        F.max("test").alias("max"), half.alias("half"), F.avg("train").alias("train_mean"),
        F.stddev_pop("train").alias("train_std"))
    better = F.when(F.col("metric") == "r2", F.lit(1.0)).otherwise(F.lit(-1.0))  # is a high score good?
    return t.select(
        "metric", "mean", "std", "min", "max",
        F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).otherwise(F.lit(float("inf"))).alias("cv"),
        (F.col("mean") - F.col("half")).alias("ci95_lower"), (F.col("mean") + F.col("half")).alias("ci95_upper"),
        "train_mean", "train_std",
        F.greatest(F.lit(0.0), better * (F.col("train_mean") - F.col("mean"))).alias("overfitting_score"))


def stability(summary: DataFrame) -> DataFrame:
    """CV5, one row per metric: stable if its coefficient of variation is below the limit; the share of
    stable metrics and the assessment stand on every row."""
    stable = F.col("cv") < C.CV_STABLE_BELOW
    every = Window.partitionBy()  # one row per metric
    share = F.avg(stable.cast("double")).over(every)
    return summary.select(
        "metric", F.col("cv").alias("coefficient_of_variation"), stable.alias("stable"),
        (F.col("max") - F.col("min")).alias("score_range"), share.alias("stability_score"),
        F.when(share >= C.CV_STABLE_SHARE, "Stable").otherwise("Unstable").alias("assessment"))


def coefficient_consistency(weights: DataFrame) -> DataFrame:
    """CV6 per feature: spread of its coefficient over the folds, and the share of folds on the mean's side of 0."""
    t = weights.groupBy("feature").agg(
        F.avg("coef").alias("mean"), F.stddev_pop("coef").alias("coef_std"),
        *[F.avg((F.signum("coef") == v).cast("double")).alias(n) for n, v in (("up", 1), ("zero", 0), ("down", -1))])
    same = F.when(F.col("mean") > 0, F.col("up")).when(F.col("mean") < 0, F.col("down")).otherwise(F.col("zero"))
    ratio = F.when(F.col("mean") != 0, F.col("coef_std") / F.abs("mean")).otherwise(
        F.when(F.col("coef_std") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    return t.select("feature", "coef_std", ratio.alias("coef_cv"), same.alias("sign_consistency"))


def fold_trend(scores: DataFrame) -> DataFrame:
    """CV7, one row: correlation of the fold number with test R2 and MAE, ranges, best and worst fold (first of ties)."""
    def of(metric, c="test"):
        return F.when(F.col("metric") == metric, F.col(c).cast("double"))

    def trend(metric):
        r = F.when((F.stddev_pop(of(metric)) > 0) & (F.stddev_pop(of(metric, "fold")) > 0),
                   F.corr(of(metric, "fold"), of(metric))).otherwise(F.lit(float("nan")))
        return F.when(F.count(of(metric)) <= 2, F.lit(0.0)).otherwise(r)

    r2 = F.when(F.col("metric") == "r2", F.struct(F.col("test"), (-F.col("fold")).alias("f")))
    low = F.when(F.col("metric") == "r2", F.struct(F.col("test"), F.col("fold").alias("f")))
    t = scores.agg(trend("r2").alias("r2_trend_correlation"), trend("mae").alias("mae_trend_correlation"),
                   *[(F.max(of(m)) - F.min(of(m))).alias(f"{m}_range") for m in ("r2", "mae")],
                   (-F.max(r2)["f"]).alias("best_fold"), F.min(low)["f"].alias("worst_fold"))
    r = F.when(F.isnan("r2_trend_correlation"), None).otherwise(F.col("r2_trend_correlation"))
    return t.select(
        "r2_trend_correlation", "mae_trend_correlation",
        F.coalesce(r < -C.CV_TREND_LIMIT, F.lit(False)).alias("performance_degradation"),
        F.coalesce(r > C.CV_TREND_LIMIT, F.lit(False)).alias("performance_improvement"),
        F.coalesce(F.abs(r) < C.CV_FLAT_LIMIT, F.lit(False)).alias("consistent_performance"),
        "r2_range", "mae_range", "best_fold", "worst_fold")


# CV8 / CV9 ------------------------------------------------------------------
def _window_validation(df: DataFrame, folds_pos: list, model_type: str, alpha: float) -> list[dict]:
    """Test windows do not overlap, so a row has one fit at most: the fits are a small table (a row per segment,
    bounded by the calendar) joined by the row's segment, and the plan does not grow with the number of windows."""
    des = M.build_design(df, folds_pos=folds_pos)
    spark = des.df.sparkSession
    rows = []
    for i, (a, b, c, d) in enumerate(des.plan.folds):
        tr = des.seg_range(a, b)
        intercept, weights = G.solve(tr, model_type, alpha, 0.5, *G.scaler_from(tr)).raw()
        rows += [(seg, i, float(intercept), [float(w) for w in weights]) for seg in range(c, d)]
    fits = spark.createDataFrame(rows, "_seg int, _fid int, _b double, _w array<double>")
    products = F.zip_with(F.array(*[F.col(f).cast("double") for f in des.features]), F.col("_w"), lambda x, w: x * w)
    x = (des.df.withColumn("_seg", des.plan.seg_expr(des.date_col)).join(F.broadcast(fits), "_seg")
         .withColumn("y_pred", F.col("_b") + F.aggregate(products, F.lit(0.0), lambda s, v: s + v))
         .withColumn("y_true", F.col(des.target)))
    m = {r["_fid"]: r.asDict() for r in regression_metrics(x, by=["_fid"]).collect()}
    out = []
    for i, (a, b, c, d) in enumerate(folds_pos):
        r = m.get(i, {})
        r2 = r.get("r2") if (r.get("n") or 0) > 1 else None  # B26: no R2 on one row
        out.append({"window": i + 1, "train_end": des.plan.dates[b - 1], "test_start": des.plan.dates[c],
                    "test_end": des.plan.dates[d - 1], "n_test": r.get("n"), "mse": r.get("mse"),
                    "mae": r.get("mae"), "r2": r2, "directional_accuracy": r.get("directional_accuracy")})
    return out


def walk_forward_validation(df: DataFrame, initial_train_size: int, step_size: int = 1,
                            model_type: str = "linear", alpha: float = 1.0, date_col: str = "week_start") -> list[dict]:
    """CV8: refit on all dates before each step, test on the next ``step_size`` dates."""
    n = len(G.distinct_dates(df, date_col))
    fp = [(0, s, s, min(s + step_size, n)) for s in range(initial_train_size, n, step_size)]
    return _window_validation(df, fp, model_type, alpha)


def expanding_window_validation(df: DataFrame, min_train_size: int, test_size: int,
                                model_type: str = "linear", alpha: float = 1.0, date_col: str = "week_start") -> list[dict]:
    """CV9: expanding train windows, full test windows only."""
    n = len(G.distinct_dates(df, date_col))
    fp = [(0, s, s, s + test_size) for s in range(min_train_size, n - test_size + 1, test_size)]
    return _window_validation(df, fp, model_type, alpha)
