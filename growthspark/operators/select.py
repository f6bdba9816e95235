"""Feature selection (FS1-FS8), all from Gram statistics.

Univariate F-tests, recursive elimination, forward search, correlation
filters and RFE-CV are p x p algebra on sums Spark computed once; the
bootstrap (FS8) gets one Gram per replicate from one pass over the rows, with
Poisson(1) weights drawn from a seeded hash of (row, replicate): a matrix
product per Arrow batch, so no row is multiplied, resampled or collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dist
from . import gram as G
from . import models as M


# FS1 ------------------------------------------------------------------------
def univariate_scores(g: G.Gram) -> list[dict]:
    """F = r^2 / (1 - r^2) (n - 2) per feature against the target, p-value from F(1, n-2)."""
    r = G.correlation(g)
    p = len(g.names) - 1
    n = g.n
    out = []
    for j in range(p):
        rj = r[j, p]
        if not np.isfinite(rj):
            f, pv = float("nan"), float("nan")
        elif abs(rj) >= 1:
            f, pv = float("inf"), 0.0
        else:
            f = rj * rj / (1 - rj * rj) * (n - 2)
            pv = dist.f_sf(f, 1, n - 2)
        out.append({"feature": g.names[j], "correlation": float(rj), "score": float(f), "p_value": float(pv)})
    return out


def select_univariate(g: G.Gram, k: int = 10) -> list[dict]:
    rows = univariate_scores(g)
    order = sorted(range(len(rows)), key=lambda j: -(rows[j]["score"] if np.isfinite(rows[j]["score"]) else -1))
    chosen = set(order[:min(k, len(rows))])
    for j, r in enumerate(rows):
        r["selected"] = j in chosen
    return sorted(rows, key=lambda r: -(r["score"] if np.isfinite(r["score"]) else -1))


# FS2 ------------------------------------------------------------------------
def recursive_elimination(g: G.Gram, k: int = 10, model_type: str = "linear", alpha: float = 1.0):
    """Drop the smallest |coef| (scaled features) until k remain; ranking 1 = kept."""
    p = len(g.names) - 1
    active = list(range(p))
    ranking = {}
    center, scale = G.scaler_from(g)
    rank = p - k + 1
    while len(active) > k:
        sub = g.subset(active + [p])
        fit = G.solve(sub, model_type, alpha, 0.5, center[active], scale[active])
        drop = active[int(np.argmin(np.abs(fit.coef)))]
        ranking[g.names[drop]] = rank
        rank -= 1
        active.remove(drop)
    for j in active:
        ranking[g.names[j]] = 1
    return [g.names[j] for j in active], ranking


# FS3 ------------------------------------------------------------------------
def forward_path(des: M.Design, steps: int) -> list[tuple[int, float]]:
    """(feature index, mean validation R2 with it and all before it), best first at every step.

    The scaler is fitted on all rows (B22); fold fits and scores are Gram algebra.
    """
    target = len(des.features)
    center, scale = G.scaler_from(des.total)
    grams = [(des.seg_range(a, b), des.seg_range(c, d)) for a, b, c, d in des.plan.folds]

    def mean_r2(subset: list[int]) -> float:
        cols = [*subset, target]
        errors = (G.sse_on(test.subset(cols), G.solve(train.subset(cols), "linear", center=center[subset], scale=scale[subset]))
                  for train, test in grams)
        return float(np.mean([1 - sse / sst if sst else float(sse == 0) for sse, sst in errors]))

    path: list[tuple[int, float]] = []
    while len(path) < min(steps, target):
        taken = [j for j, _ in path]
        path.append(max(((j, mean_r2([*taken, j])) for j in range(target) if j not in taken), key=lambda t: t[1]))
    return path


def forward_selection(des: M.Design, k: int = 10) -> dict:
    """The forward path up to the last step that still raises the mean validation R2."""
    path = forward_path(des, k)
    r2 = [s for _, s in path]
    gain = [s > t for s, t in zip(r2, [float("-inf"), *r2])]
    kept = path[:gain.index(False) if False in gain else len(path)]
    names = [des.features[j] for j, _ in kept]
    return {"selected_features": names, "best_cv_score": kept[-1][1] if kept else float("-inf"),
            "selection_order": dict(zip(names, range(1, len(names) + 1)))}


# FS4 ------------------------------------------------------------------------
def feature_scores(spark: SparkSession, g: G.Gram) -> DataFrame:
    """(feature, position, variance, target_correlation) of every feature, from one Gram aggregate."""
    p = len(g.names) - 1
    variance, r = np.diag(g.scatter()) / g.n, np.abs(G.correlation(g)[:, p])
    return spark.createDataFrame([(g.names[j], j, float(variance[j]), float(r[j])) for j in range(p)],
                                 "feature string, position int, variance double, target_correlation double")


def feature_pairs(spark: SparkSession, g: G.Gram) -> DataFrame:
    """(first, second, r): |correlation| of every two features, in column order."""
    r = np.abs(G.correlation(g))
    first, second = np.triu_indices(len(g.names) - 1, 1)
    return spark.createDataFrame([(int(i), int(j), float(r[i, j])) for i, j in zip(first, second)],
                                 "first int, second int, r double")


def filter_selection(spark: SparkSession, g: G.Gram, k: int = 10, var_threshold: float = 0.01,
                     corr_limit: float = 0.95) -> DataFrame:
    """Feature-score table with ``selected``: variance above the threshold, not the redundant half of a
    correlated pair, and among the ``k`` largest target correlations.

    Pairs above the limit are folded strongest first into the set of redundant
    features; a pair one of whose ends is redundant already adds nothing.
    """
    scores = feature_scores(spark, g)
    varied = scores.where(F.col("variance") > var_threshold)
    alive = F.array_sort(F.collect_set("position"))
    near = feature_pairs(spark, g).where((F.col("r") > corr_limit) & ~F.isnan("r"))
    row = varied.agg(alive.alias("alive")).select("alive", F.lit(1).alias("one")).join(
        near.agg(F.sort_array(F.collect_list(F.struct("r", "first", "second")), asc=False).alias("pairs"), F.lit(1).alias("one")), "one")
    redundant = F.aggregate(
        F.filter("pairs", lambda x: F.array_contains("alive", x["first"]) & F.array_contains("alive", x["second"])),
        F.array().cast("array<int>"),
        lambda gone, x: F.when(F.array_contains(gone, x["first"]) | F.array_contains(gone, x["second"]), gone)
        .otherwise(F.array_append(gone, x["second"])))
    free = row.select(F.explode(F.array_except("alive", redundant)).alias("position")).withColumn("free", F.lit(True))
    table = scores.join(free, "position", "left")
    order = Window.partitionBy("free").orderBy(F.desc("target_correlation"), "position")  # one row per feature
    return table.select("feature", "position", "variance", "target_correlation",
                        (F.col("free").isNotNull() & (F.row_number().over(order) <= k)).alias("selected"))


# FS5 ------------------------------------------------------------------------
def rfe_cv(des: M.Design, model_type: str = "ridge", min_features: int = 5, alpha: float = 1.0) -> dict:
    """Best feature count by mean test MSE over the folds (ties -> fewer features)."""
    p = len(des.features)
    folds = des.plan.folds
    scores = np.zeros((len(folds), p - min_features + 1))
    for fi, (a, b, c, d) in enumerate(folds):
        tr, te = des.seg_range(a, b), des.seg_range(c, d)
        center, scale = G.scaler_from(tr)
        active = list(range(p))
        while True:
            ff = G.solve(tr.subset(active + [p]), model_type, alpha, 0.5, center[active], scale[active])
            sse, _ = G.sse_on(te.subset(active + [p]), ff)
            scores[fi, len(active) - min_features] = -sse / te.n
            if len(active) <= min_features:
                break
            active.remove(active[int(np.argmin(np.abs(ff.coef)))])
    mean = scores.mean(axis=0)
    best_n = int(min_features + (len(mean) - 1 - np.argmax(mean[::-1])))
    sel, ranking = recursive_elimination(des.total, best_n, model_type, alpha)
    return {"n_features_selected": best_n, "selected_features": sel, "feature_ranking": ranking,
            "cv_scores": {int(min_features + i): float(m) for i, m in enumerate(mean)}}


# FS6 ------------------------------------------------------------------------
def transform(df: DataFrame, selected: list) -> DataFrame:
    if "weekly_posting_frequency" not in df.columns and all(c in df.columns for c in ("posts", "reels", "stories")):
        df = df.withColumn("weekly_posting_frequency", F.col("posts") + F.col("reels") + F.col("stories"))
    return df.select(*[c for c in selected if c in df.columns])


def selection_summary(method: str, features: list, selected: list) -> dict:
    return {"selection_method": method, "total_features_available": len(features),
            "features_selected": len(selected), "selection_ratio": len(selected) / len(features),
            "selected_features": selected, "top_features": selected[:5]}


def select_features(des: M.Design, method: str = "univariate", k: int = 10) -> list:
    g = des.total
    if method == "univariate":
        return [r["feature"] for r in select_univariate(g, k) if r["selected"]]
    if method == "recursive":
        return recursive_elimination(g, min(k, len(des.features)))[0]
    if method == "filter":
        kept = filter_selection(des.df.sparkSession, g, k).where("selected")
        return [r["feature"] for r in kept.orderBy(F.desc("target_correlation"), "position").collect()]
    if method == "wrapper":
        return forward_selection(des, k)["selected_features"]
    raise ValueError(method)


# FS7 ------------------------------------------------------------------------
def compare_selection_methods(df: DataFrame, methods=("univariate", "recursive", "filter"), k: int = 8) -> list:
    des = M.build_design(df, n_splits=3)
    rows = []
    for m in methods:
        sel = select_features(des, m, k)
        row = {"method": m, "n_features_selected": len(sel), "selected_features": ", ".join(sel[:3]) + "...",
               "selection_criterion": {"univariate": "f_regression_score", "recursive": "recursive_elimination",
                                       "filter": "variance_correlation_filter",
                                       "wrapper": "forward_selection_cv"}[m]}
        if m == "wrapper":
            row["cv_score"] = forward_selection(des, k)["best_cv_score"]
        rows.append(row)
    return rows


# FS8 ------------------------------------------------------------------------
def feature_stability_analysis(df: DataFrame, method: str = "univariate", n_bootstrap: int = 10,
                               k: int = 8, seed: int = 42) -> dict:
    """Selection frequency over bootstrap replicates (B25: stability score = unique / total,
    plus the mean pairwise Jaccard similarity)."""
    feats, tgt = M.prepare_features(df)
    date_col = "week_start" if "week_start" in df.columns else "date"
    key_cols = [c for c in ("username", date_col) if c in df.columns]
    d = df.select(*key_cols, *[F.col(c).cast("double").alias(c) for c in feats + [tgt]])
    med = M.training_medians(d, feats + [tgt])
    d = M.impute(d, med).withColumn("_rowkey", F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]))
    shift = G.global_means(d, feats + [tgt])
    grams = G.bootstrap_grams(d, feats, tgt, F.xxhash64(F.lit(seed), F.col("_rowkey")), n_bootstrap, shift)
    counts = {f: 0 for f in feats}
    picks = []
    for g in grams:
        if g.n < 3:
            continue
        gd = M.Design(d, feats, tgt, date_col, med, {0: g}, None, shift)
        if method in ("univariate", "recursive", "filter"):
            sel = select_features(gd, method, k)
        else:
            raise ValueError("bootstrap supports univariate, recursive, filter")
        picks.append(set(sel))
        for f in sel:
            counts[f] += 1
    total = sum(len(s) for s in picks)
    uniq = len(set().union(*picks)) if picks else 0
    jac = [len(a & b) / len(a | b) for i, a in enumerate(picks) for b in picks[i + 1:] if a | b]
    freq = sorted(({"feature": f, "selection_frequency": c / n_bootstrap, "selection_count": c}
                   for f, c in counts.items()), key=lambda x: -x["selection_frequency"])
    return {"method": method, "n_bootstrap": n_bootstrap, "stability_score": uniq / total if total else 0.0,
            "mean_jaccard": float(np.mean(jac)) if jac else 0.0, "feature_stability": freq,
            "most_stable_features": [x["feature"] for x in freq[:k]]}
