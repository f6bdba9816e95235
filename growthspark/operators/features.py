"""Feature engineering (FE4-FE14).

All quantile thresholds of a step are computed in one statistics pass
(``functions.stats``) and inlined as literals; per-creator windows share one
``partitionBy(username)`` so Spark sorts each creator once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import exprs as X
from ..functions.stats import global_order_stats, interpolate, scoped_quantiles
from ..session import write_once
from . import weekly as W
from . import windows as WN

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _has(df: DataFrame, *cols) -> bool:
    return all(c in df.columns for c in cols)


# FE4 ------------------------------------------------------------------------
def create_daily_features(df: DataFrame, creator: str = "username") -> DataFrame:
    """Daily path: posting total, WN2 rolling, FE1 mix, WN3 momentum, WN4 trend."""
    out = df.withColumn("daily_posting_frequency", F.col("posts") + F.col("reels") + F.col("stories"))
    out = WN.add_daily_rolling_features(out, creator)
    out = W.add_content_mix_features(out)
    out = WN.add_growth_momentum(out, creator)
    if "engagement_rate" in out.columns:
        out = WN.add_rolling_slope(out, "engagement_rate", 7, "engagement_trend", creator)
    return out


# FE5-FE10 -------------------------------------------------------------------
def engagement_quality_raw(df: DataFrame):
    parts = [(F.col(c) * w) for c, w in C.ENGAGEMENT_WEIGHTS if c in df.columns]
    weighted = reduce(lambda a, b: a + b, parts)
    return X.safe_divide(weighted, F.col("reach") if "reach" in df.columns else F.lit(1))


def audience_quality_raw(df: DataFrame):
    w1, w2, w3 = C.AUDIENCE_WEIGHTS
    follows = F.col("follows") if "follows" in df.columns else F.lit(0)
    visits = F.col("profile_visits") if "profile_visits" in df.columns else F.lit(1)
    reach = F.col("reach") if "reach" in df.columns else F.lit(1)
    return (w1 * X.safe_divide(follows, visits) + w2 * X.safe_divide(visits, reach)
            + w3 * X.safe_divide(follows, reach))


def _normalise(raw: str, q95) -> F.Column:
    """score / q95 clipped to [0, 1] when q95 > 0, else the raw score; q95 a number or a column."""
    if isinstance(q95, Column):
        return F.when(q95 > 0, X.clip(F.col(raw) / q95, 0.0, 1.0)).otherwise(F.col(raw))
    if q95 is not None and q95 > 0:
        return X.clip(F.col(raw) / F.lit(q95), 0.0, 1.0)
    return F.col(raw)


def add_advanced_features(df: DataFrame, scope=()) -> DataFrame:
    """FE10 = FE5 engagement quality, FE6 audience quality, FE7 efficiency and
    sustainability, FE8 tiers, FE9 saturation -- one quantile pass for all eight
    thresholds (``scope``: one window pass, thresholds per e.g. creator).
    B10: on the daily path only features whose inputs exist."""
    weekly = _has(df, "weekly_growth", "weekly_posting_frequency")
    out = df.withColumn("_eq", engagement_quality_raw(df)).withColumn("_aq", audience_quality_raw(df))
    specs = {"eq95": ("_eq", 0.95), "aq95": ("_aq", 0.95)}
    if weekly:
        out = out.withColumn("growth_efficiency", X.safe_divide("weekly_growth", "weekly_posting_frequency"))
        specs.update({"eff70": ("growth_efficiency", 0.7), "eff30": ("growth_efficiency", 0.3),
                      "wpf80": ("weekly_posting_frequency", 0.8)})
        if "engagement_rate" in df.columns:
            specs["rate30"] = ("engagement_rate", 0.3)
        if _has(df, "minutes_spent", "roi_follows_per_hour"):
            specs.update({"min80": ("minutes_spent", 0.8), "roi30": ("roi_follows_per_hour", 0.3)})
    if scope:
        out = scoped_quantiles(out, {f"_q_{k}": v for k, v in specs.items()}, scope)
        q = {k: F.col(f"_q_{k}") for k in specs}
    else:
        q = {k: interpolate(v) for k, v in global_order_stats(out, specs).items()}
    out = (out.withColumn("engagement_quality_score", _normalise("_eq", q["eq95"]))
              .withColumn("audience_quality_score", _normalise("_aq", q["aq95"])).drop("_eq", "_aq"))
    if weekly:
        gt = (lambda c, k: F.coalesce(F.col(c) > F.lit(q[k]), F.lit(False)) if q.get(k) is not None else F.lit(False))
        lt = (lambda c, k: F.coalesce(F.col(c) < F.lit(q[k]), F.lit(False)) if q.get(k) is not None else F.lit(False))
        reg = (F.coalesce(F.col("posting_regularity_score") > 0.5, F.lit(False))
               if "posting_regularity_score" in df.columns else F.lit(False))
        out = out.withColumn("sustainable_growth_indicator", (gt("growth_efficiency", "eff70") & reg).cast("int"))
        out = out.withColumn("posting_tier", X.cut("weekly_posting_frequency", C.POSTING_TIER_BINS,
                                                   C.POSTING_TIER_LABELS))
        sat = lt("growth_efficiency", "eff30")
        if "rate30" in q:
            sat = sat | (gt("weekly_posting_frequency", "wpf80") & lt("engagement_rate", "rate30"))
        if "min80" in q:
            sat = sat | (gt("minutes_spent", "min80") & lt("roi_follows_per_hour", "roi30"))
        out = out.withColumn("potential_saturation", sat.cast("int"))
    if "engagement_rate" in df.columns:
        out = out.withColumn("engagement_tier", X.cut("engagement_rate", C.ENGAGEMENT_TIER_BINS,
                                                      C.ENGAGEMENT_TIER_LABELS))
    return out.drop(*[f"_q_{k}" for k in specs])


# FE11 -----------------------------------------------------------------------
def add_interaction_features(df: DataFrame) -> DataFrame:
    """Eight products of the main predictors (weekly frame)."""
    if "weekly_posting_frequency" not in df.columns:
        return df
    f = F.col("weekly_posting_frequency")
    out = (df.withColumn("posting_freq_x_reels_share", f * F.col("share_reels"))
             .withColumn("posting_freq_x_posts_share", f * F.col("share_posts"))
             .withColumn("posting_freq_x_stories_share", f * F.col("share_stories")))
    if "posting_regularity_score" in df.columns:
        out = out.withColumn("posting_freq_x_regularity", f * F.col("posting_regularity_score"))
    if "posting_consistency_variance" in df.columns:
        out = out.withColumn("posting_freq_x_consistency",
                             f * F.try_divide(F.lit(1.0), 1 + F.col("posting_consistency_variance")))
    out = (out.withColumn("reels_share_x_engagement", F.col("share_reels") * F.col("engagement_rate"))
              .withColumn("posts_share_x_engagement", F.col("share_posts") * F.col("engagement_rate")))
    if "roi_follows_per_hour" in df.columns:
        out = out.withColumn("roi_x_posting_freq", F.col("roi_follows_per_hour") * f)
    return out


# FE12 -----------------------------------------------------------------------
def add_temporal_features(df: DataFrame, creator: str = "username") -> DataFrame:
    """FN5 + FN13 + FN12 on week_start (or date); WN5/WN6/WN4 on weekly growth."""
    dcol = "week_start" if "week_start" in df.columns else "date"
    out = df
    if dcol in df.columns:
        for k, v in X.date_feature_columns(dcol).items():
            out = out.withColumn(k, v)
        for k, v in X.calendar_flag_columns("day_of_month", "month").items():
            out = out.withColumn(k, v)
        ms, mc = X.cyclic("month", 12)
        ws, wc = X.cyclic("week_of_year", 52)
        out = (out.withColumn("month_sin", ms).withColumn("month_cos", mc)
                  .withColumn("week_sin", ws).withColumn("week_cos", wc))
    if "weekly_growth" in df.columns:
        out = WN.add_weekly_lags(out, creator, dcol)
    return out


# FE13 -----------------------------------------------------------------------
def _fill_zero(name: str) -> bool:
    n = name.lower()
    return "rate" in n or "ratio" in n or "share" in n or "score" in n


def finalize_features(df: DataFrame, target: str = "weekly_growth", keep=(), scope=()) -> DataFrame:
    """FN17, clip every numeric column to [q0.1 %, q99.9 %], fill (0 for
    rate/ratio/share/score names -- substring -- else the median after the
    clip), round half-even to 6 places; numeric columns come out as doubles.

    One statistics pass: the 0.001 / 0.5 / 0.999 order statistics of every
    numeric column; the clipped median is the median of the clipped order
    statistics (clipping is monotone), so no second pass is needed.  With a
    ``scope`` (e.g. the creator) bounds and medians are those of each row's
    scope, window aggregates over one partitioning.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in keep]
    num = set(numeric)
    # single projections (a withColumn per column makes plan analysis quadratic)
    out = df.select(*[X.finite_or_null(c).alias(c) if c in num else F.col(c) for c in df.columns])
    if scope:
        return _with_target(_finalize_scoped(out, numeric, scope), target)
    specs = {}
    for c in numeric:
        specs[f"{c}|lo"] = (c, 0.001)
        specs[f"{c}|md"] = (c, 0.5)
        specs[f"{c}|hi"] = (c, 0.999)
    st = global_order_stats(out, specs)
    final = {}
    for c in numeric:
        lo, hi = interpolate(st[f"{c}|lo"]), interpolate(st[f"{c}|hi"])
        x = F.col(c)
        if lo is not None:
            x = X.clip(x, lo, hi)
        if _fill_zero(c):
            fill = 0.0
        elif st[f"{c}|md"] is None:
            fill = None
        else:
            a, b, frac = st[f"{c}|md"]
            a, b = min(max(a, lo), hi), min(max(b, lo), hi)
            fill = a + frac * (b - a)
        if fill is not None:
            x = F.coalesce(x, F.lit(float(fill)))
        final[c] = X.round_half_even(x, 6)
    return _with_target(out.select(*[final[c].alias(c) if c in final else F.col(c) for c in out.columns]), target)


def _with_target(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn(target, F.col("growth")) if target not in df.columns and "growth" in df.columns else df


def _finalize_scoped(df: DataFrame, numeric, scope) -> DataFrame:
    """Clip, fill and round by the statistics of each row's scope: one window pass, no job of its own.

    Of three or more values the clip, which moves none past its neighbours,
    leaves the median as it is; the median of two is that of the clipped two.
    """
    num, w = set(numeric), Window.partitionBy(*scope)
    medians = [c for c in numeric if not _fill_zero(c)]
    wide = df.select("*", *[F.percentile(F.col(c), F.array(*[F.lit(p) for p in ((0.001, 0.999) if _fill_zero(c) else (0.001, 0.999, 0.5))])).over(w).alias(f"_q_{c}") for c in numeric],
                     *[F.count(c).over(w).alias(f"_n_{c}") for c in medians])

    def fixed(c):
        lo, hi = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        fill = F.lit(0.0) if _fill_zero(c) else F.when((F.col(f"_n_{c}") == 2) & (lo != hi), 0.5 * lo + 0.5 * hi).otherwise(F.col(f"_q_{c}")[2])
        # a missing value must not become a bound: greatest and least skip it
        return X.round_half_even(F.when(F.col(c).isNotNull(), F.greatest(lo, F.least(hi, F.col(c)))).otherwise(fill), 6)

    return wide.select(*[fixed(c).alias(c) if c in num else F.col(f"`{c}`") for c in df.columns])


FEATURE_CATEGORIES = {
    "primary_features": ["weekly_posting_frequency"],
    "content_mix": ["share_posts", "share_reels", "share_stories", "content_diversity"],
    "consistency": ["posting_regularity_score", "posting_consistency_variance"],
    "engagement": ["engagement_rate", "engagement_quality_score"],
    "roi_metrics": ["roi_follows_per_hour", "growth_efficiency"],
    "temporal": ["month", "quarter", "is_weekend"],
    "target": ["weekly_growth"],
}


def tag_feature_categories(df: DataFrame) -> DataFrame:
    """Column metadata in place of the reference's frame attribute."""
    cats = {c: k for k, cols in FEATURE_CATEGORIES.items() for c in cols}
    sel = []
    for c in df.columns:
        cat = cats.get(c) or ("interaction" if "_x_" in c else None)
        sel.append(F.col(c).alias(c, metadata={"feature_category": cat}) if cat else F.col(c))
    return df.select(*sel)


# FE14 -----------------------------------------------------------------------
def transform_to_model_ready(daily: DataFrame, target_frequency: str = "weekly",
                             include_advanced_features: bool = True, scope=(),
                             checkpoint: bool = True) -> DataFrame:
    """Weekly: AG1+AG2+FE1-FE3; daily: FE4; then FE10, FE11, FE12; then FE13.

    With ``checkpoint`` the table is written to the shared checkpoint folder
    before each multi-pass statistics step, so the (large) daily scan and the
    weekly shuffle run once instead of once per statistics job, and a lost
    executor never forces recomputation from the raw daily data.  With a
    ``scope`` no step is a job of its own: nothing is written, and the steps
    follow one another in the partitions of one shuffle by creator.
    """
    cut = write_once if checkpoint and not scope else (lambda d: d)
    if target_frequency == "weekly":
        t = W.weekly_feature_table(daily, scope, checkpoint=checkpoint)
    else:
        t = cut(create_daily_features(daily))
    if include_advanced_features:
        t = cut(add_temporal_features(add_interaction_features(add_advanced_features(t, scope))))
    return tag_feature_categories(finalize_features(t, scope=scope))


# AG12 -----------------------------------------------------------------------
def feature_summary(df: DataFrame) -> DataFrame:
    """Per numeric column: count, missing, mean, sample std (one aggregate, melted)."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    aggs = []
    for i, c in enumerate(numeric):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.sum(F.col(c).isNull().cast("long")).alias(f"m{i}"),
                 F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}")]
    one = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("missing"),
                      F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"))
             for i, c in enumerate(numeric)]
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def feature_overview(df: DataFrame) -> DataFrame:
    """Rows (item, name, value): totals, types and categories of the columns, and the date range.

    The counts over rows are one aggregate; types and categories come from the schema.
    """
    fields = df.schema.fields
    dated = next((c for c in ("date", "week_start", "week_end") if c in df.columns), None)
    row = lambda item, name, value: F.struct(F.lit(item).alias("item"), F.lit(name).alias("name"), value.cast("string").alias("value"))
    types: dict[str, int] = {}
    for f in fields:
        types[f.dataType.simpleString()] = types.get(f.dataType.simpleString(), 0) + 1
    cats = {c: k for k, cols in FEATURE_CATEGORIES.items() for c in cols}
    held: dict[str, int] = {}
    for f in fields:
        cat = cats.get(f.name) or ("interaction" if "_x_" in f.name else None)
        if cat:
            held[cat] = held.get(cat, 0) + 1
    items = [row("total_features", None, F.lit(len(fields))), row("total_samples", None, F.col("n")), row("missing_values", None, F.col("missing")),
             row("numeric_features", None, F.lit(sum(isinstance(f.dataType, NUMERIC) for f in fields)))]
    items += [row("feature_type", t, F.lit(k)) for t, k in sorted(types.items())]
    items += [row("feature_category", c, F.lit(k)) for c, k in sorted(held.items())]
    aggs = [F.count(F.lit(1)).alias("n"), reduce(lambda a, b: a + b, [F.count_if(F.col(f"`{f.name}`").isNull()) for f in fields]).alias("missing")]
    if dated:
        aggs += [F.min(dated).alias("start"), F.max(dated).alias("end")]
        items += [row("date_range", "start", F.col("start")), row("date_range", "end", F.col("end")), row("date_range", "periods", F.col("n"))]
    return df.agg(*aggs).select(F.explode(F.array(*items)).alias("x")).select("x.*")
