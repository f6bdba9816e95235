"""Report data (FN24, RP1-RP7): the numbers behind each chart, as DataFrames.

No figures are drawn here; every function returns the rows a plotting layer
would consume, computed by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def metric_card(df: DataFrame, value_col: str, order: str = "date", creator: str = "username",
                as_percentage: bool = False) -> DataFrame:
    """FN24: value, delta to the previous period (per creator), formatted text."""
    w = Window.partitionBy(creator).orderBy(F.col(order).asc_nulls_last())
    prev = F.lag(value_col).over(w)
    out = df.withColumn("_prev", prev).withColumn("delta", F.col(value_col) - F.col("_prev"))
    if as_percentage:
        vfmt = F.concat(F.format_number(F.col(value_col).cast("double"), 1), F.lit("%"))
        dfmt = F.concat(F.format_number(F.col("delta").cast("double"), 1), F.lit("pp"))
    else:
        vfmt = X.format_large_number(value_col)
        dfmt = X.format_large_number("delta")
    return (out.withColumn("value_fmt", vfmt)
               .withColumn("delta_fmt", F.when(F.col("_prev").isNotNull(), dfmt))
               .withColumn("delta_color", F.when(F.col("delta") < 0, "inverse").otherwise("normal"))
               .drop("_prev"))


# RP1 / RP5 ------------------------------------------------------------------
def growth_history(pred_with_bounds: DataFrame) -> DataFrame:
    """Actual, predicted and interval bounds by creator and date (the chart's series)."""
    cols = [c for c in ("username", "date", "y_true", "y_pred", "lower_bound", "upper_bound")
            if c in pred_with_bounds.columns]
    return pred_with_bounds.select(*cols)


# RP2 ------------------------------------------------------------------------
def posting_trend(daily: DataFrame) -> DataFrame:
    """Three stacked daily counts and their total, by creator and date."""
    return daily.select("username", "date", "posts", "reels", "stories",
                        (F.col("posts") + F.col("reels") + F.col("stories")).alias("total_content"))


def weekly_comparison(weekly: DataFrame) -> DataFrame:
    return weekly.select("username", "week_start", "weekly_posting_frequency", "weekly_growth")


# RP3 / AG4 ------------------------------------------------------------------
ENGAGEMENT_TYPES = ["post_likes", "comments", "saves", "shares", "reel_engagement", "story_engagement"]


def engagement_breakdown(daily: DataFrame, scope=()) -> DataFrame:
    """AG4: totals by engagement type (one aggregate, melted) and share of the total."""
    types = [c for c in ENGAGEMENT_TYPES if c in daily.columns]
    one = daily.groupBy(*scope).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in types])
    long = one.select(*scope, F.explode(F.array(*[F.struct(F.lit(c).alias("engagement_type"),
                                                          F.col(c).alias("total")) for c in types])).alias("x"))
    long = long.select(*scope, "x.*")
    w = Window.partitionBy(*scope) if scope else Window.partitionBy(F.lit(1))
    return long.withColumn("share", F.col("total") / F.sum("total").over(w))


# RP4 ------------------------------------------------------------------------
def residual_histogram(pred: DataFrame, bins: int = 30) -> DataFrame:
    """Histogram of residuals: equal-width bins between min and max (floor((e-min)/width))."""
    e = F.col("y_true").cast("double") - F.col("y_pred").cast("double")
    mm = pred.agg(F.min(e).alias("lo"), F.max(e).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor((e - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    from ..functions.stats import attach_row
    x = attach_row(pred, mm).select(F.when(width > 0, b).otherwise(F.lit(0)).alias("bin"),
                                               "lo", "hi")
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"),
                                (F.first("lo") + F.col("bin") * (F.first("hi") - F.first("lo")) / bins).alias("bin_left"))


def qq_points(pred: DataFrame, grid: int = 99) -> DataFrame:
    """Q-Q data on a fixed percentile grid: sample quantile vs normal quantile (exact selection)."""
    from ..functions import dist
    from ..functions.stats import global_quantiles
    e = pred.select((F.col("y_true") - F.col("y_pred")).cast("double").alias("e"))
    ps = [(k + 1) / (grid + 1) for k in range(grid)]
    q = global_quantiles(e, {f"p{k}": ("e", p) for k, p in enumerate(ps)})
    rows = [(float(p), float(dist.norm_ppf(p)), q[f"p{k}"]) for k, p in enumerate(ps)]
    return pred.sparkSession.createDataFrame(rows, "p double, theoretical double, sample double")


def residual_series(pred: DataFrame, keys=("username", "date")) -> DataFrame:
    """Residuals by fitted value and by date, standardised too: the scatter charts' points."""
    from ..functions.stats import attach_row
    e = F.col("y_true").cast("double") - F.col("y_pred").cast("double")
    scale = pred.agg(F.stddev_pop(e).alias("_s"))
    return attach_row(pred, scale).select(*keys, F.col("y_pred").cast("double").alias("fitted"), e.alias("residual"),
                                          F.try_divide(e, F.col("_s")).alias("standardized"))


def residual_sample(pred: DataFrame, per_band: int = 100, bands: int = 20, keys=("username", "date")) -> DataFrame:
    """At most ``per_band`` residuals from each of ``bands`` equal bands of the fitted value: a scatter chart's points.

    Of each band the rows whose key has the smallest digest: the same rows
    however the table is partitioned, and the best of parts are the best of the
    whole, so every task cuts its rows before the shuffle.  Rows without a
    fitted value have no place in the chart.
    """
    from ..functions.stats import attach_row
    rows = residual_series(pred, keys).where(F.col("fitted").isNotNull())
    ends = rows.agg(F.min("fitted").alias("_low"), F.max("fitted").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bands
    band = F.when(width > 0, F.least(F.floor((F.col("fitted") - F.col("_low")) / width), F.lit(bands - 1))).otherwise(0)
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    w = Window.partitionBy("band").orderBy("_digest", *keys)
    placed = attach_row(rows, ends).withColumn("band", band.cast("int")).withColumn("_digest", digest)
    return placed.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_band).select("band", *keys, "fitted", "residual", "standardized")


def qq_line(points: DataFrame) -> DataFrame:
    """Reference line of Q-Q points: least squares of sample on theoretical quantiles."""
    return points.agg(F.regr_slope("sample", "theoretical").alias("slope"), F.regr_intercept("sample", "theoretical").alias("intercept"))


def importance_bars(model, spark) -> DataFrame:
    """Bars of a model's coefficients, smallest magnitude first (position from 0), with the side of zero."""
    rows = sorted(zip(model.features, (float(w) for w in model.fit.coef)), key=lambda r: (abs(r[1]), r[0]))
    return spark.createDataFrame([(i, f, w, "positive" if w >= 0 else "negative") for i, (f, w) in enumerate(rows)],
                                 "position int, feature string, coefficient double, side string")


def interval_series(scored: DataFrame, date: str = "week_start", actual: str = "weekly_growth") -> DataFrame:
    """Prediction, interval and actual value by date, averaged over the accounts of a date: one point per date."""
    return scored.groupBy(date).agg(F.avg("y_pred").alias("prediction"), F.avg("lower_bound").alias("lower"), F.avg("upper_bound").alias("upper"),
                                    F.avg(actual).alias("actual"), F.count(F.lit(1)).alias("n_rows"))


# RP6 ------------------------------------------------------------------------
def roi_vs_frequency(weekly: DataFrame, x: str = "weekly_posting_frequency", y: str = "roi_follows_per_hour",
                     points: int = 100) -> DataFrame:
    """Degree-1 trend (regr_slope / regr_intercept) and its line on ``points`` x values."""
    fit = weekly.agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
                     F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
                     F.min(F.col(x).cast("double")).alias("x_min"), F.max(F.col(x).cast("double")).alias("x_max"))
    k = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    line = fit.select("*", k)
    xv = F.col("x_min") + F.col("k") * (F.col("x_max") - F.col("x_min")) / (points - 1)
    return line.select("k", xv.alias("x"), (F.col("intercept") + F.col("slope") * xv).alias("y_trend"),
                       "slope", "intercept")


# RP7 ------------------------------------------------------------------------
def content_mix_points(weekly: DataFrame) -> DataFrame:
    return weekly.select("username", "week_start", (F.col("share_posts") * 100).alias("posts_pct"),
                         (F.col("share_reels") * 100).alias("reels_pct"), (F.col("share_stories") * 100).alias("stories_pct"),
                         "weekly_growth")
