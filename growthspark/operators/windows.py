"""Row-neighbour operators over a creator's history (WN1-WN12, CL1, CL5, CL6).

Every window here is ``partitionBy(creator).orderBy(date)``: a global order
would be meaningless across creators and would funnel everything into one
partition.  After cleaning, (creator, date) is unique, so a creator's window
partition is bounded by the calendar (one row per day), not by data volume:
a creator cannot own a third of 100 TB of *daily* rows.  All windows of one
step share the same partitioning and ordering, so Spark sorts once per
creator and evaluates them in a single ``Window`` operator.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import exprs as X
from ..functions.spline import LEAST_POINTS, quadratic_spline


def creator_window(creator: str = "username", order: str = "date") -> Window:
    """Creator history in date order; missing dates last (as pandas sorts NaT)."""
    return Window.partitionBy(creator).orderBy(F.col(order).asc_nulls_last())


def trailing(n: int, creator: str = "username", order: str = "date") -> Window:
    return creator_window(creator, order).rowsBetween(-(n - 1), 0)


# WN1 ------------------------------------------------------------------------
_AGG = {
    "mean": F.avg,
    "sum": F.sum,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
}


def rolling_value(c, n: int, agg: str, creator="username", order="date") -> Column:
    """pandas ``rolling(n).agg()``: NULL until the window holds n non-missing values."""
    w = trailing(n, creator, order)
    c = X.col(c)
    return F.when(F.count(c).over(w) == n, _AGG[agg](c).over(w))


def rolling_aggregation(df: DataFrame, window: int, agg_functions: dict, creator="username",
                        order="date") -> DataFrame:
    """WN1: ``{col: agg}`` -> ``{col}_rolling_{window}d`` columns."""
    out = df
    for c, a in agg_functions.items():
        if c in df.columns and a in _AGG:
            out = out.withColumn(f"{c}_rolling_{window}d", rolling_value(c, window, a, creator, order))
    return out


def rolling_slope(c, n: int, creator="username", order="date") -> Column:
    """WN4: degree-1 fit over positions of the last n rows (NULL until full)."""
    w = trailing(n, creator, order)
    pos = F.row_number().over(creator_window(creator, order)).cast("double")
    return pos, (lambda pcol: F.when(F.count(X.col(c)).over(w) == n,
                                     F.regr_slope(X.col(c).cast("double"), pcol).over(w)))


def add_rolling_slope(df: DataFrame, c: str, n: int, out: str, creator="username",
                      order="date") -> DataFrame:
    pos, mk = rolling_slope(c, n, creator, order)
    return df.withColumn("_pos", pos).withColumn(out, mk(F.col("_pos"))).drop("_pos")


# WN2 ------------------------------------------------------------------------
_SUFFIX = {"mean": "avg", "std": "std", "sum": "sum"}


def add_daily_rolling_features(df: DataFrame, creator="username") -> DataFrame:
    """WN2: the ten 7-day rolling features of the daily pipeline."""
    out = df
    if "daily_posting_frequency" not in out.columns:
        out = out.withColumn("daily_posting_frequency", F.col("posts") + F.col("reels") + F.col("stories"))
    for c, aggs in C.DAILY_ROLLING_FEATURES:
        if c in out.columns:
            for a in aggs:
                out = out.withColumn(f"{c}_7d_{_SUFFIX[a]}", rolling_value(c, 7, a, creator))
    return out


# WN3 ------------------------------------------------------------------------
def add_growth_momentum(df: DataFrame, creator="username") -> DataFrame:
    w = creator_window(creator)
    return (df.withColumn("growth_momentum", rolling_value("growth", 3, "mean", creator))
              .withColumn("growth_acceleration", F.col("growth") - F.lag("growth").over(w)))


# WN5 / WN6 ------------------------------------------------------------------
def add_weekly_lags(df: DataFrame, creator="username", order="week_start") -> DataFrame:
    w = creator_window(creator, order)
    out = (df.withColumn("prev_week_growth", F.lag("weekly_growth").over(w))
             .withColumn("prev_week_posting", F.lag("weekly_posting_frequency").over(w))
             .withColumn("prev_week_engagement", F.lag("engagement_rate").over(w))
             .withColumn("growth_momentum_3w", rolling_value("weekly_growth", 3, "mean", creator, order)))
    return add_rolling_slope(out, "weekly_growth", 4, "performance_trend", creator, order)


# WN7 ------------------------------------------------------------------------
def consistency_variance_7d(posts="posts", creator="username", order="date") -> Column:
    """Population variance of posts over the last <= 7 rows; 0 with < 2 rows."""
    w = trailing(7, creator, order)
    return F.when(F.count(X.col(posts)).over(w) >= 2,
                  F.var_pop(X.col(posts).cast("double")).over(w)).otherwise(F.lit(0.0))


# WN8 / WN12 ------------------------------------------------------------------
def second_difference(c, creator="username", order="date") -> Column:
    """c[t] - 2 c[t-1] + c[t-2] (acceleration), NULL for the first two rows."""
    w = creator_window(creator, order)
    c = X.col(c)
    return c - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)


def step_change(c, creator="username", order="date") -> Column:
    w = creator_window(creator, order)
    return X.col(c) - F.lag(X.col(c)).over(w)


# WN9: the average descending rank of compared models is computed on the
# driver over the few model rows (models.compare_models); no table-wide rank.


# WN10 -----------------------------------------------------------------------
def position_columns(creator="username", order="date") -> dict[str, Column]:
    """0-based row position and row count per creator (for n//2, n//5 splits)."""
    w = creator_window(creator, order)
    return {"_pos": F.row_number().over(w) - 1,
            "_n": F.count(F.lit(1)).over(Window.partitionBy(creator))}


# CL1 ------------------------------------------------------------------------
def forward_fill(c, creator="username", order="date") -> Column:
    w = creator_window(creator, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(X.col(c), ignorenulls=True).over(w)


# CL5 / CL6 ------------------------------------------------------------------
def interpolate(df: DataFrame, c: str, method: str = "linear", creator="username",
                order="date") -> DataFrame:
    """pandas ``interpolate``: leading gaps stay, trailing gaps take the last value.

    ``linear`` weights by row position, ``time`` by day distance; for
    ``polynomial`` see :func:`interpolate_spline`.
    """
    if method == "polynomial":
        return interpolate_spline(df, c, creator, order)
    w = creator_window(creator, order)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    pos = (F.row_number().over(w) if method == "linear"
           else F.datediff(F.col(order), F.lit("1970-01-01").cast("date")) if method == "time"
           else None)
    if pos is None:
        raise ValueError(f"unknown interpolation method {method!r}: linear, time or polynomial")
    tmp = df.withColumn("_ip", pos.cast("double"))
    have = F.col(c).isNotNull()
    tmp = (tmp.withColumn("_pv", F.last(F.when(have, F.col(c)), True).over(before))
              .withColumn("_pp", F.last(F.when(have, F.col("_ip")), True).over(before))
              .withColumn("_nv", F.first(F.when(have, F.col(c)), True).over(after))
              .withColumn("_np", F.first(F.when(have, F.col("_ip")), True).over(after)))
    filled = (F.when(have, F.col(c))
              .when(F.col("_pv").isNull(), F.lit(None))
              .when(F.col("_nv").isNull(), F.col("_pv"))
              .otherwise(F.col("_pv") + (F.col("_nv") - F.col("_pv"))
                         * (F.col("_ip") - F.col("_pp")) / (F.col("_np") - F.col("_pp"))))
    return tmp.withColumn(c, filled.cast("double")).drop("_ip", "_pv", "_pp", "_nv", "_np")


def interpolate_spline(df: DataFrame, c: str, creator="username", order="date") -> DataFrame:
    """Gaps between known values from the quadratic spline through them, by row position.

    Leading and trailing gaps stay, and so do all gaps of a creator with fewer
    than three known values.  The spline couples all of a creator's days, so
    each creator's (order, value) series is one Arrow group: two numbers a day,
    bounded by the calendar.  The filled values are joined back.
    """
    rows = df.withColumn("_sp", F.row_number().over(creator_window(creator, order)))
    gaps = rows.select(F.col(creator).alias("creator"), "_sp", F.col(c).cast("double").alias("v"))

    def fill(table):
        table = table.sort_by("_sp")
        at, v = table.column("_sp").to_numpy(), table.column("v").to_numpy()
        known = ~np.isnan(v)
        if known.sum() >= LEAST_POINTS:
            value = quadratic_spline(at[known], v[known], at[~known])
        else:
            value = np.full((~known).sum(), np.nan)
        keep = ~np.isnan(value)
        gap = table.filter(pa.array(~known)).filter(pa.array(keep))
        return pa.table({"creator": gap.column("creator"), "_sp": gap.column("_sp"), "_new": value[keep]})

    kind = T.StructType([T.StructField("creator", df.schema[creator].dataType), T.StructField("_sp", T.IntegerType()), T.StructField("_new", T.DoubleType())])
    found = gaps.groupBy("creator").applyInArrow(fill, kind)
    same = rows[creator].eqNullSafe(found["creator"]) & (rows["_sp"] == found["_sp"])
    return rows.join(found, same, "left").select(
        *[F.coalesce(rows[c].cast("double"), found["_new"]).alias(c) if name == c else rows[name] for name in df.columns])


def derive_daily_columns(df: DataFrame, creator="username") -> DataFrame:
    """Generator-derived daily columns (FN18-FN23, WN7, month, quarter) where absent."""
    cols = set(df.columns)
    out = df
    if "minutes_spent" not in cols:
        out = out.withColumn("minutes_spent", X.time_cost_minutes())
    if "roi_follows_per_hour" not in cols and "follows" in cols:
        out = out.withColumn("roi_follows_per_hour", X.roi_follows_per_hour())
    if "posted_in_optimal_window" not in cols and "post_time" in cols:
        out = out.withColumn("posted_in_optimal_window", X.optimal_window_flag("post_time"))
    for k, v in X.content_share_columns().items():
        if k not in cols:
            out = out.withColumn(k, v)
    if "saturation_flag" not in cols and "engagement_rate" in cols:
        out = out.withColumn("saturation_flag", X.saturation_flag())
    if "post_consistency_variance_7d" not in cols:
        out = out.withColumn("post_consistency_variance_7d", consistency_variance_7d("posts", creator))
    if "month" not in cols:
        out = out.withColumn("month", F.month("date"))
    if "quarter" not in cols:
        out = out.withColumn("quarter", F.quarter("date"))
    return out
