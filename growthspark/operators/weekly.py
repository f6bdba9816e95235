"""Weekly aggregation (AG1, AG2, JN1, JN2) and weekly features (FE1-FE3).

Scale notes
-----------
* One ``groupBy(username, week_start)`` computes the weekly sums, means, last
  follower count, modal post time *and* the posting-consistency columns.  All
  of them are partial aggregates (map-side combine), so a hot creator-week is
  combined before the shuffle; the consistency part needs no window: the set
  of active weekdays is a 7-bit mask (``bit_or``) from which the largest gap is
  a pure expression.  JN1 (the positional concat in the reference) and JN2
  (day -> week range match) therefore disappear: both are this one aggregate.
* Where days arrive over time (a stream), the same rows come from partials by
  creator, week and post time, which add up in any order.
* The ROI-score normalisers are maxima over ``scope``: for the whole table a
  one-row aggregate whose values are inlined as literals (no join);
  per creator a window max partitioned by creator (bounded by weeks/creator).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..functions.stats import attach_scalars, attach_scope_stats
from ..session import write_once


def add_week_columns(df: DataFrame, date_col: str = "date") -> DataFrame:
    """FN4 on a frame: week_start (Monday) and week_end (Sunday)."""
    return (df.withColumn("week_start", X.week_start(date_col))
              .withColumn("week_end", F.date_add(F.col("week_start"), 6)))


def _gap_from_mask(mask: F.Column) -> F.Column:
    """Largest distance between consecutive active weekdays in a 7-bit mask."""
    pos = F.filter(F.sequence(F.lit(0), F.lit(6)),
                   lambda i: mask.bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0)
    n = F.size(pos)
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                       lambda j: F.element_at(pos, j + 1) - F.element_at(pos, j))
    return F.when(n > 1, F.array_max(gaps)).otherwise(F.lit(7))


def create_weekly_features(daily: DataFrame, growth_from: str = "sum",
                           with_consistency: bool = True,
                           creator_col: str = "username") -> DataFrame:
    """AG1 (+AG2): one row per creator and Monday week.

    ``growth_from='sum'`` (reference code) sums daily growth;
    ``'followers_diff'`` (reference documentation) takes the change of the
    end-of-week follower count against the previous week.
    """
    cols = set(daily.columns)
    d = daily.withColumn("week_start", X.week_start("date"))
    aggs = []
    for c in C.WEEKLY_SUM_COLUMNS:
        if c in cols:
            aggs.append(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c))
    for c in C.WEEKLY_MEAN_COLUMNS:
        if c in cols:
            aggs.append(F.avg(c).alias(c))
    if "followers" in cols:
        # T7: pandas 'last' skips missing values
        aggs.append(F.max_by("followers", F.when(F.col("followers").isNotNull(), F.col("date")))
                    .alias("followers"))
    if "post_time" in cols:
        aggs.append(F.mode("post_time", True).alias("post_time"))
    if with_consistency:
        total = F.col("posts") + F.col("reels") + F.col("stories")
        active = total > 0
        aggs += [
            F.var_samp(total).alias("posting_consistency_variance"),
            F.sum(F.when(active, 1).otherwise(0)).cast("long").alias("posting_consistency_days"),
            F.bit_or(F.when(active, F.pow(F.lit(2), F.weekday("date")).cast("int")).otherwise(0))
             .alias("_active_mask"),
        ]
    w = d.groupBy(creator_col, "week_start").agg(*aggs)
    return _derived_week_columns(w, growth_from, with_consistency, creator_col)


def _derived_week_columns(w: DataFrame, growth_from: str, with_consistency: bool, creator_col: str) -> DataFrame:
    """Week end, frequency, growth and regularity from the week's aggregates."""
    w = w.withColumn("week_end", F.date_add("week_start", 6))
    w = w.withColumn("weekly_posting_frequency", F.col("posts") + F.col("reels") + F.col("stories"))
    if growth_from == "followers_diff":
        prev = F.lag("followers").over(Window.partitionBy(creator_col).orderBy("week_start"))
        w = w.withColumn("weekly_growth", (F.col("followers") - prev).cast("long"))
    else:
        w = w.withColumn("weekly_growth", F.col("growth"))
    if with_consistency:
        gap = _gap_from_mask(F.col("_active_mask"))
        w = (w.withColumn("max_gap_days", gap.cast("int"))
              .withColumn("posting_regularity_score",
                          F.col("posting_consistency_days") / 7.0
                          * (1 - F.least(F.col("max_gap_days") / 7.0, F.lit(1.0))))
              .drop("_active_mask"))
    return w


# AG1 in two levels ------------------------------------------------------------
def weekly_partials(daily: DataFrame, creator_col: str = "username") -> DataFrame:
    """What AG1 needs of some of a creator-week's days, by post time: one row per creator, week and post time.

    Partials of different days add up (:func:`merge_partials`), whatever the
    order they come in; :func:`finish_weekly` makes AG1's rows of them.
    """
    cols = set(daily.columns)
    total = F.col("posts") + F.col("reels") + F.col("stories")
    aggs = [F.count(F.lit(1)).alias("n_days")]
    aggs += [F.sum(c).cast("long").alias(c) for c in C.WEEKLY_SUM_COLUMNS if c in cols]
    for c in C.WEEKLY_MEAN_COLUMNS:
        if c in cols:
            aggs += [F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n")]
    if "followers" in cols:
        seen = F.when(F.col("followers").isNotNull(), F.col("date"))
        aggs += [F.max(seen).alias("followers_date"), F.max_by("followers", seen).alias("followers")]
    aggs += [F.count(total).alias("total_n"), F.sum(total).cast("long").alias("total_sum"), F.sum(total * total).cast("long").alias("total_squares"),
             F.sum(F.when(total > 0, 1).otherwise(0)).cast("long").alias("active_days"),
             F.bit_or(F.when(total > 0, F.pow(F.lit(2), F.weekday("date")).cast("int")).otherwise(0)).alias("active_mask")]
    d = daily.withColumn("week_start", X.week_start("date"))
    return d.groupBy(creator_col, "week_start", *(["post_time"] if "post_time" in cols else [])).agg(*aggs)


def _merged(partials: DataFrame, keys: list) -> list:
    """The merging aggregate of every column of ``partials`` that is neither a key nor the post time."""
    out = []
    for c in partials.columns:
        if c in keys or c == "post_time":
            continue
        how = (F.bit_or(c) if c == "active_mask" else F.max(c) if c == "followers_date"
               else F.max_by(c, "followers_date") if c == "followers" else F.sum(c))
        out.append(how.alias(c))
    return out


def merge_partials(partials: DataFrame, creator_col: str = "username") -> DataFrame:
    """Partials of the same creator, week and post time in one row."""
    keys = [creator_col, "week_start", *(["post_time"] if "post_time" in partials.columns else [])]
    return partials.groupBy(*keys).agg(*_merged(partials, keys))


def finish_weekly(partials: DataFrame, growth_from: str = "sum", creator_col: str = "username") -> DataFrame:
    """AG1's rows from all partials of the weeks: those of :func:`create_weekly_features` on the days.

    The modal post time is the one of most days, the smallest of equals.
    """
    # both levels group within a creator: one shuffle
    merged = merge_partials(partials.repartition(creator_col), creator_col)
    keys = [creator_col, "week_start"]
    aggs = _merged(merged, keys)
    if "post_time" in merged.columns:  # missing post times do not vote
        vote = F.when(F.col("post_time").isNotNull(), F.struct((-F.col("n_days")).alias("n"), "post_time"))
        aggs.append(F.min(vote)["post_time"].alias("post_time"))
    w = merged.groupBy(*keys).agg(*aggs)
    n, s1, s2 = (F.col(c).cast("double") for c in ("total_n", "total_sum", "total_squares"))
    out = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in C.WEEKLY_SUM_COLUMNS if c in w.columns]
    out += [F.try_divide(F.col(f"{c}_sum"), F.col(f"{c}_n")).alias(c) for c in C.WEEKLY_MEAN_COLUMNS if f"{c}_n" in w.columns]
    out += [F.col(c) for c in ("followers", "post_time") if c in w.columns]
    out += [F.when(n > 1, F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / (n - 1)).alias("posting_consistency_variance"),
            F.col("active_days").alias("posting_consistency_days"), F.col("active_mask").alias("_active_mask")]
    return _derived_week_columns(w.select(*keys, *out), growth_from, True, creator_col)


def add_content_mix_features(df: DataFrame) -> DataFrame:
    """FE1: total, three shares, entropy diversity, dominant type, reels focus."""
    total = F.col("posts") + F.col("reels") + F.col("stories")
    out = df.withColumn("total_content", total)
    for k, v in X.content_share_columns().items():
        out = out.withColumn(k, v)
    return (out.withColumn("content_diversity", X.share_entropy(C.SHARE_COLUMNS))
               .withColumn("dominant_content_type",
                           X.row_argmax(C.SHARE_COLUMNS, ["posts", "reels", "stories"]))
               .withColumn("reels_focused", (F.col("share_reels") > 0.5).cast("int")))


def add_roi_features(df: DataFrame, scope=(), freq_col: str = "weekly_posting_frequency", eager: bool = True) -> DataFrame:
    """FE2 + FE3: efficiency ratios and the max-normalised ROI score."""
    eng = F.col("post_likes") + F.col("comments") + F.col("saves") + F.col("shares")
    out = (df.withColumn("follows_per_minute", X.safe_divide("follows", "minutes_spent"))
             .withColumn("engagement_per_minute", X.safe_divide(eng, F.col("minutes_spent")))
             .withColumn("follows_per_post", X.safe_divide("follows", freq_col))
             .withColumn("engagement_per_post", X.safe_divide(eng, F.col(freq_col)))
             .withColumn("reach_per_post", X.safe_divide("reach", freq_col))
             .withColumn("reach_efficiency", X.safe_divide("follows", "reach"))
             .withColumn("profile_visit_conversion", X.safe_divide("follows", "profile_visits")))
    return add_roi_score(out, scope, eager)


def add_roi_score(df: DataFrame, scope=(), eager: bool = True) -> DataFrame:
    """FE3: .4 roi/max + .3 follows_per_post/max + .3 reach_eff/max; missing -> 0.

    Without a scope the maxima are a job on the frame, or with ``eager`` off a part of the plan."""
    w1, w2, w3 = C.ROI_SCORE_WEIGHTS
    stats = {"_mx_roi": F.max("roi_follows_per_hour"), "_mx_fpp": F.max("follows_per_post"),
             "_mx_re": F.max("reach_efficiency")}
    if scope or eager:
        out = attach_scope_stats(df, stats, scope)
    else:
        out = attach_scalars(df, df.agg(*[e.alias(n) for n, e in stats.items()]))
    score = (w1 * F.try_divide(F.col("roi_follows_per_hour"), F.col("_mx_roi"))
             + w2 * F.try_divide(F.col("follows_per_post"), F.col("_mx_fpp"))
             + w3 * F.try_divide(F.col("reach_efficiency"), F.col("_mx_re")))
    return out.withColumn("roi_score", F.coalesce(X.null_if_nan(score), F.lit(0.0))).drop(
        "_mx_roi", "_mx_fpp", "_mx_re")


def weekly_feature_table(daily: DataFrame, scope=(), checkpoint: bool = True) -> DataFrame:
    """AG1 + AG2 + FE1 + FE2 + FE3: the reference's weekly frame.

    With whole-table scope the ROI maxima are a statistics job over the weekly
    table; ``checkpoint`` writes the weekly table once to the shared
    checkpoint folder first, so that job and every later pass read it instead
    of repeating the daily -> weekly shuffle.  Without ``checkpoint`` nothing
    runs here, and a caller that selects some columns gets only their work;
    one that reads the ROI score pays for the weekly table twice.
    """
    w = add_content_mix_features(create_weekly_features(daily))
    if checkpoint and not scope:
        w = write_once(w)
    return add_roi_features(w, scope, eager=checkpoint)


# DQ12: what the full processed table has beside the weekly features -----------
def add_processed_columns(weekly: DataFrame, daily: DataFrame, creator: str = "username") -> DataFrame:
    """Adds the week's ``engagement_rate_smoothed`` and ``posted_in_optimal_window``.

    The rate is smoothed per creator over three days in date order (fewer at
    the start) and averaged over the week; the other is the share of the week's
    days posted in an optimal window.  One row per creator-week is joined.
    """
    last = Window.partitionBy(creator).orderBy(F.col("date").asc_nulls_last()).rowsBetween(1 - C.ENGAGEMENT_SMOOTHING_DAYS, 0)
    d = daily.select(creator, X.week_start("date").alias("week_start"), F.avg("engagement_rate").over(last).alias("smoothed"),
                     X.optimal_window_flag("post_time").alias("optimal"))
    extra = d.groupBy(creator, "week_start").agg(F.avg("smoothed").alias("engagement_rate_smoothed"), F.avg("optimal").alias("posted_in_optimal_window"))
    return weekly.join(extra, [creator, "week_start"], "left")
