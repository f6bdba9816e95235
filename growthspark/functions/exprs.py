"""Row-local Column expressions (FN1-FN24 and friends).

All functions here take and return ``Column`` objects, use only built-in
Spark functions (JVM side, inside whole-stage codegen) and contain no window
or action, so the same code runs on a batch ``DataFrame`` and on a
``readStream``.

Conventions
-----------
* NULL, never NaN, marks a missing value (ingest turns NaN into NULL).
* Divisions never raise under ANSI mode: ``try_divide`` or a guard.
* Rounding for parity with numpy uses ``rint`` on scaled doubles (half to even).
* Output column names, date formats and suffix thresholds are fixed values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# FN1 ------------------------------------------------------------------------
def safe_divide(n, d, default: float = 0.0) -> Column:
    """n / d, ``default`` where d == 0; NULL in either side stays NULL."""
    n, d = col(n), col(d)
    return (F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
            .when(d != 0, F.try_divide(n.cast("double"), d.cast("double")))
            .otherwise(F.lit(float(default))))


# FN2 ------------------------------------------------------------------------
def pct_change(old, new) -> Column:
    """(new - old) / |old| * 100; old == 0 gives 0 if new == 0 else +inf."""
    old, new = col(old).cast("double"), col(new).cast("double")
    return (F.when(old == 0, F.when(new == 0, F.lit(0.0)).otherwise(F.lit(float("inf"))))
            .otherwise((new - old) / F.abs(old) * 100.0))


# FN3 ------------------------------------------------------------------------
# FIXED VALUES: accepted date formats, tried in this order
DATE_FORMATS = [
    "yyyy-M-d",
    "d-M-yyyy",
    "M/d/yyyy",
    "d/M/yyyy",
    "yyyy-M-d H:m:s",
    "d-M-yyyy H:m:s",
]


def parse_date_string(s, formats=None) -> Column:
    """First format that parses (as timestamp); NULL if none does."""
    s = F.trim(col(s))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in (formats or DATE_FORMATS)])


def parse_raw_date(s) -> Column:
    """``dd-mm-yyyy`` text of the raw file; bad text becomes NULL (T9: d-M-yyyy)."""
    return F.to_date(F.try_to_timestamp(F.trim(col(s)), F.lit("d-M-yyyy")))


# FN4 ------------------------------------------------------------------------
def week_start(d) -> Column:
    """Monday of the week of ``d``."""
    d = col(d).cast("date")
    return F.date_sub(d, F.weekday(d))


def week_end(d) -> Column:
    return F.date_add(week_start(d), 6)


# FN5 ------------------------------------------------------------------------
def date_feature_columns(d) -> dict[str, Column]:
    """year, month, quarter, ISO week, day of week (Mon=0), day of month, flags."""
    d = col(d).cast("date")
    dow = F.weekday(d)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "week_of_year": F.weekofyear(d),
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(d),
        "is_weekend": dow.isin(5, 6).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
    }


# FN6 ------------------------------------------------------------------------
def format_large_number(v, precision: int = 1) -> Column:
    """1.2K / 3.4M / 5.6B text; below 1000 the plain value with ``precision``."""
    v = col(v).cast("double")
    a = F.abs(v)

    def fmt(x, suffix):
        # format_number rounds half-even on the exact binary value, as Python does
        txt = F.regexp_replace(F.format_number(x, precision), ",", "")
        return F.concat(txt, F.lit(suffix))

    return (F.when(v.isNull() | F.isnan(v), F.lit(None).cast("string"))
            .when(v == float("inf"), F.lit("infB"))
            .when(v == float("-inf"), F.lit("-infB"))
            .when(a >= 1e9, fmt(v / 1e9, "B"))
            .when(a >= 1e6, fmt(v / 1e6, "M"))
            .when(a >= 1e3, fmt(v / 1e3, "K"))
            .otherwise(fmt(v, "")))


# FN7 ------------------------------------------------------------------------
def coerce_int(c) -> Column:
    """Numeric parse of text/float; failures -> 0; fractional parts truncate."""
    return F.coalesce(col(c).cast("string").try_cast("double").try_cast("long"),
                      F.lit(0).cast("long"))


def coerce_float(c) -> Column:
    """Numeric parse; failures -> NULL; NaN -> NULL."""
    v = col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(v), v)


# FN8 ------------------------------------------------------------------------
def clip(c, lo=None, hi=None) -> Column:
    """Two-sided cap that keeps NULL (T4: least/greatest skip NULL)."""
    c = col(c)
    out = c
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    return F.when(c.isNotNull(), out)


# FN9 ------------------------------------------------------------------------
def cut(c, bins, labels) -> Column:
    """Right-closed bins (b0, b1], ...; values at or below b0 are NULL."""
    c = col(c)
    expr = None
    for (lo, hi), lab in zip(zip(bins[:-1], bins[1:]), labels):
        cond = (c > F.lit(lo))
        if not math.isinf(hi):
            cond = cond & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


# FN10 -----------------------------------------------------------------------
def row_argmax(cols: list[str], names: list[str] | None = None) -> Column:
    """Name of the largest value across columns; ties -> first listed."""
    names = names or cols
    arr = F.array(*[col(c).cast("double") for c in cols])
    pos = F.array_position(arr, F.array_max(arr))
    return F.when(pos > 0, F.element_at(F.array(*[F.lit(n) for n in names]), pos.cast("int")))


# FN11 -----------------------------------------------------------------------
def share_entropy(shares: list) -> Column:
    """Normalised Shannon entropy of the non-zero shares; <= 1 non-zero -> 0."""
    cs = [col(s).cast("double") for s in shares]
    k = sum(F.when(c > 0, 1).otherwise(0) for c in cs)
    h = sum(F.when(c > 0, -c * F.ln(c)).otherwise(0.0) for c in cs)
    return F.when(k <= 1, F.lit(0.0)).otherwise(h / F.ln(k.cast("double")))


# FN12 -----------------------------------------------------------------------
def cyclic(c, period: float):
    """(sin, cos) of 2*pi*c/period."""
    a = 2 * math.pi * col(c).cast("double") / period
    return F.sin(a), F.cos(a)


# FN13 -----------------------------------------------------------------------
def calendar_flag_columns(day_of_month, month) -> dict[str, Column]:
    dom, m = col(day_of_month), col(month)
    return {
        "is_beginning_of_month": (dom <= 7).cast("int"),
        "is_end_of_month": (dom >= 24).cast("int"),
        "is_holiday_season": m.isin(*C.HOLIDAY_MONTHS).cast("int"),
        "is_summer": m.isin(*C.SUMMER_MONTHS).cast("int"),
        "is_back_to_school": m.isin(*C.BACK_TO_SCHOOL_MONTHS).cast("int"),
    }


# FN14 -----------------------------------------------------------------------
def standardize_time(c) -> Column:
    """NULL or no ':' -> 12:00, else first five characters."""
    c = col(c).cast("string")
    return (F.when(c.isNull(), F.lit(C.DEFAULT_POST_TIME))
            .when(c.contains(":"), F.substring(c, 1, 5))
            .otherwise(F.lit(C.DEFAULT_POST_TIME)))


# FN15 -----------------------------------------------------------------------
def log1p(c) -> Column:
    return F.log1p(col(c).cast("double"))


# FN16 -----------------------------------------------------------------------
def round_half_even(c, scale: int = 6) -> Column:
    """numpy ``round``: rint(x * 10^s) / 10^s in binary doubles (2.0196875 -> 2.019687).

    Spark's ``bround`` rounds the decimal string instead and can differ.
    """
    f = float(10 ** scale)
    return F.rint(col(c).cast("double") * f) / f


def round_to_long(c) -> Column:
    return F.rint(col(c).cast("double")).cast("long")


# FN17 -----------------------------------------------------------------------
def finite_or_null(c) -> Column:
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (c != float("inf")) & (c != float("-inf")), c)


# FN18 -----------------------------------------------------------------------
def optimal_window_flag(post_time) -> Column:
    return F.coalesce(col(post_time).isin(*C.OPTIMAL_POST_TIMES), F.lit(False)).cast("int")


# FN19 -----------------------------------------------------------------------
def time_cost_minutes(posts="posts", reels="reels", stories="stories") -> Column:
    w = dict(C.MINUTES_PER_CONTENT)
    return (col(posts) * w["posts"] + col(reels) * w["reels"] + col(stories) * w["stories"]).cast("long")


# FN20 -----------------------------------------------------------------------
def roi_follows_per_hour(follows="follows", minutes="minutes_spent") -> Column:
    """follows / hours, one hour assumed when no time was spent."""
    m = col(minutes).cast("double")
    hours = F.when(m > 0, m / 60.0).otherwise(F.lit(1.0))
    return col(follows).cast("double") / hours


# FN21 -----------------------------------------------------------------------
def saturation_flag(posts="posts", reels="reels", rate="engagement_rate") -> Column:
    return ((col(posts) + col(reels) >= C.SATURATION_MIN_CONTENT)
            & (col(rate) < C.SATURATION_MAX_RATE)).cast("int")


# FN22 -----------------------------------------------------------------------
def engagement_rate(likes="post_likes", reel_eng="reel_engagement", story_eng="story_engagement",
                    saves="saves", shares="shares", comments="comments", reach="reach") -> Column:
    total = (col(likes) + col(reel_eng) + col(story_eng) + col(saves) + col(shares) + col(comments))
    return total.cast("double") / F.greatest(col(reach), F.lit(1)).cast("double")


# FN23 -----------------------------------------------------------------------
def content_share_columns(posts="posts", reels="reels", stories="stories") -> dict[str, Column]:
    total = col(posts) + col(reels) + col(stories)
    return {
        "share_posts": safe_divide(posts, total),
        "share_reels": safe_divide(reels, total),
        "share_stories": safe_divide(stories, total),
    }


def avg_hashtags(hashtags="hashtags_used", posts="posts") -> Column:
    return safe_divide(hashtags, posts)


# SC3 ------------------------------------------------------------------------
def growth_category(pred) -> Column:
    p = col(pred)
    expr = None
    for cut_at, label in C.GROWTH_CATEGORIES:
        expr = F.when(p >= cut_at, label) if expr is None else expr.when(p >= cut_at, label)
    return F.when(p.isNotNull(), expr.otherwise(C.GROWTH_CATEGORY_FLOOR))


def null_if_nan(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)
