"""Registered queries: cleaning CL1-CL22 on the damaged fixture F3."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import clean as CL
from ..operators import windows as WN
from ..sources import fixtures as FX
from ..sources.fixtures import F3_COLUMNS
from . import sql_clean as S
from .registry import register
from .sqlparts import clip_sql, q, sdiv

F3_DOUBLES = tuple(c for c in F3_COLUMNS if c in C.FLOAT_COLUMNS)
OUT_DOUBLES = tuple(sorted(set(F3_DOUBLES) | set(S.F3_OUTLIER)))


def typed(spark, sf):
    return CL.fix_data_types(FX.daily_dirty(spark, sf))[0]


def chain(*ctes):
    return ",\n".join([S.typed(), *ctes])


@register("cl1", sql=q("SELECT username, date, seq, last_value(followers IGNORE NULLS) OVER (PARTITION BY username "
                       "ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS followers_filled "
                       "FROM c1k", "f3", extra=chain(S.dedup("f3t", "c1k"))))
def cl1(spark, sf):
    """CL1 forward fill of followers per creator in date order, on unique creator-days."""
    d = CL.dedup_keys(typed(spark, sf))
    return d.select("username", "date", "seq", WN.forward_fill("followers").alias("followers_filled"))


def damaged(spark, sf):
    """Stand-in: typed F3 with the creator of every 59th original row's day blanked out as well."""
    d = typed(spark, sf)
    lost = F.pmod(F.datediff("date", F.lit("1995-01-01").cast("date")), F.lit(59)) == 0
    return d.withColumn("username", F.when(F.coalesce(lost, F.lit(False)), F.lit(None)).otherwise(F.col("username")))


DAMAGED_CTE = ("f3x AS (SELECT * REPLACE (CASE WHEN COALESCE(CAST(date - DATE '1995-01-01' AS BIGINT) % 59 = 0, FALSE) THEN NULL "
               "ELSE username END AS username) FROM f3t)")


@register("cl22q", sql=q("SELECT username, date, seq, concat_ws(', ', CASE WHEN username IS NULL THEN 'missing username' END, "
                         "CASE WHEN date IS NULL THEN 'missing date' END) AS reason FROM f3x WHERE username IS NULL OR date IS NULL",
                         "f3", extra=chain(DAMAGED_CTE)))
def cl22q(spark, sf):
    """CL22 quarantine: rows without creator or date, with the reason."""
    return CL.quarantine(damaged(spark, sf))[1].select("username", "date", "seq", "reason")


@register("cl22k", sql=q("SELECT username, date, seq, followers FROM k8", "f3",
                         extra=chain(DAMAGED_CTE, S.dedup("f3x", "k8k"), S.missing("k8k", "k8"))))
def cl22k(spark, sf):
    """CL8 on damaged creators and dates: one row per complete creator-day, followers filled per creator only."""
    d = CL.handle_missing_values(CL.dedup_keys(damaged(spark, sf)))
    return d.select("username", "date", "seq", "followers")


@register("cl2", sql=q("SELECT username, date, seq, COALESCE(posts, 0) AS posts, COALESCE(reels, 0) AS reels, "
                       "COALESCE(growth, 0) AS growth FROM f3t", "f3", extra=chain()))
def cl2(spark, sf):
    """CL2 zero fill of count columns."""
    d = typed(spark, sf).fillna(0, subset=[c for c in C.ZERO_FILL_COLUMNS if c in F3_COLUMNS])
    return d.select("username", "date", "seq", "posts", "reels", "growth")


@register("cl3", doubles=("engagement_rate", "avg_hashtag_count"),
          sql=q("SELECT username, date, seq, COALESCE(engagement_rate, AVG(engagement_rate) OVER ()) AS engagement_rate, "
                "COALESCE(avg_hashtag_count, AVG(avg_hashtag_count) OVER ()) AS avg_hashtag_count FROM f3t", "f3", extra=chain()))
def cl3(spark, sf):
    """CL3 mean fill of rate columns (whole-table means inlined as literals)."""
    from ..functions.stats import attach_scope_stats
    d = typed(spark, sf)
    d = attach_scope_stats(d, {"_m1": F.avg("engagement_rate"), "_m2": F.avg("avg_hashtag_count")})
    return d.select("username", "date", "seq", F.coalesce("engagement_rate", "_m1").alias("engagement_rate"),
                    F.coalesce("avg_hashtag_count", "_m2").alias("avg_hashtag_count"))


@register("cl4", sql=q("SELECT username, date, seq, COALESCE(post_time, (SELECT post_time FROM (SELECT post_time, "
                       "COUNT(*) AS k FROM f3t WHERE post_time IS NOT NULL GROUP BY post_time) m ORDER BY k DESC, "
                       "post_time LIMIT 1)) AS post_time FROM f3t", "f3", extra=chain()))
def cl4(spark, sf):
    """CL4 mode fill of post_time (smallest most frequent, two-stage aggregate)."""
    d = CL.fill_mode(typed(spark, sf), ["post_time"])
    return d.select("username", "date", "seq", "post_time")


def _gappy_sql():
    return ("gp AS (SELECT username, date, CASE WHEN (CAST(date - DATE '1995-01-01' AS BIGINT) + CAST(regexp_extract("
            "username, '(\\d+)$', 1) AS BIGINT)) % 3 = 0 THEN NULL ELSE v END AS v FROM (SELECT username, date, "
            "CASE WHEN COUNT(posts) OVER w >= 2 THEN VAR_POP(posts) OVER w ELSE 0.0 END AS v FROM f1 WINDOW w AS "
            "(PARTITION BY username ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) a)")


def _gappy(spark, sf):
    """Stand-in: WN7 variance of F1 with every third key blanked out."""
    d = FX.daily_metrics(spark, sf)
    h = F.datediff("date", F.lit("1995-01-01").cast("date")) + F.regexp_extract("username", r"(\d+)$", 1).cast("long")
    v = WN.consistency_variance_7d()
    return d.select("username", "date", F.when(F.pmod(h, F.lit(3)) == 0, F.lit(None)).otherwise(v).alias("v"))


def _interp_sql(pos):
    return (f"SELECT username, date, CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv "
            f"ELSE pv + (nv - pv) * (p - pp) / (np - pp) END AS v FROM (SELECT *, "
            f"last_value(v IGNORE NULLS) OVER wb AS pv, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER wb AS pp, "
            f"first_value(v IGNORE NULLS) OVER wa AS nv, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER wa AS np "
            f"FROM (SELECT *, CAST({pos} AS DOUBLE) AS p FROM gp) a WINDOW wb AS (PARTITION BY username ORDER BY date "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), wa AS (PARTITION BY username ORDER BY date ROWS BETWEEN "
            f"CURRENT ROW AND UNBOUNDED FOLLOWING)) b")


@register("cl5", doubles=("v",),
          sql=q(_interp_sql("ROW_NUMBER() OVER (PARTITION BY username ORDER BY date)"), "f1", extra=_gappy_sql()))
def cl5(spark, sf):
    """CL5 linear (positional) interpolation; leading gaps stay, trailing take the last value."""
    return WN.interpolate(_gappy(spark, sf), "v", "linear")


@register("cl6", doubles=("v",), sql=q(_interp_sql("date - DATE '1970-01-01'"), "f1", extra=_gappy_sql()))
def cl6(spark, sf):
    """CL6 time-weighted interpolation (by day distance)."""
    return WN.interpolate(_gappy(spark, sf), "v", "time")


# breakpoints, the spline's tridiagonal system by forward elimination and back substitution, and its value in each gap
SPLINE_SQL = """p0 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY username ORDER BY date) AS p FROM gp),
k AS (SELECT username, CAST(p AS DOUBLE) AS x, v AS y, ROW_NUMBER() OVER (PARTITION BY username ORDER BY p) - 1 AS i,
  COUNT(*) OVER (PARTITION BY username) AS n FROM p0 WHERE v IS NOT NULL),
z AS (SELECT username, n, i AS s, CASE WHEN i = 0 THEN x WHEN i = n - 2 THEN nx ELSE (x + nx) / 2 END AS z
  FROM (SELECT *, LEAD(x) OVER (PARTITION BY username ORDER BY i) AS nx FROM k) a WHERE i <= n - 2 AND n >= 3),
sp AS (SELECT * FROM (SELECT username, n, s, COALESCE(LAG(z) OVER w, z) AS zl, z AS za, LEAD(z) OVER w AS zb,
  COALESCE(LEAD(z, 2) OVER w, LEAD(z) OVER w) AS zr FROM z WINDOW w AS (PARTITION BY username ORDER BY s)) a WHERE zb IS NOT NULL),
r AS (SELECT k.username, i, k.n, y, COALESCE((zb - x) * (zb - x) / ((zb - zl) * (zb - za)), 0.0) AS a,
  COALESCE((x - za) * (x - za) / ((zr - za) * (zb - za)), 0.0) AS c
  FROM k LEFT JOIN sp ON sp.username = k.username AND sp.s = i - 1 AND i < k.n - 1 WHERE k.n >= 3),
f AS (SELECT username, i, CAST(0.0 AS DOUBLE) AS g, y AS d FROM r WHERE i = 0 UNION ALL
  SELECT r.username, r.i, c / (1 - a - c - a * g), (y - a * d) / (1 - a - c - a * g) FROM f JOIN r ON r.username = f.username AND r.i = f.i + 1),
h AS (SELECT f.username, f.i, f.d AS w FROM f JOIN r ON r.username = f.username AND r.i = f.i AND r.i = r.n - 1 UNION ALL
  SELECT f.username, f.i, f.d - f.g * h.w FROM h JOIN f ON f.username = h.username AND f.i = h.i - 1),
e AS (SELECT p0.username, p, (zb - p) * (zb - p) / ((zb - zl) * (zb - za)) AS a, (p - za) * (p - za) / ((zr - za) * (zb - za)) AS c, s
  FROM p0 JOIN sp ON sp.username = p0.username AND p0.v IS NULL AND p >= za AND (p < zb OR (p = zb AND s = n - 3))),
o AS (SELECT e.username, p, a * h0.w + (1 - a - c) * h1.w + c * h2.w AS v FROM e JOIN h h0 ON h0.username = e.username AND h0.i = s
  JOIN h h1 ON h1.username = e.username AND h1.i = s + 1 JOIN h h2 ON h2.username = e.username AND h2.i = s + 2)"""


@register("cl6p", doubles=("v",), sql=q("SELECT p0.username, date, COALESCE(p0.v, o.v) AS v FROM p0 LEFT JOIN o USING (username, p)",
                                        "f1", recursive=True, extra=_gappy_sql() + ",\n" + SPLINE_SQL))
def cl6p(spark, sf):
    """CL6 polynomial(2): gaps from each creator's quadratic spline; outer gaps stay."""
    return WN.interpolate(_gappy(spark, sf), "v", "polynomial")


@register("cl8", doubles=F3_DOUBLES, sql=q("SELECT * FROM c8", "f3",
                                            extra=chain(S.dedup("f3t", "c8k"), S.missing("c8k", "c8"))))
def cl8(spark, sf):
    """CL8 handle_missing_values (CL1-CL5, CL7) on typed, key-deduplicated F3."""
    return CL.handle_missing_values(CL.dedup_keys(typed(spark, sf)))


@register("cl7", sql=q("SELECT COUNT(*) AS rows_with_null FROM c8 WHERE " +
                       " OR ".join(f"{c} IS NULL" for c in S.F3_NUMERIC), "f3",
                       extra=chain(S.dedup("f3t", "c8k"), S.missing("c8k", "c8"))))
def cl7(spark, sf):
    """CL7 no numeric NULL remains after missing-value handling (count of offending rows)."""
    d = CL.handle_missing_values(CL.dedup_keys(typed(spark, sf)))
    from functools import reduce
    cond = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in S.F3_NUMERIC])
    return d.where(cond).agg(F.count(F.lit(1)).alias("rows_with_null"))


@register("cl9", sql=q("SELECT username, date, seq, " + S.flag_sql("reach", "bz", "zscore") + " AS reach_z_outlier, "
                       + S.flag_sql("reach", "bi") + " AS reach_iqr_outlier FROM f3t, bz, bi", "f3",
                       extra=chain(S.bounds_cte("f3t", "bz", ["reach"], "zscore"),
                                   S.bounds_cte("f3t", "bi", ["reach"], "iqr"))))
def cl9(spark, sf):
    """CL9 detect_outliers on reach: z-score (sample std, t=3) and IQR (t=3)."""
    d = typed(spark, sf)
    bz = CL.outlier_bounds(d, ["reach"], "zscore", 3.0)["reach"]
    bi = CL.outlier_bounds(d, ["reach"], "iqr", 3.0)["reach"]
    return d.select("username", "date", "seq", CL.outlier_flag("reach", bz, "zscore").alias("reach_z_outlier"),
                    CL.outlier_flag("reach", bi, "iqr").alias("reach_iqr_outlier"))


@register("cl10", doubles=OUT_DOUBLES, sql=q("SELECT * FROM c10", "f3", extra=chain(S.outliers_cap("f3t", "c10"))))
def cl10(spark, sf):
    """CL10 cap outliers of the 17 columns to Q1-3IQR..Q3+3IQR (floor 0 for counts)."""
    return CL.handle_outliers(typed(spark, sf), "iqr", 3.0, "cap")[0]


@register("cl9c", sql=q("SELECT username, date, seq, " + S.flag_sql("reach", "bz", "zscore") + " AS reach_z_outlier, "
                        + S.flag_sql("reach", "bi") + " AS reach_iqr_outlier FROM f3t LEFT JOIN bz USING (username) LEFT JOIN bi USING (username)",
                        "f3", extra=chain(S.bounds_cte("f3t", "bz", ["reach"], "zscore", by="username"),
                                          S.bounds_cte("f3t", "bi", ["reach"], "iqr", by="username"))))
def cl9c(spark, sf):
    """CL9 per creator: a day is an outlier against its creator's own history."""
    d = typed(spark, sf)
    z = CL.detect_outliers(d, ["reach"], "zscore", scope=["username"]).withColumnRenamed("reach_outlier", "reach_z_outlier")
    both = CL.detect_outliers(z, ["reach"], "iqr", scope=["username"]).withColumnRenamed("reach_outlier", "reach_iqr_outlier")
    return both.select("username", "date", "seq", "reach_z_outlier", "reach_iqr_outlier")


@register("cl10c", doubles=OUT_DOUBLES, sql=q("SELECT * FROM c10", "f3", extra=chain(S.outliers_cap("f3t", "c10", by="username"))))
def cl10c(spark, sf):
    """CL10 per creator: caps at the bounds of the creator's own history."""
    return CL.handle_outliers(typed(spark, sf), "iqr", 3.0, "cap", scope=["username"])[0]


@register("cl11c", doubles=F3_DOUBLES, sql=q("SELECT * FROM c11", "f3", extra=chain(S.outliers_remove("f3t", "c11", by="username"))))
def cl11c(spark, sf):
    """CL11 per creator: sequential removal in one shuffle, no job per column."""
    return CL.handle_outliers(typed(spark, sf), "iqr", 3.0, "remove", scope=["username"])[0]


@register("cl11", doubles=F3_DOUBLES, sql=q("SELECT * FROM c11", "f3", extra=chain(S.outliers_remove("f3t", "c11"))))
def cl11(spark, sf):
    """CL11 remove outlier rows column by column, thresholds recomputed on what is left."""
    return CL.handle_outliers(typed(spark, sf), "iqr", 3.0, "remove")[0]


@register("cl12", doubles=OUT_DOUBLES, sql=q("SELECT * FROM c12", "f3", extra=chain(S.outliers_transform("f3t", "c12"))))
def cl12(spark, sf):
    """CL12 log1p of followers / reach where outliers were found."""
    return CL.handle_outliers(typed(spark, sf), "iqr", 3.0, "transform")[0]


@register("cl13", doubles=F3_DOUBLES, sql=q("SELECT * FROM c13", "f3", extra=chain(S.fix_ranges("f3t", "c13", F3_COLUMNS))))
def cl13(spark, sf):
    """CL13 clip to the fixed business ranges."""
    return CL.fix_ranges(typed(spark, sf))


def _shares_sql():
    tot = "(posts + reels + stories)"
    k = "(CAST(regexp_extract(username, '(\\d+)$', 1) AS BIGINT) % 4)"
    return (f"sh AS (SELECT username, date, {sdiv('posts', tot)} AS share_posts, {sdiv('reels', tot)} AS share_reels, "
            f"{sdiv('stories', tot + ' + ' + k)} AS share_stories FROM f1)")


@register("cl14", doubles=("share_posts", "share_reels", "share_stories"),
          sql=q("SELECT username, date, CASE WHEN ABS(s - 1.0) > 0.01 AND s > 0 THEN share_posts / s ELSE share_posts END "
                "AS share_posts, CASE WHEN ABS(s - 1.0) > 0.01 AND s > 0 THEN share_reels / s ELSE share_reels END AS "
                "share_reels, CASE WHEN ABS(s - 1.0) > 0.01 AND s > 0 THEN share_stories / s ELSE share_stories END AS "
                "share_stories FROM (SELECT *, share_posts + share_reels + share_stories AS s FROM sh) a", "f1",
                extra=_shares_sql()))
def cl14(spark, sf):
    """CL14 share normalisation of the offending rows (B5)."""
    from ..functions import exprs as X
    d = FX.daily_metrics(spark, sf)
    tot = F.col("posts") + F.col("reels") + F.col("stories")
    k = F.pmod(F.regexp_extract("username", r"(\d+)$", 1).cast("long"), F.lit(4))
    d = d.select("username", "date", X.safe_divide("posts", tot).alias("share_posts"),
                 X.safe_divide("reels", tot).alias("share_reels"),
                 X.safe_divide("stories", tot + k).alias("share_stories"))
    return CL.normalise_shares(d)


@register("cl15", sql=q("SELECT username, date, seq, CASE WHEN ABS(growth - (follows - unfollows)) > 10 THEN "
                        "follows - unfollows ELSE growth END AS growth FROM f3t", "f3", extra=chain()))
def cl15(spark, sf):
    """CL15 growth := follows - unfollows where off by more than 10 (offending rows only)."""
    return CL.fix_growth_consistency(typed(spark, sf)).select("username", "date", "seq", "growth")


_IMP = sdiv("post_likes + comments + saves + shares", "reach")


@register("cl16", doubles=("engagement_rate",),
          sql=q(f"SELECT username, date, seq, CASE WHEN COALESCE(ABS(engagement_rate - {_IMP}) > 0.1, FALSE) THEN {_IMP} "
                f"ELSE engagement_rate END AS engagement_rate FROM f3t", "f3", extra=chain()))
def cl16(spark, sf):
    """CL16 engagement_rate := interactions / reach where off by more than 0.1."""
    return CL.fix_rate_consistency(typed(spark, sf)).select("username", "date", "seq", "engagement_rate")


@register("cl17", sql=q("SELECT username, date, followers FROM c17", "f3", recursive=True,
                        extra=chain(S.dedup("f3t", "c17d"), S.smooth("c17d", "c17", "BIGINT"))))
def cl17(spark, sf):
    """CL17 follower-jump smoothing (sequential fold per creator) on de-duplicated typed F3."""
    d = CL.dedup_keys(typed(spark, sf))
    return CL.smooth_follower_jumps(d).select("username", "date", "followers")


@register("cl18", doubles=F3_DOUBLES,
          sql=q("SELECT * FROM c18", "f3", extra=chain(S.fix_ranges("f3t", "c18r", F3_COLUMNS), S.growth_rate("c18r", "c18"))))
def cl18(spark, sf):
    """CL18 validate_and_fix_ranges: CL13 + CL14 + CL15 + CL16 (CL17 checked on its own)."""
    return CL.validate_and_fix_ranges(typed(spark, sf), smooth=False)


@register("cl19", doubles=F3_DOUBLES, sql=q("SELECT * FROM c19", "f3",
                                             extra=chain(S.dedup("f3t", "c19d"), S.round_cols("c19d", "c19"))))
def cl19(spark, sf):
    """CL19 ensure_data_consistency: half-even rounding, last row per (username, date) by seq."""
    return CL.ensure_data_consistency(typed(spark, sf))


ENG = [c for c in C.ENGAGEMENT_CLEAN_COLUMNS if c in F3_COLUMNS and c != "engagement_rate"]


@register("cl20", doubles=("engagement_rate",),
          sql=q("SELECT username, date, seq, " + ", ".join(f"{clip_sql(c, 0)} AS {c}" for c in ENG) + ", CASE WHEN "
                f"(SELECT MAX({clip_sql('engagement_rate', '0.0')}) FROM f3t) > 1.0 THEN "
                f"{clip_sql(clip_sql('engagement_rate', '0.0'), None, '0.5')} "
                f"ELSE {clip_sql('engagement_rate', '0.0')} END AS engagement_rate FROM f3t", "f3", extra=chain()))
def cl20(spark, sf):
    """CL20 clean_engagement_data: floor 0; if any rate > 1, cap every rate at 0.5."""
    d = CL.clean_engagement_data(typed(spark, sf))
    return d.select("username", "date", "seq", *ENG, "engagement_rate")


@register("cl21", sql=q("SELECT username, date, seq, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN NULL ELSE GREATEST(0, LEAST({cap}, {c})) END AS {c}" for c, cap in C.POSTING_CAPS) +
    ", CASE WHEN post_time IS NULL THEN '12:00' WHEN contains(post_time, ':') THEN substr(post_time, 1, 5) ELSE '12:00' END "
    "AS post_time FROM f3t", "f3", extra=chain()))
def cl21(spark, sf):
    """CL21 clean_posting_data: floor 0, caps 10/5/20/5, post time HH:MM."""
    d = CL.clean_posting_data(typed(spark, sf))
    return d.select("username", "date", "seq", *[c for c, _ in C.POSTING_CAPS], "post_time")


@register("cl22", doubles=F3_DOUBLES, sql=q("SELECT * FROM c22", "f3", recursive=True, extra=chain(
    S.dedup("f3t", "c22a"), S.missing("c22a", "c22b"), S.outliers_cap("c22b", "c22c"),
    S.fix_ranges("c22c", "c22d", F3_COLUMNS), S.growth_rate("c22d", "c22e"), S.smooth("c22e", "c22f"),
    S.round_cols("c22f", "c22"))))
def cl22(spark, sf):
    """CL22 clean_raw_data: types -> key dedup -> missing -> outliers (cap) -> ranges -> rounding."""
    return CL.clean_raw_data(FX.daily_dirty(spark, sf))[0]
