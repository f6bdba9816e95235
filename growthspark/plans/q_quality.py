"""Registered queries: data quality DQ1-DQ14."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import clean as CL
from ..operators import quality as Q
from ..operators import weekly as W
from ..sources import fixtures as FX
from ..sources.fixtures import F3_COLUMNS
from . import sql_clean as S
from .registry import register
from .sqlparts import q, weekly_feature_ctes

ISSUE = ["check_name", "column_name", "n", "value", "is_issue"]


def _row(check, column, n, value, issue):
    col = "CAST(NULL AS VARCHAR)" if column is None else f"'{column}'"
    val = "CAST(NULL AS DOUBLE)" if value is None else f"CAST({value} AS DOUBLE)"
    return f"SELECT '{check}' AS check_name, {col} AS column_name, CAST({n} AS BIGINT) AS n, {val} AS value, {issue} AS is_issue"


def _typed(spark, sf):
    return CL.fix_data_types(FX.daily_dirty(spark, sf))[0]


@register("dq1", sql=None)
def dq1(spark, sf):
    """DQ1 schema check of F3 raw: required columns, type by name, emptiness (rows-only)."""
    return Q.validate_dataframe_schema(FX.daily_dirty(spark, sf))


MISS_SQL = " UNION ALL ".join(
    _row("missing_share", c, f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)",
         f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / COUNT(*)",
         f"COALESCE(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / COUNT(*) > 0.05, FALSE)") + " FROM f3"
    for c in F3_COLUMNS)


@register("dq2", doubles=("value",), sql=q(MISS_SQL, "f3"))
def dq2(spark, sf):
    """DQ2 missing share per column (a fraction, limit 0.05) on F3 raw."""
    return Q.column_checks(FX.daily_dirty(spark, sf)).where(F.col("check_name") == "missing_share")


@register("dq3", doubles=("value",), sql=q(_row("row_count", None, "COUNT(*)", "COUNT(*)", "COUNT(*) < 90") + " FROM f3", "f3"))
def dq3(spark, sf):
    """DQ3 minimum row count (90)."""
    return Q.column_checks(FX.daily_dirty(spark, sf)).where(F.col("check_name") == "row_count")


DUP_SQL = (f"SELECT 'duplicate_rows' AS check_name, CAST(NULL AS VARCHAR) AS column_name, "
           f"CAST(COALESCE(SUM(k - 1), 0) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS value, "
           f"COALESCE(SUM(k - 1), 0) > 0 AS is_issue FROM (SELECT COUNT(*) AS k FROM f3 GROUP BY "
           f"{', '.join(F3_COLUMNS)}) g")


@register("dq4", sql=q(DUP_SQL, "f3"))
def dq4(spark, sf):
    """DQ4 rows equal to an earlier row in every column."""
    return Q.duplicate_rows(FX.daily_dirty(spark, sf))


RANGE_RULES = {c: (lo, hi if hi is not None else 1e18) for c, lo, hi in C.RANGE_CONSTRAINTS}
RANGE_SQL = " UNION ALL ".join(
    _row("out_of_range", c, f"SUM(CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1 ELSE 0 END)", None,
         f"SUM(CASE WHEN {c} < {lo} OR {c} > {hi} THEN 1 ELSE 0 END) > 0") + " FROM f3"
    for c, (lo, hi) in RANGE_RULES.items() if c in F3_COLUMNS)


@register("dq5", sql=q(RANGE_SQL, "f3"))
def dq5(spark, sf):
    """DQ5 out-of-range counts with an explicit rule map (B3)."""
    return Q.column_checks(FX.daily_dirty(spark, sf), ranges=RANGE_RULES).where(
        F.col("check_name") == "out_of_range")


EMPTY_SQL = _row("empty_rows", None, "SUM(CASE WHEN " + " AND ".join(f"{c} IS NULL" for c in F3_COLUMNS)
                 + " THEN 1 ELSE 0 END)", None,
                 "SUM(CASE WHEN " + " AND ".join(f"{c} IS NULL" for c in F3_COLUMNS) + " THEN 1 ELSE 0 END) > 0") + " FROM f3"


@register("dq6", sql=q(EMPTY_SQL, "f3"))
def dq6(spark, sf):
    """DQ6 rows with every column missing."""
    return Q.column_checks(FX.daily_dirty(spark, sf)).where(F.col("check_name") == "empty_rows")


NEG_SQL = " UNION ALL ".join(
    _row("negative_values", c, f"SUM(CASE WHEN {c} < 0 THEN 1 ELSE 0 END)", None,
         f"SUM(CASE WHEN {c} < 0 THEN 1 ELSE 0 END) > 0") + " FROM f3"
    for c in C.NEGATIVE_CHECK_COLUMNS if c in F3_COLUMNS)


@register("dq7", sql=q(NEG_SQL, "f3"))
def dq7(spark, sf):
    """DQ7 negative counts in followers, posts, reels, stories, reach, post_likes."""
    return Q.column_checks(FX.daily_dirty(spark, sf)).where(F.col("check_name") == "negative_values")


GAP_SQL = ("SELECT 'date_gaps' AS check_name, 'date' AS column_name, CAST(COALESCE(SUM(CASE WHEN gap > 7 THEN 1 ELSE 0 "
           "END), 0) AS BIGINT) AS n, CAST(MAX(gap) AS DOUBLE) AS value, COALESCE(SUM(CASE WHEN gap > 7 THEN 1 ELSE 0 "
           "END), 0) > 0 AS is_issue FROM (SELECT date - LAG(date) OVER (PARTITION BY username ORDER BY date NULLS LAST) "
           "AS gap FROM f3t) g")


@register("dq8", doubles=("value",), sql=q(GAP_SQL, "f3", extra=S.typed()))
def dq8(spark, sf):
    """DQ8 date gaps > 7 days within each creator (typed F3)."""
    return Q.date_gaps(_typed(spark, sf))


REF_SQL = ("SELECT 'row_count_mismatch' AS check_name, CAST(NULL AS VARCHAR) AS column_name, CAST((SELECT COUNT(*) FROM f3) - "
           "(SELECT COUNT(*) FROM f1) AS BIGINT) AS n, CAST((SELECT COUNT(*) FROM f1) AS DOUBLE) AS value, "
           "(SELECT COUNT(*) FROM f3) <> (SELECT COUNT(*) FROM f1) AS is_issue UNION ALL "
           f"SELECT 'common_columns', NULL, CAST({len(set(F3_COLUMNS) & set(FX.F1_COLUMNS))} AS BIGINT), NULL, FALSE")


@register("dq9", doubles=("value",), sql=q(REF_SQL, "f3"))
def dq9(spark, sf):
    """DQ9 comparison with a reference frame (F3 vs F1): row counts, common columns."""
    return Q.reference_comparison(FX.daily_dirty(spark, sf), FX.daily_metrics(spark, sf))


@register("dq10", doubles=("value",),
          sql=q(" UNION ALL ".join([DUP_SQL.replace("FROM f3 GROUP BY", "FROM f3t GROUP BY"),
                                    EMPTY_SQL.replace("FROM f3", "FROM f3t"),
                                    NEG_SQL.replace("FROM f3", "FROM f3t"), GAP_SQL]), "f3", extra=S.typed()))
def dq10(spark, sf):
    """DQ10 validate_data_integrity on typed F3: duplicates, empty rows, negatives, gaps."""
    return Q.validate_data_integrity(_typed(spark, sf))


@register("dq11", sql=None)
def dq11(spark, sf):
    """DQ11 validate_raw_data_schema on F3 raw (schema + quality issues; rows-only)."""
    return Q.validate_raw_data_schema(FX.daily_dirty(spark, sf), ranges=RANGE_RULES)


@register("dq12", sql=None)
def dq12(spark, sf):
    """DQ12 processed-schema check of the weekly feature table (rows-only)."""
    return Q.validate_processed_data_schema(W.weekly_feature_table(FX.daily_metrics(spark, sf)), "core")


def _nulls(src, cols):
    return " + ".join(f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in cols)


DQ13_SQL = (
    "SELECT a.original_rows, b.cleaned_rows, b.cleaned_rows / CAST(a.original_rows AS DOUBLE) AS rows_preserved, "
    f"{len(F3_COLUMNS)} AS columns_preserved, CAST(a.mb AS BIGINT) AS missing_values_before, "
    "CAST(b.ma AS BIGINT) AS missing_values_after, CAST(b.nf AS BIGINT) AS negative_followers, "
    "CAST(b.ir AS BIGINT) AS impossible_engagement_rates, '' AS missing_critical_columns, "
    "GREATEST(0.0, 1.0 - (CASE WHEN b.cleaned_rows / CAST(a.original_rows AS DOUBLE) < 0.95 THEN 0.2 ELSE 0.0 END) "
    f"- b.ma / CAST(b.cleaned_rows * {len(F3_COLUMNS)} AS DOUBLE) * 0.3 - (CASE WHEN b.nf > 0 THEN 0.1 ELSE 0.0 END) "
    "- (CASE WHEN b.ir > 0 THEN 0.1 ELSE 0.0 END)) AS overall_quality_score "
    f"FROM (SELECT COUNT(*) AS original_rows, {_nulls('f3', F3_COLUMNS)} AS mb FROM f3) a, "
    f"(SELECT COUNT(*) AS cleaned_rows, {_nulls('c', F3_COLUMNS)} AS ma, SUM(CASE WHEN followers < 0 THEN 1 ELSE 0 END) "
    "AS nf, SUM(CASE WHEN engagement_rate > 1 THEN 1 ELSE 0 END) AS ir FROM c19) b")


@register("dq13", doubles=("rows_preserved", "overall_quality_score"),
          sql=q(DQ13_SQL, "f3", extra=",\n".join([S.typed(), S.dedup("f3t", "c19d"), S.round_cols("c19d", "c19")])))
def dq13(spark, sf):
    """DQ13 cleaning quality of CL19 (typed, rounded, de-duplicated F3) against raw F3."""
    raw = FX.daily_dirty(spark, sf)
    return Q.validate_cleaning_quality(raw, CL.ensure_data_consistency(_typed(spark, sf)))


def _requests(spark, sf):
    """Stand-in request rows: weekly feature rows in the request schema."""
    w = W.weekly_feature_table(FX.daily_metrics(spark, sf))
    return w.select("username", "week_start", "weekly_posting_frequency", "share_posts", "share_reels",
                    "share_stories", "engagement_rate", "avg_hashtag_count", "roi_follows_per_hour",
                    "minutes_spent", F.month("week_start").alias("month"), F.quarter("week_start").alias("quarter"))


def _reason_sql(rules):
    parts = []
    for name, default, lo, hi in rules:
        if name in ("post_consistency_variance_7d", "posted_in_optimal_window", "saturation_flag"):
            continue
        if lo is not None:
            parts.append(f"CASE WHEN {name} < {lo} THEN '{name}: below {lo}' END")
        if hi is not None:
            parts.append(f"CASE WHEN {name} > {hi} THEN '{name}: above {hi}' END")
    return "concat_ws('; ', " + ", ".join(parts) + ")"


@register("dq14", sql=q(f"SELECT username, week_start, {_reason_sql(C.REQUEST_FIELDS)} AS reasons, "
                        f"{_reason_sql(C.REQUEST_FIELDS)} = '' AS accepted FROM (SELECT *, CAST(month(week_start) AS "
                        f"INTEGER) AS month, CAST(quarter(week_start) AS INTEGER) AS quarter FROM wf) r", "f1",
                        extra=weekly_feature_ctes("f1")))
def dq14(spark, sf):
    """DQ14 request bounds: accepted flag and joined rejection reasons."""
    v = Q.validate_inputs(_requests(spark, sf))
    return v.select("username", "week_start", F.concat_ws("; ", "rejected_reasons").alias("reasons"), "accepted")
