"""Validation and data-quality checks (DQ1-DQ14) as issue tables.

Every per-column check (missing share, ranges, negatives, all-empty rows,
row count) is fused into **one** aggregate pass over the table and then melted
into long rows ``check, column, count, value, is_issue``; only duplicates
(DQ4, a group-by on all columns with map-side combine) and date gaps (DQ8, a
creator window) need a shuffle.  Nothing is collected except one-row
results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions.stats import merge_rows
from ..session import write_once

ISSUE_SCHEMA = "check_name string, column_name string, n bigint, value double, is_issue boolean"
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _issues(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, ISSUE_SCHEMA)


def _melt(one_row: DataFrame, items: list[tuple[str, str, str, str | None]]) -> DataFrame:
    """items: (check, column, count_field, value_field) -> long rows."""
    structs = [F.struct(F.lit(ch).alias("check_name"), F.lit(co).alias("column_name"),
                        F.col(cf).cast("long").alias("n"),
                        (F.col(vf).cast("double") if vf else F.lit(None).cast("double")).alias("value"))
               for ch, co, cf, vf in items]
    return one_row.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC)


# DQ1 ------------------------------------------------------------------------
def validate_dataframe_schema(df: DataFrame, required=None, types=None) -> DataFrame:
    """Missing required columns, type mismatches (by type-name substring), emptiness."""
    spark = df.sparkSession
    required = list(C.REQUIRED_RAW_COLUMNS if required is None else required)
    types = dict(C.RAW_TYPE_CHECKS if types is None else types)
    rows = []
    for c in required:
        if c not in df.columns:
            rows.append(("missing_column", c, 1, None, True))
    alias = {"int": ("int", "bigint", "smallint", "tinyint"), "float": ("double", "float")}
    for c, want in types.items():
        if c in df.columns:
            got = df.schema[c].dataType.simpleString()
            ok = got in alias.get(want, (want,)) or want in got
            rows.append(("column_type", c, 0 if ok else 1, None, not ok))
    empty = len(df.select(F.lit(1)).limit(1).collect()) == 0
    rows.append(("empty_frame", None, 1 if empty else 0, None, empty))
    return _issues(spark, rows)


# DQ2, DQ3, DQ5, DQ6, DQ7 in one pass -----------------------------------------
def column_checks(df: DataFrame, max_missing: float = 0.05, min_rows: int = 90,
                  ranges: dict | None = None, negative_cols=None) -> DataFrame:
    """DQ2 missing share (B2: a fraction), DQ3 row count, DQ5 ranges, DQ6 empty rows,
    DQ7 negatives -- one aggregate, melted."""
    negative_cols = [c for c in (C.NEGATIVE_CHECK_COLUMNS if negative_cols is None else negative_cols)
                     if c in df.columns]
    ranges = {c: r for c, r in (ranges or {}).items() if c in df.columns}
    cols = df.columns
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs.append(F.sum(F.col(c).isNull().cast("long")).alias(f"m{i}"))
    all_null = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols])
    aggs.append(F.sum(all_null.cast("long")).alias("empty"))
    for i, c in enumerate(negative_cols):
        aggs.append(F.sum((F.col(c) < 0).cast("long")).alias(f"neg{i}"))
    rlist = list(ranges.items())
    for i, (c, (lo, hi)) in enumerate(rlist):
        aggs.append(F.sum(((F.col(c) < lo) | (F.col(c) > hi)).cast("long")).alias(f"rng{i}"))
    one = df.agg(*aggs)
    one = one.select("*", *[F.try_divide(F.col(f"m{i}"), F.col("n")).alias(f"mf{i}") for i in range(len(cols))])
    items = [("missing_share", c, f"m{i}", f"mf{i}") for i, c in enumerate(cols)]
    items += [("row_count", None, "n", "n"), ("empty_rows", None, "empty", None)]
    items += [("negative_values", c, f"neg{i}", None) for i, c in enumerate(negative_cols)]
    items += [("out_of_range", c, f"rng{i}", None) for i, (c, _) in enumerate(rlist)]
    long = _melt(one, items)
    issue = (F.when(F.col("check_name") == "missing_share", F.coalesce(F.col("value") > max_missing, F.lit(False)))
             .when(F.col("check_name") == "row_count", F.col("n") < min_rows)
             .otherwise(F.col("n") > 0))
    return long.withColumn("is_issue", issue)


# DQ4 ------------------------------------------------------------------------
def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row in every column (NULLs compare equal)."""
    g = df.groupBy(*df.columns).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n")).select(
        F.lit("duplicate_rows").alias("check_name"), F.lit(None).cast("string").alias("column_name"), "n",
        F.lit(None).cast("double").alias("value"), (F.col("n") > 0).alias("is_issue"))


# DQ8 ------------------------------------------------------------------------
def date_gaps(df: DataFrame, max_gap: int = C.MAX_DATE_GAP_DAYS, creator: str = "username",
              date_col: str = "date") -> DataFrame:
    """Gaps larger than ``max_gap`` days between consecutive dates of a creator."""
    w = Window.partitionBy(creator).orderBy(F.col(date_col).asc_nulls_last())
    gap = F.datediff(F.col(date_col), F.lag(date_col).over(w))
    g = df.select(gap.alias("gap")).agg(F.sum((F.col("gap") > max_gap).cast("long")).alias("cnt"),
                                        F.max("gap").alias("mx"))
    return g.select(F.lit("date_gaps").alias("check_name"), F.lit(date_col).alias("column_name"),
                    F.coalesce(F.col("cnt"), F.lit(0)).cast("long").alias("n"),
                    F.col("mx").cast("double").alias("value"),
                    (F.coalesce(F.col("cnt"), F.lit(0)) > 0).alias("is_issue"))


# DQ9 ------------------------------------------------------------------------
def reference_comparison(df: DataFrame, ref: DataFrame) -> DataFrame:
    """Row-count mismatch and common-column count against a reference frame."""
    common = len(set(df.columns) & set(ref.columns))
    a = df.agg(F.count(F.lit(1)).alias("na"))
    b = ref.agg(F.count(F.lit(1)).alias("nb"))
    ab = merge_rows(a, b)
    return ab.select(F.explode(F.array(
        F.struct(F.lit("row_count_mismatch").alias("check_name"), F.lit(None).cast("string").alias("column_name"),
                 (F.col("na") - F.col("nb")).cast("long").alias("n"), F.col("nb").cast("double").alias("value"),
                 (F.col("na") != F.col("nb")).alias("is_issue")),
        F.struct(F.lit("common_columns").alias("check_name"), F.lit(None).cast("string").alias("column_name"),
                 F.lit(common).cast("long").alias("n"), F.lit(None).cast("double").alias("value"),
                 F.lit(common == 0).alias("is_issue")))).alias("x")).select("x.*")


# DQ10 -----------------------------------------------------------------------
def validate_data_integrity(df: DataFrame, reference: DataFrame | None = None,
                            creator: str = "username", date_col: str = "date") -> DataFrame:
    """Duplicates, empty rows, negatives, date gaps (+ reference comparison)."""
    df = write_once(df)  # three checks read it
    parts = [duplicate_rows(df),
             column_checks(df, ranges={}).where(F.col("check_name").isin("empty_rows", "negative_values"))]
    if date_col in df.columns:
        parts.append(date_gaps(df, creator=creator, date_col=date_col))
    if reference is not None:
        parts.append(reference_comparison(df, reference))
    return reduce(DataFrame.unionByName, parts)


# DQ11 -----------------------------------------------------------------------
def business_ranges() -> dict:
    """{column: (lowest, highest)} of the business bounds; no upper bound is a very large one."""
    return {c: (lo, 1e18 if hi is None else hi) for c, lo, hi in C.RANGE_CONSTRAINTS}


def validate_raw_data_schema(df: DataFrame, ranges: dict | None = None) -> DataFrame:
    """DQ1 + DQ2-5 (B3: explicit range rules) -> issue rows; valid = no issue."""
    th = C.DATA_QUALITY_THRESHOLDS
    parts = [validate_dataframe_schema(df),
             column_checks(df, th["max_missing_percentage"], th["min_data_points"], ranges or {}, [])
             .where(F.col("check_name") != "empty_rows"),
             duplicate_rows(df)]
    return reduce(DataFrame.unionByName, parts)


def verdict(issues: DataFrame) -> DataFrame:
    return issues.agg(F.sum(F.col("is_issue").cast("long")).alias("n_issues")).select(
        "n_issues", (F.col("n_issues") == 0).alias("is_valid"))


# DQ12 -----------------------------------------------------------------------
PROCESSED_SETS = {
    # B12: the names the feature code really produces
    "weekly": ["week_start", "week_end", "posts", "reels", "stories", "engagement_rate", "reach"],
    "core": ["share_posts", "share_reels", "share_stories", "posting_consistency_variance"],
    "full": ["share_posts", "share_reels", "share_stories", "posting_consistency_variance",
             "roi_follows_per_hour", "engagement_rate_smoothed", "posted_in_optimal_window"],
}


def validate_processed_data_schema(df: DataFrame, feature_set: str = "full") -> DataFrame:
    spark = df.sparkSession
    req = ["weekly_posting_frequency", "weekly_growth"] + PROCESSED_SETS.get(feature_set, PROCESSED_SETS["full"])
    rows = [("missing_column", c, 1, None, True) for c in req if c not in df.columns]
    if "weekly_growth" not in df.columns:
        rows.append(("missing_target", "weekly_growth", 1, None, True))
    for c in req:
        if c in df.columns and c not in ("week_start", "week_end") and not is_numeric(df, c):
            rows.append(("not_numeric", c, 1, None, True))
    rows.append(("checked_columns", None, len(req), None, False))
    return _issues(spark, rows)


# DQ13 -----------------------------------------------------------------------
def _null_total(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, [F.sum(F.col(c).isNull().cast("long")) for c in df.columns])


def validate_cleaning_quality(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows kept, missing before/after, consistency counts and the 0-1 score."""
    a = before.agg(F.count(F.lit(1)).alias("original_rows"), _null_total(before).alias("missing_values_before"))
    aggs = [F.count(F.lit(1)).alias("cleaned_rows"), _null_total(after).alias("missing_values_after")]
    aggs.append((F.sum((F.col("followers") < 0).cast("long")) if "followers" in after.columns
                 else F.lit(0)).cast("long").alias("negative_followers"))
    aggs.append((F.sum((F.col("engagement_rate") > 1.0).cast("long")) if "engagement_rate" in after.columns
                 else F.lit(0)).cast("long").alias("impossible_engagement_rates"))
    b = after.agg(*aggs)
    missing_critical = [c for c in C.CRITICAL_COLUMNS if c not in after.columns]
    ncols = len(after.columns)
    j = merge_rows(a, b)
    kept = F.when(F.col("original_rows") > 0, F.col("cleaned_rows") / F.col("original_rows")).otherwise(F.lit(0.0))
    miss_ratio = F.try_divide(F.col("missing_values_after").cast("double"), F.col("cleaned_rows") * F.lit(ncols))
    score = (F.lit(1.0) - F.when(kept < 0.95, 0.2).otherwise(0.0) - F.coalesce(miss_ratio, F.lit(0.0)) * 0.3
             - F.when(F.coalesce(F.col("negative_followers"), F.lit(0)) > 0, 0.1).otherwise(0.0)
             - F.when(F.coalesce(F.col("impossible_engagement_rates"), F.lit(0)) > 0, 0.1).otherwise(0.0)
             - (0.3 if missing_critical else 0.0))
    return j.select(
        "original_rows", "cleaned_rows", kept.alias("rows_preserved"),
        F.lit(len(set(before.columns) & set(after.columns))).alias("columns_preserved"),
        F.col("missing_values_before").cast("long").alias("missing_values_before"),
        F.col("missing_values_after").cast("long").alias("missing_values_after"),
        F.coalesce(F.col("negative_followers"), F.lit(0)).cast("long").alias("negative_followers"),
        F.coalesce(F.col("impossible_engagement_rates"), F.lit(0)).cast("long").alias("impossible_engagement_rates"),
        F.lit(",".join(missing_critical)).alias("missing_critical_columns"),
        F.greatest(F.lit(0.0), score).alias("overall_quality_score"))


# DQ14 -----------------------------------------------------------------------
def validate_inputs(df: DataFrame, rules=None) -> DataFrame:
    """Rule columns on request rows: ``rejected_reasons`` (array) and ``accepted``."""
    rules = C.REQUEST_FIELDS if rules is None else rules
    reasons = []
    for name, default, lo, hi in rules:
        if name not in df.columns:
            continue
        c = F.col(name)
        if default is None:
            reasons.append(F.when(c.isNull(), F.lit(f"{name}: required")))
        if lo is not None:
            reasons.append(F.when(c < lo, F.lit(f"{name}: below {lo}")))
        if hi is not None:
            reasons.append(F.when(c > hi, F.lit(f"{name}: above {hi}")))
    arr = F.filter(F.array(*reasons), lambda x: x.isNotNull()) if reasons else F.array().cast("array<string>")
    return (df.withColumn("rejected_reasons", arr)
              .withColumn("accepted", F.size("rejected_reasons") == 0))
