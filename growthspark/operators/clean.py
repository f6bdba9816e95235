"""Cleaning (CL1-CL22) as DataFrame -> DataFrame steps.

Pipeline order (as the reference): types -> missing -> outliers -> ranges ->
consistency.  Engine decisions (SURVEY 2.18) are noted per function.

Scale notes
-----------
* Statistics that parameterise a row rule (means, modes, quartiles, maxima)
  are computed in one aggregate pass per step.  Whole-table scope: the result
  is a handful of numbers, inlined as literals (no join);
  per-creator scope: window aggregates partitioned by creator.
* Quartiles use the exact distributed selection of ``functions.stats``.
* Key de-duplication (CL19) is an aggregate (``max`` of a struct led by the
  sequence column), so it combines map-side and a hot key never lands in one
  task as raw rows.
* The only sequential rule (CL17 follower-jump smoothing) streams each
  creator's rows in date order through Arrow batches, carrying one number.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import exprs as X
from ..functions.stats import attach_row, attach_scope_stats, cell_quantiles, global_quantiles, scalar_stats, scoped_quantiles, value_cells
from ..session import cut_lineage, write_once
from . import windows as WN

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType, T.DecimalType)


def _present(df: DataFrame, cols) -> list[str]:
    return [c for c in cols if c in df.columns]


def _is(df, c, kinds) -> bool:
    return isinstance(df.schema[c].dataType, kinds)


# FN7 as a frame step ---------------------------------------------------------
def fix_data_types(df: DataFrame, date_format: str = "d-M-yyyy") -> tuple[DataFrame, int]:
    """Coerce to the canonical types; returns (frame, number of columns fixed).

    B4: ``followers`` is parsed but keeps NULL (filled forward later) instead
    of becoming 0 in this step.
    """
    out, fixes = df, 0
    for c in _present(df, C.INT_COLUMNS):
        if not _is(df, c, INTEGRAL):
            parsed = F.col(c).cast("string").try_cast("double").try_cast("long")
            out = out.withColumn(c, parsed if c in C.FORWARD_FILL_COLUMNS else X.coerce_int(c))
            fixes += 1
    for c in _present(df, C.FLOAT_COLUMNS):
        if not _is(df, c, FLOATING):
            out = out.withColumn(c, X.coerce_float(c))
            fixes += 1
        elif isinstance(df.schema[c].dataType, T.DoubleType):
            out = out.withColumn(c, X.null_if_nan(c))  # T6: NaN -> NULL on ingest
    for c in _present(df, C.STRING_COLUMNS):
        if not isinstance(df.schema[c].dataType, T.StringType):
            out = out.withColumn(c, F.col(c).cast("string"))
            fixes += 1
    if "date" in df.columns and not isinstance(df.schema["date"].dataType, T.DateType):
        if isinstance(df.schema["date"].dataType, T.StringType):
            out = out.withColumn("date", F.to_date(F.try_to_timestamp(F.trim(F.col("date")), F.lit(date_format))))
        else:
            out = out.withColumn("date", F.to_date("date"))
        fixes += 1
    return out, fixes


# CL1-CL8 --------------------------------------------------------------------
def scoped_mode(df: DataFrame, c: str, scope=()) -> DataFrame:
    """Smallest most frequent non-NULL value per scope, as a two-stage aggregate."""
    scope = list(scope or ())
    counts = df.where(F.col(c).isNotNull()).groupBy(*scope, c).count()
    best = counts.groupBy(*scope).agg(F.max("count").alias("_mc"))
    top = counts.join(best, scope, "inner") if scope else attach_row(counts, best)
    top = top.where(F.col("count") == F.col("_mc"))
    # with no scope this is a global aggregate: exactly one row (NULL if empty)
    return top.groupBy(*scope).agg(F.min(c).alias(f"_mode_{c}"))


def fill_mode(df: DataFrame, cols, scope=()) -> DataFrame:
    scope = list(scope or ())
    out = df
    for c in _present(df, cols):
        if scope and c not in scope:
            out = out.withColumn(c, F.coalesce(F.col(c), F.mode(c, True).over(Window.partitionBy(*scope))))
        else:
            m = scoped_mode(df, c)
            out = attach_row(out, m).withColumn(c, F.coalesce(F.col(c), F.col(f"_mode_{c}"))).drop(
                f"_mode_{c}")
    return out


def handle_missing_values(df: DataFrame, scope=(), creator: str = "username",
                          interpolate_method: str = "linear") -> DataFrame:
    """CL8 = CL1 forward fill, CL2 zero fill, CL3 mean fill, CL4 mode fill,
    CL5 interpolation, CL7 remaining numeric NULL -> 0.

    Whole-table means and modes are jobs of their own: the rows are written
    once, so they and the result do not repeat the steps before.
    """
    jobs = not scope and _present(df, C.MEAN_FILL_COLUMNS + C.MODE_FILL_COLUMNS)
    out = write_once(df) if jobs else df
    for c in _present(out, C.FORWARD_FILL_COLUMNS):
        out = out.withColumn(c, WN.forward_fill(c, creator))
    zero = _present(out, C.ZERO_FILL_COLUMNS)
    if zero:
        out = out.fillna(0, subset=zero)
    means = _present(out, C.MEAN_FILL_COLUMNS)
    if means:
        out = attach_scope_stats(out, {f"_mean_{c}": F.avg(c) for c in means}, scope)
        for c in means:
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_mean_{c}"))).drop(f"_mean_{c}")
    out = fill_mode(out, C.MODE_FILL_COLUMNS, scope)
    for c in _present(out, C.INTERPOLATE_COLUMNS):
        out = WN.interpolate(out, c, interpolate_method, creator)
    numeric = [f.name for f in out.schema.fields if isinstance(f.dataType, INTEGRAL + FLOATING)]
    if numeric:
        out = out.fillna(0, subset=numeric)
    return out.select(*df.columns)


def null_count(df: DataFrame) -> Column:
    return reduce(lambda a, b: a + b, [F.sum(F.col(c).isNull().cast("long")) for c in df.columns])


def missing_handled(before: DataFrame, after: DataFrame) -> int:
    """CL8 statistic: NULLs before minus NULLs after (two one-row aggregates)."""
    a = before.agg(null_count(before).alias("n")).collect()[0]["n"] or 0
    b = after.agg(null_count(after).alias("n")).collect()[0]["n"] or 0
    return int(a - b)


# CL9-CL12 -------------------------------------------------------------------
def outlier_bounds(df: DataFrame, cols, method: str = "iqr", threshold: float = 3.0,
                   exact: bool = True) -> dict:
    """{col: (low, high)} over the whole table, one statistics pass for all columns."""
    cols = list(cols)
    if not cols:
        return {}
    if method == "iqr":
        spec = {}
        for c in cols:
            spec[f"{c}|q1"] = (c, 0.25)
            spec[f"{c}|q3"] = (c, 0.75)
        q = global_quantiles(df, spec, exact=exact)
        out = {}
        for c in cols:
            q1, q3 = q[f"{c}|q1"], q[f"{c}|q3"]
            if q1 is None:
                out[c] = (None, None)
            else:
                iqr = q3 - q1
                out[c] = (q1 - threshold * iqr, q3 + threshold * iqr)
        return out
    s = scalar_stats(df, {**{f"{c}|m": F.avg(F.col(c).cast("double")) for c in cols},
                          **{f"{c}|s": F.stddev_samp(F.col(c).cast("double")) for c in cols}})
    out = {}
    for c in cols:
        m, sd = s[f"{c}|m"], s[f"{c}|s"]
        out[c] = (None, None) if m is None or sd is None else (m - threshold * sd, m + threshold * sd)
    return out


def scoped_bounds(df: DataFrame, cols, scope, method: str = "iqr", threshold: float = 3.0,
                  alive: Column | None = None) -> tuple[DataFrame, dict]:
    """(frame with bound columns, {col: (low, high)}): the bounds of each row's scope, e.g. its creator.

    ``alive`` limits the rows that the statistics see.
    """
    cols, w = list(cols), Window.partitionBy(*scope)
    seen = {c: F.col(c).cast("double") if alive is None else F.when(alive, F.col(c).cast("double")) for c in cols}
    out = df.select("*", *[seen[c].alias(f"_x_{c}") for c in cols])
    if method == "iqr":
        out = scoped_quantiles(out, {f"_{k}_{c}": (f"_x_{c}", p) for c in cols for k, p in (("a", 0.25), ("b", 0.75))}, scope)
        step = {c: threshold * (F.col(f"_b_{c}") - F.col(f"_a_{c}")) for c in cols}
        low, high = ({c: F.col(f"_{k}_{c}") + sign * step[c] for c in cols} for k, sign in (("a", -1), ("b", 1)))
    else:
        out = out.select("*", *[F.avg(f"_x_{c}").over(w).alias(f"_a_{c}") for c in cols],
                         *[F.stddev_samp(f"_x_{c}").over(w).alias(f"_b_{c}") for c in cols])
        low, high = ({c: F.col(f"_a_{c}") + sign * threshold * F.col(f"_b_{c}") for c in cols} for sign in (-1, 1))
    out = out.select(*[F.col(f"`{c}`") for c in df.columns], *[low[c].alias(f"_lo_{c}") for c in cols], *[high[c].alias(f"_hi_{c}") for c in cols])
    return out, {c: (F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in cols}


def outlier_flag(c, bounds, method: str = "iqr") -> Column:
    """CL9: strictly outside the bounds, numbers or columns (zscore: |x-mean|/std > t, so std 0 flags nothing)."""
    lo, hi = bounds
    if lo is None:
        return F.lit(False)
    x = F.col(c).cast("double")
    out = (x < F.lit(lo)) | (x > F.lit(hi))
    if method != "iqr":
        out = (F.lit(lo) != F.lit(hi)) & out
    return F.coalesce(out, F.lit(False))


def detect_outliers(df: DataFrame, cols, method: str = "zscore", threshold: float = 3.0,
                    exact: bool = True, scope=()) -> DataFrame:
    """CL9 on a frame: ``{col}_outlier`` boolean columns; ``scope``: bounds per e.g. creator."""
    if scope:
        wide, b = scoped_bounds(df, cols, scope, method, threshold)
        return wide.select(*[F.col(f"`{c}`") for c in df.columns], *[outlier_flag(c, b[c], method).alias(f"{c}_outlier") for c in cols])
    b = outlier_bounds(df, cols, method, threshold, exact)
    out = df
    for c in cols:
        out = out.withColumn(f"{c}_outlier", outlier_flag(c, b[c], method))
    return out


def handle_outliers(df: DataFrame, method: str = "iqr", threshold: float = 3.0, action: str = "cap",
                    cols=None, exact: bool = True, scope=()) -> tuple[DataFrame, int]:
    """CL10 cap / CL11 remove / CL12 transform; returns (frame, outliers handled).

    Capped and transformed columns are doubles whatever the data (stable schema).
    ``scope``: bounds per e.g. creator, see :func:`handle_scoped_outliers`.
    """
    cols = [c for c in (C.OUTLIER_COLUMNS if cols is None else cols) if c in df.columns]
    if scope and cols:
        return handle_scoped_outliers(df, cols, scope, method, threshold, action)
    df = write_once(df)  # read by the quantile passes, the counts and the result
    if action == "remove":
        bounds = sequential_bounds(df, cols, method, threshold, exact)
        # a row goes at the first column whose bounds it breaks, so it stays if it keeps all of them
        gone = reduce(lambda a, b: a | b, [outlier_flag(c, bounds[c], method) for c in cols], F.lit(False))
        return df.where(~gone), df.where(gone).count()
    bounds = outlier_bounds(df, cols, method, threshold, exact)
    counts = scalar_stats(df, {c: F.sum(outlier_flag(c, bounds[c], method).cast("long")) for c in cols}) \
        if cols else {}
    out, total = df, 0
    for c in cols:
        n = int(counts.get(c) or 0)
        x = F.col(c).cast("double")
        if action == "cap":
            if n:
                lo, hi = bounds[c]
                if c in C.NON_NEGATIVE_CAP_COLUMNS:
                    lo = max(0.0, lo)
                x = X.clip(x, lo, hi)
                total += n
            out = out.withColumn(c, x)
        elif action == "transform":
            if n and c in C.LOG_TRANSFORM_COLUMNS:
                x = X.log1p(x)
                total += n
            out = out.withColumn(c, x)
    return out, total


MARGIN = 0.05  # share of the rows by which removals may shift a quartile's rank before the brackets are drawn anew


def _possible_bounds(quartiles: dict, threshold: float) -> tuple[tuple, tuple]:
    """(narrowest, widest) bounds while both quartiles stay in their brackets ((q1 from, to), (q3 from, to))."""
    (a, b), (c, d) = quartiles
    corners = [(q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1)) for q1 in (a, b) for q3 in (c, d)]
    low, high = zip(*corners)
    return (max(low), min(high)), (min(low), max(high))


def sequential_bounds(df: DataFrame, cols, method: str = "iqr", threshold: float = 3.0, exact: bool = True) -> dict:
    """{col: (low, high)}, each column's bounds over the rows that earlier columns left (CL11).

    Removing rows shifts the ranks of the others' quartiles a little.  One scan
    gives brackets that hold each quartile for shifts up to ``MARGIN``; rows
    that no bounds from these brackets can remove are summed up in a second
    one, per column: how many lie between brackets, and the values inside with
    their counts.  Only the other rows, the suspects, are written and looked at
    again, once per column, and their remaining ones are added to the sums.  A
    quartile that leaves its bracket starts anew with the rows left then.
    The z-score rule needs means only: one aggregate per column.
    """
    out: dict = {}
    kept = df
    left = list(cols)
    if method != "iqr" or not exact:
        for c in left:
            out[c] = outlier_bounds(kept, [c], method, threshold, exact)[c]
            kept = kept.where(~outlier_flag(c, out[c], method))
        return out
    while left:
        probes = {f"{c}|{k}": (c, p) for c in left for k, p in enumerate((0.25 - MARGIN, 0.25 + MARGIN, 0.75 - MARGIN, 0.75 + MARGIN))}
        near = global_quantiles(kept, probes)
        known = [c for c in left if near[f"{c}|0"] is not None]
        brackets = {c: ((near[f"{c}|0"], near[f"{c}|1"]), (near[f"{c}|2"], near[f"{c}|3"])) for c in known}
        suspect = reduce(lambda a, b: a | b, [outlier_flag(c, _possible_bounds(brackets[c], threshold)[0]) for c in known], F.lit(False))
        rows = kept.select(*[F.col(c).cast("double").alias(c) for c in left], suspect.alias("_suspect"))
        safe = cut_lineage(value_cells(rows.where(~F.col("_suspect")), known, brackets)) if known else None
        suspects = cut_lineage(rows.where("_suspect").drop("_suspect"))
        done = []
        for c in left:
            if c not in known:
                out[c] = (None, None)
            else:
                cells = safe.where(F.col("ci") == known.index(c)).unionByName(
                    value_cells(suspects, [c], brackets).withColumn("ci", F.lit(known.index(c))))
                quartiles = cell_quantiles(cells, (0.25, 0.75))
                if quartiles is None and done:
                    break  # out of the bracket: the bounds found so far hold, the rest starts anew
                if quartiles is None:  # cannot be while no row has gone, save for ties at a bracket's end
                    out[c] = outlier_bounds(kept, [c], method, threshold)[c]
                else:
                    step = threshold * (quartiles[1] - quartiles[0])
                    out[c] = (quartiles[0] - step, quartiles[1] + step)
            done.append(c)
            suspects = suspects.where(~outlier_flag(c, out[c]))
            kept = kept.where(~outlier_flag(c, out[c]))
        left = [c for c in left if c not in done]
    return out


def handle_scoped_outliers(df: DataFrame, cols, scope, method: str = "iqr", threshold: float = 3.0,
                           action: str = "cap") -> tuple[DataFrame, int]:
    """CL10-CL12 with the bounds of each row's scope (a creator's own history).

    Every step is a window over the scope, so all 17 columns share one shuffle;
    a removal's sequential thresholds see the rows that earlier columns left.
    The result is written once: its count of outliers and its rows come from it.
    """
    w, names = Window.partitionBy(*scope), [F.col(f"`{c}`") for c in df.columns]
    if action == "remove":
        out = df.withColumn("_alive", F.lit(True))
        for c in cols:
            out, b = scoped_bounds(out, [c], scope, method, threshold, F.col("_alive"))
            out = out.select(*names, (F.col("_alive") & ~outlier_flag(c, b[c], method)).alias("_alive"))
        out = write_once(out)
        return out.where("_alive").select(*names), out.where(~F.col("_alive")).count()
    wide, b = scoped_bounds(df, cols, scope, method, threshold)
    wide = wide.select("*", *[F.sum(outlier_flag(c, b[c], method).cast("long")).over(w).alias(f"_n_{c}") for c in cols])
    touched = [c for c in cols if action == "cap" or (action == "transform" and c in C.LOG_TRANSFORM_COLUMNS)]

    def handled(c):
        x = F.col(c).cast("double")
        if c not in touched:
            return x
        if action == "transform":
            new = X.log1p(x)
        else:
            lo = F.greatest(F.lit(0.0), b[c][0]) if c in C.NON_NEGATIVE_CAP_COLUMNS else b[c][0]
            new = F.when(x.isNotNull(), F.greatest(lo, F.least(b[c][1], x)))
        return F.when(F.col(f"_n_{c}") > 0, new).otherwise(x)

    flags = sum((outlier_flag(c, b[c], method).cast("long") for c in touched), F.lit(0))
    out = write_once(wide.select(*[handled(c).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns], flags.alias("_flags")))
    return out.select(*names), int(out.agg(F.sum("_flags").alias("n")).first()["n"] or 0)


# CL13-CL18 ------------------------------------------------------------------
def range_violations(df: DataFrame) -> DataFrame:
    """CL13 counts per constrained column (one aggregate)."""
    aggs = []
    for c, lo, hi in C.RANGE_CONSTRAINTS:
        if c in df.columns:
            cond = F.col(c) < lo
            if hi is not None:
                cond = cond | (F.col(c) > hi)
            aggs.append(F.sum(cond.cast("long")).alias(c))
    return df.agg(*aggs) if aggs else df.agg(F.lit(0).alias("none"))


def fix_ranges(df: DataFrame) -> DataFrame:
    """CL13: clip to the fixed business bounds (NULL kept)."""
    out = df
    for c, lo, hi in C.RANGE_CONSTRAINTS:
        if c in df.columns:
            out = out.withColumn(c, X.clip(c, lo, hi).cast(df.schema[c].dataType))
    return out


def normalise_shares(df: DataFrame, all_if_any: bool = False) -> DataFrame:
    """CL14 (B5): rows whose shares are off 1 by > 0.01 are divided by their sum.

    ``all_if_any=True`` is the literal rule: if any row is off, every row with
    a positive sum is normalised.
    """
    if not all(c in df.columns for c in C.SHARE_COLUMNS):
        return df
    s = reduce(lambda a, b: a + b, [F.col(c) for c in C.SHARE_COLUMNS])
    bad = F.abs(s - 1.0) > C.SHARE_SUM_TOLERANCE
    if all_if_any:
        tmp = attach_scope_stats(df, {"_anybad": F.max(bad.cast("int"))}, ())
        cond = (F.col("_anybad") == 1) & (s > 0)
        out = tmp
        for c in C.SHARE_COLUMNS:
            out = out.withColumn(c, F.when(cond, F.col(c) / s).otherwise(F.col(c)))
        return out.drop("_anybad")
    out = df.withColumn("_s", s)
    cond = (F.abs(F.col("_s") - 1.0) > C.SHARE_SUM_TOLERANCE) & (F.col("_s") > 0)
    for c in C.SHARE_COLUMNS:
        out = out.withColumn(c, F.when(cond, F.col(c) / F.col("_s")).otherwise(F.col(c)))
    return out.drop("_s")


def fix_growth_consistency(df: DataFrame, all_if_any: bool = False) -> DataFrame:
    """CL15 (B5): growth := follows - unfollows where off by more than 10."""
    if not all(c in df.columns for c in ("growth", "follows", "unfollows")):
        return df
    calc = F.col("follows") - F.col("unfollows")
    bad = F.abs(F.col("growth") - calc) > C.GROWTH_CONSISTENCY_TOLERANCE
    if all_if_any:
        tmp = attach_scope_stats(df, {"_anybad": F.max(bad.cast("int"))}, ())
        return tmp.withColumn("growth", F.when(F.col("_anybad") == 1, calc).otherwise(F.col("growth"))
                              .cast(df.schema["growth"].dataType)).drop("_anybad")
    return df.withColumn("growth", F.when(bad, calc).otherwise(F.col("growth")).cast(df.schema["growth"].dataType))


def implied_engagement_rate(df: DataFrame) -> Column:
    parts = [F.col(c) for c in ("post_likes", "comments", "saves", "shares") if c in df.columns]
    return X.safe_divide(reduce(lambda a, b: a + b, parts), F.col("reach"))


def fix_rate_consistency(df: DataFrame, all_if_any: bool = False) -> DataFrame:
    """CL16 (B1, B5): engagement_rate := interactions / reach where off by > 0.1."""
    if not all(c in df.columns for c in ("engagement_rate", "post_likes", "reach")):
        return df
    imp = implied_engagement_rate(df)
    bad = F.abs(F.col("engagement_rate") - imp) > C.RATE_CONSISTENCY_TOLERANCE
    if all_if_any:
        tmp = attach_scope_stats(df, {"_anybad": F.max(bad.cast("int"))}, ())
        return tmp.withColumn("engagement_rate", F.when(F.col("_anybad") == 1, imp)
                              .otherwise(F.col("engagement_rate"))).drop("_anybad")
    return df.withColumn("engagement_rate", F.when(F.coalesce(bad, F.lit(False)), imp)
                         .otherwise(F.col("engagement_rate")))


def smooth_series(keys: list, values: np.ndarray, state: list) -> np.ndarray:
    """Smoothed copies of ``values``, rows in order of key and date; ``state`` holds the last (key, smoothed value).

    A missing value has no change and ends the comparison: the next known one stays.
    """
    lim, cap, frac = C.FOLLOWER_JUMP_LIMIT, float(C.FOLLOWER_JUMP_MAX_CHANGE), C.FOLLOWER_JUMP_MAX_FRACTION
    out = values.copy()
    key, prev = state
    for i, (k, cur) in enumerate(zip(keys, values.tolist())):
        if k != key:
            key, prev = k, math.nan
        change = cur - prev  # NaN where either is missing: not a jump
        if abs(change) > lim:
            cur = prev + math.copysign(1.0, change) * min(cap, prev * frac)
            out[i] = cur
        prev = cur
    state[:] = [key, prev]
    return out


def smooth_follower_jumps(df: DataFrame, creator: str = "username", order: str = "date") -> DataFrame:
    """CL17 (B6 applied): a change of more than 50,000 against the previous
    *smoothed* value becomes previous +- min(10,000, 10 % of previous).

    Each task reads its creators' rows in date order as a stream of Arrow
    batches and carries one number from row to row, so time is linear and
    memory is one batch however long a creator's history is.
    """
    if "followers" not in df.columns:
        return df
    at, key_at = df.columns.index("followers"), df.columns.index(creator)
    integral = isinstance(df.schema["followers"].dataType, INTEGRAL)

    def run(batches):
        state = [object(), math.nan]  # no key is equal to this one
        for batch in batches:
            col = batch.column(at)
            values = col.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
            new = smooth_series(batch.column(key_at).to_pylist(), values, state)
            new = pa.array(np.rint(new) if integral else new, from_pandas=True).cast(col.type)
            yield batch.set_column(at, batch.schema.field(at), new)

    # missing dates last (as pandas sorts NaT)
    rows = df.repartition(creator).sortWithinPartitions(creator, F.col(order).asc_nulls_last(), "followers")
    return rows.mapInArrow(run, df.schema)


def validate_and_fix_ranges(df: DataFrame, all_if_any: bool = False, smooth: bool = True) -> DataFrame:
    """CL18 = CL13 + CL14 + (fix_logical_inconsistencies: CL15, CL16, CL17)."""
    out = normalise_shares(fix_ranges(df), all_if_any)
    return fix_logical_inconsistencies(out, all_if_any, smooth)


def fix_logical_inconsistencies(df: DataFrame, all_if_any: bool = False, smooth: bool = True) -> DataFrame:
    out = fix_rate_consistency(fix_growth_consistency(df, all_if_any), all_if_any)
    return smooth_follower_jumps(out) if smooth else out


# CL19 -----------------------------------------------------------------------
def ensure_data_consistency(df: DataFrame, seq_col: str = "seq", keys=("username", "date")) -> DataFrame:
    """Round counts half-even to long, rates to 6 places, keep the last row per key.

    B28: "last" = largest ``seq``; ties (exact copies) or no ``seq`` -> the
    largest row by all columns.  An aggregate, never ``dropDuplicates``.
    """
    return round_columns(dedup_keys(df, seq_col, keys))


def round_columns(df: DataFrame) -> DataFrame:
    """Counts half-even to long, rates half-even to 6 places (numpy rounding)."""
    out = df
    for c in _present(df, C.INT_COLUMNS):
        out = out.withColumn(c, X.round_to_long(c))
    for c in _present(df, C.FLOAT_COLUMNS):
        out = out.withColumn(c, X.round_half_even(c, 6))
    return out


def quarantine(df: DataFrame, keys=("username", "date")) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is complete, the others with a ``reason`` column).

    A row without creator or date cannot be told from its neighbours: it must
    neither be merged with other such rows nor be filled from them.
    """
    keys = [k for k in keys if k in df.columns]
    lost = F.concat_ws(", ", *[F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in keys])
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))
    return df.where(whole), df.where(~whole).withColumn("reason", lost)


def dedup_keys(df: DataFrame, seq_col: str = "seq", keys=("username", "date")) -> DataFrame:
    """Keep one row per complete key: largest ``seq``, then the largest row (an aggregate).

    Rows with a missing key go to :func:`quarantine`.
    """
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df
    df = quarantine(df, keys)[0]
    others = [c for c in df.columns if c not in keys]
    lead = [F.col(seq_col).alias("_seq")] if seq_col in df.columns else []
    best = df.groupBy(*keys).agg(F.max(F.struct(*lead, *[F.col(c) for c in others])).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in others]).select(*df.columns)


# CL20 / CL21 ----------------------------------------------------------------
def clean_engagement_data(df: DataFrame, scope=()) -> DataFrame:
    """Floor 0 for engagement columns; if any rate > 1 (over scope) cap all at 0.5."""
    out = df
    for c in _present(df, C.ENGAGEMENT_CLEAN_COLUMNS):
        out = out.withColumn(c, X.clip(c, 0).cast(df.schema[c].dataType))
    if "engagement_rate" in df.columns:
        out = attach_scope_stats(out, {"_mx": F.max("engagement_rate")}, scope)
        out = out.withColumn("engagement_rate", F.when(F.col("_mx") > 1.0, X.clip("engagement_rate", None, 0.5))
                             .otherwise(F.col("engagement_rate"))).drop("_mx")
    return out


def clean_posting_data(df: DataFrame) -> DataFrame:
    """Floor 0 and caps (posts 10, reels 5, stories 20, ads 5); post time HH:MM."""
    out = df
    for c, cap in C.POSTING_CAPS:
        if c in df.columns:
            out = out.withColumn(c, X.clip(c, 0, cap).cast(df.schema[c].dataType))
    if "post_time" in df.columns:
        out = out.withColumn("post_time", X.standardize_time("post_time"))
    return out


# CL22 -----------------------------------------------------------------------
def clean_raw_data(df: DataFrame, fill_missing: bool = True, handle_outliers_: bool = True,
                   fix_types: bool = True, validate_ranges: bool = True, scope=(),
                   outlier_method: str = "iqr", outlier_action: str = "cap", all_if_any: bool = False,
                   collect_stats: bool = False, dedup_first: bool = True) -> tuple[DataFrame, dict]:
    """types -> missing -> outliers -> ranges -> consistency, with statistics.

    Rows without username or date are quarantined (``quarantine``), not
    filled: the output has unique, complete creator-days.

    ``dedup_first=True`` (engine default) keeps the last row per creator-day
    right after typing, so the sequential steps (forward fill, interpolation,
    follower smoothing) see one row per creator-day: a creator's window is
    bounded by the calendar even if one key is massively duplicated.  The
    statistics of later steps then count a duplicated day once (the
    reference, which de-duplicates last, counts it twice).  ``False`` keeps
    the reference order.
    """
    stats = {"original_columns": len(df.columns)}
    out = df
    if fix_types:
        out, stats["data_type_fixes"] = fix_data_types(out)
    if collect_stats:
        stats["quarantined_rows"] = quarantine(out)[1].count()
    if dedup_first:
        out = dedup_keys(out)
    else:
        out = quarantine(out)[0]
    if fill_missing:
        before = write_once(out) if collect_stats else out
        out = handle_missing_values(before, scope)
        if collect_stats:
            stats["missing_values_handled"] = missing_handled(before, out)
    if handle_outliers_:
        out, stats["outliers_handled"] = handle_outliers(out, outlier_method, action=outlier_action, scope=scope)
    if validate_ranges:
        if collect_stats:
            viol = range_violations(out).collect()[0].asDict()
            stats["range_violations_fixed"] = int(sum(v or 0 for v in viol.values()))
        out = validate_and_fix_ranges(out, all_if_any, smooth=dedup_first)
    out = round_columns(out) if dedup_first else ensure_data_consistency(out)
    if validate_ranges and not dedup_first:
        out = smooth_follower_jumps(out)
    if collect_stats:
        stats["original_rows"] = df.count()
        keys = [k for k in ("username", "date") if k in out.columns]
        rows = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*keys).alias("k")).first() if keys else None
        if rows and rows["n"] != rows["k"]:
            raise RuntimeError(f"cleaning left {rows['n'] - rows['k']} rows with a repeated or missing creator-day")
        stats["final_rows"] = rows["n"] if rows else out.count()
    return out, stats
