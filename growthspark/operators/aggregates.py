"""Remaining aggregations: AG8 percentiles, AG9 correlation matrices, AG10
confidence interval, AG11 growth metrics, AG13 arg-min / arg-max, CAT3 summary.

Pearson pairs come from one aggregate of population moments (T2: no raise
on zero variance).  Spearman ranks use distributed average ranks of the
*distinct* values (ties combined map-side, offsets from range partitions) --
no single-partition sort.  Kendall's tau counts inversions in n log n: inside
bounded ranges of either column, and between ranges as a smaller problem of
the same kind; no pairs are made.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.stats import corr_expr, global_quantiles
from ..session import cut_lineage
from .diagnostics import counts_before


# AG8 ------------------------------------------------------------------------
def percentiles(df: DataFrame, col: str, probs=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Linear-interpolation percentiles (exact distributed selection)."""
    q = global_quantiles(df, {f"p{i}": (col, p) for i, p in enumerate(probs)})
    return df.sparkSession.createDataFrame([(float(p), q[f"p{i}"]) for i, p in enumerate(probs)],
                                           "p double, value double")


# AG9 ------------------------------------------------------------------------
def pearson_matrix(df: DataFrame, cols: list) -> DataFrame:
    """All pairs in ONE aggregate (pairwise-complete rows), long form (a, b, r)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*[corr_expr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).collect()[0]
    out = []
    for i, (a, b) in enumerate(pairs):
        out.append((a, b, row[f"r{i}"]))
        if a != b:
            out.append((b, a, row[f"r{i}"]))
    return df.sparkSession.createDataFrame(out, "feature_a string, feature_b string, correlation double")


def average_ranks(df: DataFrame, col: str, key_cols: list) -> DataFrame:
    """Average rank (ties share the mean rank) of ``col`` joined back to ``key_cols``."""
    d = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c"))
    r = counts_before(d, col, "_c").select(col, (F.col("_before") + (F.col("_c") + 1) / 2.0).alias(f"{col}_rank"))
    return df.select(*key_cols, col).join(r, col, "left")


def spearman_matrix(df: DataFrame, cols: list, key_cols: list) -> DataFrame:
    """Pearson of average ranks; each column ranked by the distributed method."""
    ranked = df.select(*key_cols)
    for c in cols:
        ranked = ranked.join(average_ranks(df, c, key_cols).drop(c), key_cols, "left")
    return pearson_matrix(ranked, [f"{c}_rank" for c in cols]).select(
        F.regexp_replace("feature_a", "_rank$", "").alias("feature_a"),
        F.regexp_replace("feature_b", "_rank$", "").alias("feature_b"), "correlation")


RANGE_POINTS = 1 << 18  # distinct points of one inversion-counting group: half of its most, and the size of the last problem


def inversions(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> int:
    """Sum of c_i c_j over the pairs with x_i < x_j and y_i > y_j.

    Level by level over the bits of y's ranks: two points whose ranks first
    differ in a bit lie in one group of equal higher bits, and are inverted if
    the one with the bit set comes earlier.
    """
    _, x = np.unique(x, return_inverse=True)
    _, y = np.unique(y, return_inverse=True)
    if int(c.sum()) >= 1 << 31:
        c = c.astype(object)  # their products pass a long: Python's integers
    order = np.argsort(x, kind="stable")
    x, y, c = x[order], y[order], c[order]
    total = 0
    for bit in range(int(y.max(initial=0)).bit_length()):
        by = np.argsort(y >> (bit + 1), kind="stable")  # groups of equal higher bits, each in order of x
        group, gx, high = y[by] >> (bit + 1), x[by], (y[by] >> bit) & 1
        gc = c[by]
        seen = np.concatenate(([0], np.cumsum(gc * high)))
        # of each run of equal (group, x): what was seen before the run, less what was seen before the group
        new_run = np.append(True, (group[1:] != group[:-1]) | (gx[1:] != gx[:-1]))
        new_group = np.append(True, group[1:] != group[:-1])
        before_run = seen[np.flatnonzero(new_run)[np.cumsum(new_run) - 1]]
        before_group = seen[np.flatnonzero(new_group)[np.cumsum(new_group) - 1]]
        total += int((gc * (1 - high) * (before_run - before_group)).sum())
    return total


def _inversions_of(first: str):
    def run(key, table):
        n = inversions(table.column(first).to_numpy(), table.column("y").to_numpy(), table.column("c").to_numpy())
        return pa.table({"pair": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([str(n)])})
    return run


def _add_ranges(points: DataFrame, col: str, size: int) -> DataFrame:
    """``{col}_range``: order-keeping ranges of about ``size`` points (twice that at most) per pair.

    A value with ``size`` points or more has a range of its own, with an odd
    number; it holds no inversion, so such ranges need no counting.
    """
    values = points.groupBy("pair", col).agg(F.count(F.lit(1)).alias("m"))
    r = cut_lineage(values.repartitionByRange("pair", col).withColumn("pid", F.spark_partition_id()))
    totals = r.groupBy("pair", "pid").agg(F.sum("m").alias("t"))
    earlier = Window.partitionBy("pair").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition and pair
    offsets = totals.select("pair", "pid", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("off"))
    local = Window.partitionBy("pair", "pid").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("off") + F.coalesce(F.sum("m").over(local), F.lit(0))
    number = F.floor(before / size) * 2 + (F.col("m") >= size).cast("long")
    ranged = cut_lineage(r.join(F.broadcast(offsets), ["pair", "pid"]).select("pair", col, number.alias(f"{col}_range")))
    return points.join(ranged, ["pair", col])  # written: a value with many points is a skewed join that Spark can split


def discordant_pairs(points: DataFrame, size: int = RANGE_POINTS) -> dict[int, int]:
    """{pair: number of discordant pairs} of distinct points (pair, x, y) with counts c.

    Both columns are cut into ranges.  Inversions within a range of x are
    counted in one group, those across ranges of x but within a range of y in
    another, and those across both are the inversions of the table of range
    numbers, which is smaller and treated alike until one group holds it.
    """
    out: dict[int, int] = {}

    def add(counted: DataFrame):
        for r in counted.groupBy("pair").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
            out[r["pair"]] = out.get(r["pair"], 0) + int(r["n"])

    schema = "pair int, n string"
    while True:
        points = cut_lineage(points)
        most = points.groupBy("pair").count().agg(F.max("count")).first()[0] or 0
        if most <= size:
            add(points.groupBy("pair").applyInArrow(_inversions_of("x"), schema))
            return out
        wide = max(size, 2 * math.isqrt(most) + 2)  # so the table of range numbers has a quarter of the points at most
        both = cut_lineage(_add_ranges(_add_ranges(points, "x", wide), "y", wide))
        add(both.where("x_range % 2 = 0").groupBy("pair", "x_range").applyInArrow(_inversions_of("x"), schema))
        add(both.where("y_range % 2 = 0").groupBy("pair", "y_range").applyInArrow(_inversions_of("x_range"), schema))
        points = both.groupBy("pair", "x_range", "y_range").agg(F.sum("c").alias("c")).select(
            "pair", F.col("x_range").cast("double").alias("x"), F.col("y_range").cast("double").alias("y"), "c")


def kendall_matrix(df: DataFrame, cols: list, size: int = RANGE_POINTS) -> DataFrame:
    """Kendall's tau-b of all pairs over pairwise-complete rows, long form (a, b, tau).

    NULL where a column has one value only or no rows are complete.  Equal
    points are counted together first; all pairs share each job.
    """
    pairs = list(combinations_with_replacement(cols, 2))
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + F.lit(0.0))
    items = F.array(*[F.struct(F.lit(i).alias("pair"), value(a).alias("x"), value(b).alias("y")) for i, (a, b) in enumerate(pairs) if a != b])
    rows = df.select(F.explode(items).alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL")
    points = cut_lineage(rows.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("c")))
    twos = lambda n: (F.col(n).cast("decimal(38,0)") * (F.col(n) - 1)) / 2
    ties = lambda keys: {r["pair"]: (int(r["n"]), int(r["t"])) for r in points.groupBy("pair", *keys).agg(F.sum("c").alias("k"))
                         .groupBy("pair").agg(F.sum("k").alias("n"), F.sum(twos("k")).alias("t")).collect()}
    in_x, in_y, in_both = ties(["x"]), ties(["y"]), ties(["x", "y"])
    discordant = discordant_pairs(points, size)
    out = []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            constant = df.agg(F.min(value(a)).alias("lo"), F.max(value(a)).alias("hi")).first()
            out.append((a, a, 1.0 if constant["lo"] != constant["hi"] else None))
            continue
        n, tx = in_x.get(i, (0, 0))
        ty, txy = in_y.get(i, (0, 0))[1], in_both.get(i, (0, 0))[1]
        all_pairs = n * (n - 1) // 2
        free = (all_pairs - tx) * (all_pairs - ty)
        tau = (all_pairs - tx - ty + txy - 2 * discordant.get(i, 0)) / math.sqrt(free) if free else None
        out += [(a, b, tau), (b, a, tau)]
    return df.sparkSession.createDataFrame(out, "feature_a string, feature_b string, correlation double")


# AG10 -----------------------------------------------------------------------
def confidence_interval(df: DataFrame, col: str, level: float = 0.95) -> DataFrame:
    """mean +- t((1+level)/2, n-1) * s / sqrt(n)."""
    st = df.agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s"), F.count(col).alias("n")).collect()[0]
    n, m, s = st["n"], st["m"], st["s"]
    if not n or n < 2 or s is None:
        lo = hi = m
    else:
        h = dist.t_ppf((1 + level) / 2, n - 1) * s / (n ** 0.5)
        lo, hi = m - h, m + h
    return df.sparkSession.createDataFrame([(m, lo, hi, int(n or 0))], "mean double, lower double, upper double, n long")


# AG11 -----------------------------------------------------------------------
def growth_metrics(df: DataFrame, value: str = "followers", creator: str = "username", order: str = "date") -> DataFrame:
    """Per creator: total change, mean step, compound rate (last/first)^(1/k) - 1
    (B13: only when the first value is positive), population std of the steps, periods."""
    w = Window.partitionBy(creator).orderBy(order)
    d = df.select(creator, order, F.col(value).cast("double").alias("v")).withColumn(
        "step", F.col("v") - F.lag("v").over(w))
    g = d.groupBy(creator).agg(F.min_by("v", order).alias("first_value"), F.max_by("v", order).alias("last_value"),
                               F.avg("step").alias("average_change"), F.stddev_pop("step").alias("volatility"),
                               F.count(F.lit(1)).alias("periods"))
    k = F.col("periods") - 1
    cagr = F.when((F.col("first_value") > 0) & (k > 0),
                  F.pow(F.col("last_value") / F.col("first_value"), 1.0 / k) - 1).otherwise(F.lit(0.0))
    return g.select(creator, (F.col("last_value") - F.col("first_value")).alias("total_growth"), "average_change",
                    cagr.alias("growth_rate"), "volatility", "periods")


# AG13 -----------------------------------------------------------------------
def best_worst(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.agg(F.min_by(key, value).alias("best"), F.max_by(key, value).alias("worst"),
                  (F.max(value) - F.min(value)).alias("range"))


# CAT3 -----------------------------------------------------------------------
def data_summary(df: DataFrame) -> DataFrame:
    """Per numeric column: count, nulls, mean, sample std, min, q25, median, q75, max (describe, long form)."""
    num = [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "double", "short", "float")]
    q = global_quantiles(df, {f"{c}|{p}": (c, p) for c in num for p in (0.25, 0.5, 0.75)})
    aggs = []
    for i, c in enumerate(num):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.sum(x.isNull().cast("long")).alias(f"z{i}"), F.avg(x).alias(f"a{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
    one = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"z{i}").alias("nulls"),
                      F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"mn{i}").alias("min"),
                      F.lit(q[f"{c}|0.25"]).cast("double").alias("q25"), F.lit(q[f"{c}|0.5"]).cast("double").alias("q50"),
                      F.lit(q[f"{c}|0.75"]).cast("double").alias("q75"), F.col(f"mx{i}").alias("max"))
             for i, c in enumerate(num)]
    return one.select(F.explode(F.array(*items)).alias("x")).select("x.*")
