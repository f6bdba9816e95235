"""Scope statistics: one-pass aggregates, exact distributed quantiles, safe corr.

``scope=()`` means "over the whole table" (what the single-creator reference
does on its frame); ``scope=('username',)`` means per creator.

Exact quantiles at scale
------------------------
Spark's ``percentile`` keeps a value->count map per group; over a whole
100 TB column of doubles that map is as big as the column and is merged in
one task.  For whole-table scope we therefore run an exact *distributed
selection* over (column, value) pairs, which are never stored: narrow code
whatever the number of columns.  One aggregate per column gives its count and
range.  An interval that holds at most ``TASK_MAX`` values is ranked by a window
``row_number``; for a column with more, an approximate bracket around each
wanted quantile is taken, what lies below and inside it is counted exactly, and
only the values inside are shipped and ranked.
A bracket that holds more than ``TASK_MAX`` values is first narrowed by
histogram passes (``B`` equal-width buckets each); a bracket that misses its
rank is widened to the column's range.  The driver only ever sees brackets,
histogram rows and the wanted order statistics; no task sorts more than
``TASK_MAX`` values.  Linear interpolation between order statistics
``floor(h)`` and ``ceil(h)``, ``h = (n-1) p`` (numpy / pandas / Spark
``percentile`` / DuckDB ``quantile_cont`` all agree).

Per-creator scope uses Spark's ``percentile`` per group: a group is one
creator's history (one row per day), bounded by the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1024
BRACKET = 0.002        # half width of an approximate bracket, as a share of the rows
ACCURACY = 2000        # of the approximate percentiles: error 1 / ACCURACY, well inside BRACKET
TASK_MAX = 5_000_000  # values one task may sort in the final selection step


# ---------------------------------------------------------------------------
# generic scope statistics (mean, max, std, ...)
# ---------------------------------------------------------------------------
def attach_scope_stats(df: DataFrame, stats: dict[str, Column], scope=()) -> DataFrame:
    """Add aggregate columns computed over ``scope`` to every row.

    Whole table: a one-row aggregate, collected and inlined as literals (no
    join is planned; the row count is one by construction).  Per scope key: a window aggregate
    partitioned by the key, so no join and no extra shuffle when the frame is
    already partitioned by it.
    """
    scope = list(scope or ())
    if not scope:
        return attach_row(df, df.agg(*[e.alias(n) for n, e in stats.items()]))
    w = Window.partitionBy(*scope)
    out = df
    for n, e in stats.items():
        out = out.withColumn(n, e.over(w))
    return out


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row statistics frame to every row of ``df`` as
    literals: the row is collected (exactly one row, proven by construction:
    a global aggregate) and inlined, so no join of any kind is planned."""
    rows = one.collect()
    if len(rows) != 1:
        raise ValueError(f"attach_row expects exactly one row, got {len(rows)}")
    r = rows[0]
    return df.select("*", *[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in one.schema.fields])


def attach_scalars(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row statistics frame to every row of ``df`` as scalar subqueries: no job of its
    own, and a statistic that no later step reads is not computed."""
    return df.select("*", *[one.select(c).scalar().alias(c) for c in one.columns])


def merge_rows(*ones: DataFrame) -> DataFrame:
    """Several one-row frames side by side as one one-row frame (collected, no join)."""
    rows = [o.collect() for o in ones]
    if any(len(r) != 1 for r in rows):
        raise ValueError("merge_rows expects one row per frame")
    fields = [f for o in ones for f in o.schema.fields]
    values = tuple(v for r in rows for v in r[0])
    return ones[0].sparkSession.createDataFrame([values], T.StructType(fields))


def scalar_stats(df: DataFrame, stats: dict[str, Column]) -> dict:
    """Eager one-row aggregate -> python dict (used as literals afterwards)."""
    row = df.agg(*[e.alias(n) for n, e in stats.items()]).collect()[0]
    return row.asDict()


# ---------------------------------------------------------------------------
# quantiles
# ---------------------------------------------------------------------------
def _ranks(n: int, p: float):
    h = (n - 1) * p
    lo = int(math.floor(h))
    hi = int(math.ceil(h))
    return h, lo, min(hi, n - 1)


_PROBE = "ci int, pid int, lo double, hi double"


def _long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    """(ci, v): the non-missing values of the columns, infinities included."""
    items = F.array(*[F.struct(F.lit(i).alias("ci"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])
    return df.select(F.explode(items).alias("x")).select("x.ci", "x.v").where(F.col("v").isNotNull() & ~F.isnan("v"))


def _probed(long: DataFrame, probes: list[tuple]) -> DataFrame:
    """Every value beside each probe of its column (a handful of rows, as many as were asked for)."""
    table = long.sparkSession.createDataFrame([(ci, j, float(lo), float(hi)) for j, (ci, lo, hi, *_) in enumerate(probes)], _PROBE)
    return long.join(F.broadcast(table), "ci")


def exact_order_statistics(long: DataFrame, probes: list[tuple]) -> dict:
    """k-th smallest finite values by distributed selection.

    A probe is (column index, lo, hi, values below lo, values inside, wanted
    0-based ranks).  Returns {(column index, k): value}.  A round is one job:
    intervals holding at most ``TASK_MAX`` values are ranked by a window
    partitioned per interval (only the wanted ranks come back); larger ones
    are histogrammed and narrowed to the bucket of the rank.
    """
    spark = long.sparkSession
    result: dict = {}
    while True:  # every pass shrinks each open interval to one bucket's own smallest and largest value
        result |= {(ci, k): lo for ci, lo, hi, _, _, ks in probes if lo == hi for k in ks}  # one value left
        probes = [pr for pr in probes if pr[1] != pr[2]]
        if not probes:
            return result
        hits = _probed(long, probes).where(F.col("v").between(F.col("lo"), F.col("hi")))
        small = [j for j, pr in enumerate(probes) if pr[4] <= TASK_MAX]
        big = [j for j, pr in enumerate(probes) if pr[4] > TASK_MAX]
        if small:
            want = spark.createDataFrame([(j, k - probes[j][3], k) for j in small for k in probes[j][5]], "pid int, rn int, k int")
            ranked = (hits.where(F.col("pid").isin(small))
                      .withColumn("rn", F.row_number().over(Window.partitionBy("pid").orderBy("v")) - 1))
            for r in ranked.join(F.broadcast(want), ["pid", "rn"]).select("pid", "k", "v").collect():
                result[(probes[r["pid"]][0], r["k"])] = r["v"]
        if not big:
            return result
        # halves: the width of an interval may exceed the largest double
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        hist = (hits.where(F.col("pid").isin(big)).withColumn("b", bucket).groupBy("pid", "b")
                .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx")).collect())
        per: dict = {}
        for r in hist:
            per.setdefault(r["pid"], []).append((r["b"], r["n"], r["mn"], r["mx"]))
        nxt = []
        for j in big:
            ci, _, _, cum, _, ks = probes[j]
            for _, n, mn, mx in sorted(per.get(j, [])):
                inside = [k for k in ks if cum <= k < cum + n]
                if inside:
                    nxt.append((ci, float(mn), float(mx), cum, int(n), inside))
                cum += n
        probes = nxt


def _brackets(long: DataFrame, targets: dict[tuple, set], ends: dict) -> list[tuple]:
    """Probes for {(column index, p): ranks}: approximate brackets with exact counts, the whole range where they miss."""
    whole = lambda ci, ks: (ci, ends[ci]["mn"], ends[ci]["mx"], 0, ends[ci]["n"], sorted(ks))
    probes = [whole(ci, ks) for (ci, _), ks in targets.items() if ends[ci]["n"] <= TASK_MAX]  # one task can rank these as they are
    large = {t: ks for t, ks in targets.items() if ends[t[0]]["n"] > TASK_MAX}
    if not large:
        return probes
    ps = sorted({p for _, p in large})
    around = [min(1.0, max(0.0, p + d)) for p in ps for d in (-BRACKET, BRACKET)]
    near = {r["ci"]: dict(zip(ps, zip(r["q"][::2], r["q"][1::2]))) for r in
            long.where(F.col("ci").isin(sorted({ci for ci, _ in large}))).groupBy("ci")
            .agg(F.percentile_approx("v", around, ACCURACY).alias("q")).collect()}
    cells = [(ci, *near[ci][p], sorted(ks)) for (ci, p), ks in large.items()]
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    counts = {r["pid"]: r for r in _probed(long, cells).groupBy("pid").agg(
        F.count(F.when(v < lo, 1)).alias("below"), F.count(F.when(v.between(lo, hi), 1)).alias("inside")).collect()}
    for j, (ci, lo, hi, ks) in enumerate(cells):
        below, inside = counts[j]["below"], counts[j]["inside"]
        caught = [k for k in ks if below <= k < below + inside]
        if caught:
            probes.append((ci, lo, hi, below, inside, caught))
        if len(caught) < len(ks):
            probes.append(whole(ci, [k for k in ks if k not in caught]))
    return probes


def _segments(brackets: list[tuple]) -> list[float]:
    """Edges lo, hi, lo, hi, ... of disjoint brackets, overlapping ones joined."""
    edges: list[float] = []
    for lo, hi in sorted(brackets):
        if edges and lo <= edges[-1]:
            edges[-1] = max(edges[-1], hi)
        else:
            edges += [lo, hi]
    return edges


def _cells(numbers: DataFrame, edges: dict[int, list]) -> DataFrame:
    """(ci, s, x, n): values between two brackets counted as one (x NULL), those inside by value."""
    most = max(len(e) for e in edges.values())
    table = numbers.sparkSession.createDataFrame([(ci, [float(x) for x in e]) for ci, e in edges.items()], "ci int, edges array<double>")
    at = numbers.join(F.broadcast(table), "ci")  # one row per column
    edge = lambda j: F.get(F.col("edges"), j)
    passed = [F.coalesce((F.col("v") >= edge(j)) if j % 2 == 0 else (F.col("v") > edge(j)), F.lit(False)).cast("int") for j in range(most)]
    cells = at.select("ci", "v", sum(passed[1:], passed[0]).alias("s")).select("ci", "s", F.when(F.col("s") % 2 == 1, F.col("v")).alias("x"))
    return cells.groupBy("ci", "s", "x").agg(F.count(F.lit(1)).alias("n"))


def value_cells(df: DataFrame, cols: list[str], brackets: dict[str, tuple]) -> DataFrame:
    """Mergeable summary (ci, s, x, n) of the columns around their brackets, in one pass."""
    return _cells(_long_form(df, cols), {i: _segments(list(brackets[c])) for i, c in enumerate(cols)})


def cell_quantiles(cells: DataFrame, ps) -> list | None:
    """Interpolated quantiles of one column from (parts of) its summary; None where one lies between brackets."""
    counts = cells.groupBy("ci", "s", "x").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("ci").orderBy("s", "x")
    running = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("ci")))
    h = [(F.col("all") - 1) * F.lit(float(p)) for p in ps]
    ranks = F.array(*[f(x) for x in h for f in (F.floor, F.ceil)])
    hit = F.filter(F.transform(ranks, lambda k, i: F.struct(i.alias("i"), k.alias("k"))),
                   lambda r: (r["k"] >= F.col("upto") - F.col("n")) & (r["k"] < F.col("upto")))
    got = {}
    for r in running.select("x", "all", hit.alias("hit")).where(F.size("hit") > 0).collect():  # two per quantile at most
        for h_ in r["hit"]:
            got[h_["i"]] = (r["x"], r["all"])
    if len(got) < 2 * len(ps) or any(x is None for x, _ in got.values()):
        return None
    out = []
    for j, p in enumerate(ps):
        (a, n), (b, _) = got[2 * j], got[2 * j + 1]
        place = (n - 1) * float(p)
        out.append(interpolate((a, b, place - math.floor(place))))
    return out


def bracketed_ranks(numbers: DataFrame, brackets: dict[int, list[tuple]], wanted: dict[int, set]) -> tuple[dict, dict]:
    """({(column index, k): k-th smallest value}, ranks that lie outside of their column's brackets).

    One pass: values between two brackets are counted as one, those inside by
    value, so a value that many rows share is combined before the shuffle.
    A running count per column over these few rows meets the wanted ranks.
    """
    spark = numbers.sparkSession
    counts = _cells(numbers, {ci: _segments(b) for ci, b in brackets.items()})
    w = Window.partitionBy("ci").orderBy("s", "x")
    running = counts.withColumn("upto", F.sum("n").over(w)).withColumn("before", F.col("upto") - F.col("n"))
    ranks = spark.createDataFrame([(ci, sorted(ks)) for ci, ks in wanted.items()], "ci int, ks array<long>")
    hits = (running.join(F.broadcast(ranks), "ci").withColumn("hit", F.filter("ks", lambda k: (k >= F.col("before")) & (k < F.col("upto"))))
            .where(F.size("hit") > 0).select("ci", "x", "hit").collect())  # one row per wanted rank at most
    found, missed = {}, {}
    for r in hits:
        for k in r["hit"]:
            if r["x"] is None:
                missed.setdefault(r["ci"], set()).add(k)
            else:
                found[(r["ci"], k)] = r["x"]
    return found, missed


def global_order_stats(df: DataFrame, specs: dict[str, tuple]) -> dict:
    """{name: (column, p)} -> {name: (a, b, frac)} with quantile = a + frac (b - a).

    ``a``/``b`` are the bracketing order statistics, so a caller can apply a
    monotone map (e.g. a clip) before interpolating.  None if no value.  NULL
    and NaN do not count; infinities stand at the ends.

    Two passes over the columns: one aggregate gives counts, ends and an
    approximate bracket around every quantile, the next finds the exact values
    (:func:`bracketed_ranks`).  Columns whose brackets hold more values than
    one task may rank are narrowed further (:func:`exact_order_statistics`).
    """
    cols = sorted({c for c, _ in specs.values()})
    if not cols:
        return {}
    inf = math.inf
    idx = {c: i for i, c in enumerate(cols)}
    long = _long_form(df.select(*[F.col(c) for c in cols]), cols)
    finite = F.when(F.abs("v") < inf, F.col("v"))
    points = sorted({min(1.0, max(0.0, float(p) + d)) for _, p in specs.values() for d in (-BRACKET, BRACKET)})
    ends = {i: {"n": 0, "low": 0, "high": 0} for i in range(len(cols))}
    for r in long.groupBy("ci").agg(
            F.count(finite).alias("n"), F.min(finite).alias("mn"), F.max(finite).alias("mx"), F.percentile_approx(finite, points, ACCURACY).alias("near"),
            F.count(F.when(F.col("v") == -inf, 1)).alias("low"), F.count(F.when(F.col("v") == inf, 1)).alias("high")).collect():
        ends[r["ci"]] = r.asDict()
    targets: dict = {}
    plan, got = {}, {}
    for name, (c, p) in specs.items():
        ci, p = idx[c], float(p)
        n, low, high = (ends[ci][k] for k in ("n", "low", "high"))
        if not n + low + high:
            plan[name] = None
            continue
        h, lo, hi = _ranks(n + low + high, p)
        for k in (lo, hi):  # infinities stand at the ends; only ranks between them need a search
            if k < low or k >= low + n:
                got[(ci, k)] = -inf if k < low else inf
            else:
                targets.setdefault((ci, p), set()).add(k - low)
        plan[name] = (ci, h, lo, hi)
    numbers = long.where(F.abs("v") < inf)
    brackets: dict = {}
    wanted: dict = {}
    for (ci, p), ks in targets.items():
        near = dict(zip(points, ends[ci]["near"]))
        lo, hi = near[max(0.0, p - BRACKET)], near[min(1.0, p + BRACKET)]
        if ends[ci]["n"] * 4 * BRACKET * len(specs) <= TASK_MAX * len(cols):
            # the ends of a column are exact: infinities shift the wanted ranks past an approximate end
            brackets.setdefault(ci, []).append((ends[ci]["mn"] if p <= BRACKET else lo, ends[ci]["mx"] if p >= 1 - BRACKET else hi))
            wanted.setdefault(ci, set()).update(ks)
    if brackets:
        found, missed = bracketed_ranks(numbers, brackets, wanted)
        got |= {(ci, k + ends[ci]["low"]): v for (ci, k), v in found.items()}
        left = {t: {k for k in ks if k in missed.get(t[0], ())} for t, ks in targets.items() if t[0] in brackets}
        targets = {t: ks for t, ks in targets.items() if t[0] not in brackets} | {t: ks for t, ks in left.items() if ks}
    if targets:
        found = exact_order_statistics(numbers, _brackets(numbers, targets, ends))
        got |= {(ci, k + ends[ci]["low"]): v for (ci, k), v in found.items()}
    return {name: (None if pl is None else (got[(pl[0], pl[2])], got[(pl[0], pl[3])], pl[1] - pl[2]))
            for name, pl in plan.items()}


def interpolate(stat) -> float | None:
    if stat is None:
        return None
    a, b, f = stat
    return a if f == 0 or a == b else a + f * (b - a)


def global_quantiles(df: DataFrame, specs: dict[str, tuple], exact: bool = True,
                     accuracy: int = 100000) -> dict:
    """{name: (column, p)} -> {name: value} over the whole table (eager).

    Columns with no non-NULL value give None.
    """
    if exact:
        return {k: interpolate(v) for k, v in global_order_stats(df, specs).items()}
    if not specs:
        return {}
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), float(p), accuracy).alias(n)
                   for n, (c, p) in specs.items()]).collect()[0]
    return row.asDict()


def scoped_quantiles(df: DataFrame, specs: dict[str, tuple], scope) -> DataFrame:
    """Adds a double column ``name`` per {name: (column, p)}: the exact quantile over the row's scope.

    One window aggregate over all columns, partitioned by the scope like the
    row-neighbour windows, so no join and no sort of its own; a scope (a
    creator's history) is bounded by the calendar.  NULL where a scope has no
    value; NaN does not count.
    """
    if not specs:
        return df
    w = Window.partitionBy(*scope)
    wanted: dict[str, list] = {}
    for name, (c, p) in specs.items():
        wanted.setdefault(c, []).append((float(p), name))
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    lists = {c: F.percentile(number(c), F.array(*[F.lit(p) for p, _ in ps])).over(w).alias(f"_qs_{i}") for i, (c, ps) in enumerate(wanted.items())}
    wide = df.select("*", *lists.values())
    return wide.select(*[F.col(f"`{c}`") for c in df.columns],
                       *[F.col(f"_qs_{i}")[j].alias(name) for i, ps in enumerate(wanted.values()) for j, (_, name) in enumerate(ps)])


# ---------------------------------------------------------------------------
# correlation (T2: never raises, zero variance -> NULL)
# ---------------------------------------------------------------------------
def corr_expr(x, y) -> Column:
    """Pearson r from population moments over pairwise-complete rows."""
    x, y = F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    xx = F.when(both, x.cast("double"))
    yy = F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))
