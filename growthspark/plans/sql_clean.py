"""DuckDB restatements of the cleaning steps, as CTE generators.

Each ``step_*`` takes a source CTE name and a target name and returns the CTE
text; ``cols`` tracks the (name, kind) of the frame so statistics are only
taken on columns that exist.  Written in window/group-by SQL, independently
of the Spark implementation.
"""

from __future__ import annotations

from .. import config as C
from ..sources.fixtures import F3_COLUMNS
from .sqlparts import clip_sql, sdiv

F3_INT = [c for c in F3_COLUMNS if c in C.INT_COLUMNS]
F3_FLOAT = [c for c in F3_COLUMNS if c in C.FLOAT_COLUMNS]
F3_NUMERIC = F3_INT + F3_FLOAT + ["seq"]
F3_OUTLIER = [c for c in C.OUTLIER_COLUMNS if c in F3_COLUMNS]


def typed(src: str = "f3", name: str = "f3t") -> str:
    return (f"{name} AS (SELECT * REPLACE (CAST(try_strptime(TRIM(date), '%d-%m-%Y') AS DATE) AS date) "
            f"FROM {src})")


def dedup(src: str, name: str) -> str:
    """Last row per complete key: largest seq, then the largest row (NULL smallest), column by column."""
    order = ", ".join(["seq DESC"] + [f"{c} DESC NULLS LAST" for c in F3_COLUMNS if c not in ("username", "date")])
    return (f"{name} AS (SELECT * EXCLUDE (_rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY username, date "
            f"ORDER BY {order}) AS _rn FROM {src} WHERE username IS NOT NULL AND date IS NOT NULL) x WHERE _rn = 1)")


def missing(src: str, name: str) -> str:
    """CL1 ffill, CL2 zero, CL3 mean, CL4 mode, CL7 remaining numeric -> 0."""
    a = f"{name}_a"
    parts = [f"{a} AS (SELECT * REPLACE (last_value(followers IGNORE NULLS) OVER (PARTITION BY username ORDER BY "
             f"date NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS followers) FROM {src})"]
    zero = [c for c in C.ZERO_FILL_COLUMNS if c in F3_COLUMNS]
    means = [c for c in C.MEAN_FILL_COLUMNS if c in F3_COLUMNS]
    rep = [f"COALESCE({c}, 0) AS {c}" for c in zero]
    rep += [f"COALESCE({c}, (SELECT AVG({c}) FROM {a})) AS {c}" for c in means]
    rep += [f"COALESCE(post_time, (SELECT post_time FROM (SELECT post_time, COUNT(*) AS k FROM {a} WHERE post_time "
            f"IS NOT NULL GROUP BY post_time) m ORDER BY k DESC, post_time LIMIT 1)) AS post_time"]
    b = f"{name}_b"
    parts.append(f"{b} AS (SELECT * REPLACE ({', '.join(rep)}) FROM {a})")
    rest = [f"COALESCE({c}, 0) AS {c}" for c in F3_NUMERIC if c not in zero and c not in means]
    parts.append(f"{name} AS (SELECT * REPLACE ({', '.join(rest)}) FROM {b})")
    return ",\n".join(parts)


def bounds_cte(src: str, name: str, cols, method: str = "iqr", t: float = 3.0, by: str = "") -> str:
    sel = []
    for c in cols:
        if method == "iqr":
            q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
            sel.append(f"{q1} - {t} * ({q3} - {q1}) AS {c}_lo, {q3} + {t} * ({q3} - {q1}) AS {c}_hi")
        else:
            m, s = f"AVG(CAST({c} AS DOUBLE))", f"STDDEV_SAMP(CAST({c} AS DOUBLE))"
            sel.append(f"{m} - {t} * {s} AS {c}_lo, {m} + {t} * {s} AS {c}_hi")
    if by:
        return f"{name} AS (SELECT {by}, {', '.join(sel)} FROM {src} GROUP BY {by})"
    return f"{name} AS (SELECT {', '.join(sel)} FROM {src})"


def flag_sql(c: str, b: str, method: str = "iqr") -> str:
    cond = f"(CAST({c} AS DOUBLE) < {b}.{c}_lo OR CAST({c} AS DOUBLE) > {b}.{c}_hi)"
    if method != "iqr":
        cond = f"({b}.{c}_lo <> {b}.{c}_hi AND {cond})"
    return f"COALESCE({cond}, FALSE)"


def outliers_cap(src: str, name: str, cols=None, method: str = "iqr", t: float = 3.0, by: str = "") -> str:
    cols = F3_OUTLIER if cols is None else cols
    b, n = f"{name}_bd", f"{name}_n"
    sums = ", ".join(f"SUM(CASE WHEN {flag_sql(c, b, method)} THEN 1 ELSE 0 END) AS {c}_n" for c in cols)
    beside = lambda t: f"LEFT JOIN {t} ON {t}.{by} IS NOT DISTINCT FROM {src}.{by}" if by else f", {t}"
    group = f"SELECT {src}.{by}, {sums} FROM {src} {beside(b)} GROUP BY {src}.{by}" if by else f"SELECT {sums} FROM {src}, {b}"
    parts = [bounds_cte(src, b, cols, method, t, by), f"{n} AS ({group})"]
    rep = []
    for c in cols:
        lo = f"GREATEST(0.0, {b}.{c}_lo)" if c in C.NON_NEGATIVE_CAP_COLUMNS else f"{b}.{c}_lo"
        x = f"CAST({src}.{c} AS DOUBLE)"
        rep.append(f"CASE WHEN {n}.{c}_n > 0 THEN {clip_sql(x, lo, f'{b}.{c}_hi')} ELSE {x} END AS {c}")
    parts.append(f"{name} AS (SELECT {src}.* REPLACE ({', '.join(rep)}) FROM {src} {beside(b)} {beside(n)})")
    return ",\n".join(parts)


def outliers_transform(src: str, name: str, cols=None) -> str:
    cols = F3_OUTLIER if cols is None else cols
    b, n = f"{name}_bd", f"{name}_n"
    parts = [bounds_cte(src, b, cols),
             f"{n} AS (SELECT {', '.join(f'SUM(CASE WHEN {flag_sql(c, b)} THEN 1 ELSE 0 END) AS {c}_n' for c in cols)} "
             f"FROM {src}, {b})"]
    rep = []
    for c in cols:
        x = f"CAST({src}.{c} AS DOUBLE)"
        if c in C.LOG_TRANSFORM_COLUMNS:
            rep.append(f"CASE WHEN {n}.{c}_n > 0 THEN LN(1 + {x}) ELSE {x} END AS {c}")
        else:
            rep.append(f"{x} AS {c}")
    parts.append(f"{name} AS (SELECT {src}.* REPLACE ({', '.join(rep)}) FROM {src}, {b}, {n})")
    return ",\n".join(parts)


def outliers_remove(src: str, name: str, cols=None, by: str = "") -> str:
    cols = F3_OUTLIER if cols is None else cols
    parts, cur = [], src
    for i, c in enumerate(cols):
        b = f"{name}_b{i}"
        nxt = f"{name}_r{i}" if i < len(cols) - 1 else name
        parts.append(bounds_cte(cur, b, [c], by=by))
        beside = f"LEFT JOIN {b} ON {b}.{by} IS NOT DISTINCT FROM {cur}.{by}" if by else f", {b}"
        parts.append(f"{nxt} AS (SELECT {cur}.* FROM {cur} {beside} WHERE NOT {flag_sql(c, b)})")
        cur = nxt
    return ",\n".join(parts)


def fix_ranges(src: str, name: str, cols) -> str:
    rep = []
    for c, lo, hi in C.RANGE_CONSTRAINTS:
        if c in cols:
            rep.append(f"{clip_sql(c, lo, hi)} AS {c}")
    return f"{name} AS (SELECT * REPLACE ({', '.join(rep)}) FROM {src})"


def growth_rate(src: str, name: str) -> str:
    imp = sdiv("post_likes + comments + saves + shares", "reach")
    return (f"{name} AS (SELECT * REPLACE (CASE WHEN ABS(growth - (follows - unfollows)) > 10 THEN follows - unfollows "
            f"ELSE growth END AS growth, CASE WHEN COALESCE(ABS(engagement_rate - {imp}) > 0.1, FALSE) THEN {imp} "
            f"ELSE engagement_rate END AS engagement_rate) FROM {src})")


def smooth(src: str, name: str, out_type: str = "DOUBLE") -> str:
    """CL17 as a recursive CTE over each creator's rows in date order (needs WITH RECURSIVE)."""
    s0, sm = f"{name}_s0", f"{name}_sm"
    cast = ("CAST(round_even(sm.sf, 0) AS BIGINT)" if out_type == "BIGINT" else "sm.sf")
    return (f"{s0} AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY username ORDER BY date NULLS LAST) AS _rn FROM {src}),\n"
            f"{sm} AS (SELECT username, _rn, CAST(followers AS DOUBLE) AS sf FROM {s0} WHERE _rn = 1 UNION ALL "
            f"SELECT s.username, s._rn, CASE WHEN ABS(s.followers - p.sf) > 50000 THEN p.sf + SIGN(s.followers - p.sf) "
            f"* LEAST(10000, p.sf * 0.1) ELSE CAST(s.followers AS DOUBLE) END FROM {sm} p JOIN {s0} s "
            f"ON s.username = p.username AND s._rn = p._rn + 1),\n"
            f"{name} AS (SELECT s.* EXCLUDE (_rn) REPLACE ({cast} AS followers) FROM {s0} s JOIN {sm} sm "
            f"ON s.username = sm.username AND s._rn = sm._rn)")


def round_cols(src: str, name: str) -> str:
    rep = [f"CAST(round_even(CAST({c} AS DOUBLE), 0) AS BIGINT) AS {c}" for c in F3_INT]
    rep += [f"round_even(CAST({c} AS DOUBLE), 6) AS {c}" for c in F3_FLOAT]
    return f"{name} AS (SELECT * REPLACE ({', '.join(rep)}) FROM {src})"
