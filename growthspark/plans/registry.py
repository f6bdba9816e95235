"""Registry of named queries: Spark callable + DuckDB oracle SQL.

columns are rounded at the query edge on both sides (by magnitude band, 6
decimals at most, see :func:`edge_round_col`) so the comparison does not depend
on the order in which two engines add floating-point numbers; the library
itself never rounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import DEFAULT_CONF


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: tuple = field(default_factory=tuple)
    doc: str = ""
    raw: Callable[[SparkSession, str], DataFrame] | None = None  # operator output without edge rounding


REGISTRY: dict[str, Query] = {}


# magnitude bands (exact comparisons) -> decimal scale: about 9 significant
# digits, never more than 6 decimals; beyond 1e9 the value passes through
BANDS = [(1e3, 1e6), (1e4, 1e5), (1e5, 1e4), (1e6, 1e3), (1e7, 1e2), (1e8, 1e1), (1e9, 1.0)]


# the rounding boundary sits at .4998765432 of the last digit instead of .5:
# short binary fractions (x.xxxxxx5 exactly, e.g. averages of dyadic values)
# never fall on it, so one ulp of summation-order noise cannot flip a digit
EDGE_OFFSET = 0.4998765432


def edge_round_col(c) -> F.Column:
    """floor(x * s + c) / s in IEEE doubles with a band-chosen scale s and the
    fixed offset c: the same bits in Spark and DuckDB (unlike ``round``, which
    Spark applies to the decimal string); +-inf, NaN, NULL and |x| >= 1e9 pass
    through."""
    x = F.col(c).cast("double")
    a = F.abs(x)
    e = None
    for lim, s in BANDS:
        r = F.floor(x * s + EDGE_OFFSET).cast("double") / s
        e = F.when(a < lim, r) if e is None else e.when(a < lim, r)
    return e.otherwise(x)


def finalize(df: DataFrame) -> DataFrame:
    """Round every double column at the edge (see ``edge_round_col``)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(edge_round_col(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def r6(expr: str) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    arms = " ".join(f"WHEN ABS({x}) < {lim!r} THEN floor({x} * {s!r} + CAST({EDGE_OFFSET!r} AS DOUBLE)) / {s!r}"
                    for lim, s in BANDS)
    return f"(CASE {arms} ELSE {x} END)"


def edge_sql(sql: str, doubles) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"{r6(c)} AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


def register(name: str, sql: str | None = None, doubles=()):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", DEFAULT_CONF["spark.sql.codegen.hugeMethodLimit"])
            return finalize(fn(spark, sf_dir))
        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, sql, tuple(doubles), fn.__doc__ or "", fn)
        return fn
    return deco


def spark_queries() -> dict:
    return {k: q.fn for k, q in REGISTRY.items()}


def oracle_queries() -> dict:
    return {k: edge_sql(q.sql, q.doubles) for k, q in REGISTRY.items() if q.sql}
