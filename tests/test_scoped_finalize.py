"""FE13 and FE14 per creator: one shuffle, no written table, one pass of percentiles; the results are those of two passes to the bit."""

import datetime as dt
import math
import random
import re
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from growthspark.functions import exprs as X
from growthspark.operators import features as FE
from growthspark.plans import q_features, registry  # noqa: F401  (registers fe4)
from growthspark.sources import fixtures as FX

SCHEMA = "username string, date date, note string, posts long, engagement_rate double, reach float, odd double, none double, price decimal(12,2), growth int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark):
    r = random.Random(3)
    out = []
    for who, n in (("a", 1500), ("b", 2), ("c", 1), (None, 41), ("d", 700), *((f"e{n}", n) for n in (2, 2, 3, 4, 5) * 8)):
        for i in range(n):
            out.append((who, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if i % 9 == 0 else "x", r.choice([None, 0, 3, r.randrange(10**7)]),
                        r.gauss(0, 1) * 10 ** r.randrange(-6, 9), r.choice([None, 1.5, r.random()]),
                        r.choice([math.inf, -math.inf, math.nan, None, 0.0, r.random()]) if who != "c" else math.nan, None,
                        Decimal(r.randrange(10**8)) / 100, i % 13))
    return spark.createDataFrame(out, SCHEMA)


def by_percentile(d, numeric):
    """The step as window aggregates: clip bounds, then the medians of the clipped values."""
    w = Window.partitionBy("username")
    d = d.withColumns({c: X.finite_or_null(c) for c in numeric})
    q = lambda c, p: F.percentile(c, p).over(w)
    d = d.withColumns({f"{k}_{c}": q(c, p) for c in numeric for k, p in (("lo", 0.001), ("hi", 0.999))})
    d = d.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(f"lo_{c}", F.least(f"hi_{c}", c))) for c in numeric})
    d = d.withColumns({f"md_{c}": F.lit(0.0) if FE._fill_zero(c) else q(c, 0.5) for c in numeric})
    return d.withColumns({c: X.round_half_even(F.coalesce(c, f"md_{c}"), 6) for c in numeric})


def test_scoped_finalize_is_the_percentiles_to_the_bit(spark):
    d = rows(spark)
    numeric = ["posts", "engagement_rate", "reach", "odd", "none", "price", "growth"]
    got = FE.finalize_features(d, scope=["username"])
    assert got.columns == [*d.columns, "weekly_growth"] and all(dict(got.dtypes)[c] == "double" for c in numeric)
    want = by_percentile(d, numeric).withColumn("weekly_growth", F.col("growth")).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_scoped_finalize_of_no_numbers_and_of_two_scope_columns(spark):
    d = rows(spark)
    text = d.select("username", "note")
    assert sorted(map(str, FE.finalize_features(text, scope=["username"]).collect())) == sorted(map(str, text.collect()))
    pair = d.where("username = 'd'").select("username", "note", "posts")
    got = FE.finalize_features(pair, scope=["username", "note"]).groupBy("note").agg(F.max("posts").alias("top")).collect()
    want = {r["note"]: r["hi"] for r in pair.groupBy("note").agg(F.percentile(F.col("posts").cast("double"), 0.999).alias("hi")).collect()}
    assert {r["note"]: r["top"] for r in got} == {k: round(v, 6) for k, v in want.items()}


def test_scoped_finalize_takes_one_pass_of_percentiles(spark):
    p = plan(FE.finalize_features(rows(spark), scope=["username"]))
    assert len(re.findall(r"Window \[percentile\(", p)) == 1 and "Join" not in p


def test_daily_path_per_creator_takes_one_shuffle_and_writes_nothing(spark, sf):
    d = FE.transform_to_model_ready(FX.daily_metrics(spark, sf), "daily", scope=["username"])
    assert not any("/once-" in f for f in d.inputFiles())
    assert plan(d).count("Exchange hashpartitioning") == 1


def test_queries_run_with_methods_the_jvm_compiles(spark, sf):
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    registry.spark_queries()["fe4"](spark, sf)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
