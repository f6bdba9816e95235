"""Driver contract, plan shape checks (no Python in scoring, no single-partition
creator windows, pushed-down scans) and streaming = batch."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from growthspark.operators import score as SC
from growthspark.operators import weekly as W
from growthspark.operators import windows as WN
from growthspark.plans.q_apps import requests
from growthspark.plans.q_models import fixed_model
from growthspark.sources import fixtures as FX


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    r = df.collect()
    assert len(r) == 1 and r[0]["n"] > 0


def test_oracle_keys_subset_of_queries():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 150


def test_scoring_plan_has_no_python_worker(spark, sf):
    out = SC.predict_batch(requests(spark, sf), fixed_model())
    p = plan(out)
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_creator_windows_are_partitioned(spark, sf):
    d = WN.add_daily_rolling_features(FX.daily_metrics(spark, sf))
    p = plan(d)
    assert "SinglePartition" not in p
    assert re.search(r"hashpartitioning\(username", p)


def test_weekly_is_one_partial_aggregate_shuffle(spark, sf):
    w = W.create_weekly_features(FX.daily_metrics(spark, sf))
    p = w._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in p or "partial_" in p


def test_scan_prunes_columns(spark, sf):
    w = W.create_weekly_features(FX.daily_metrics(spark, sf)).select("username", "posts")
    p = plan(w)
    m = re.search(r"ReadSchema: struct<([^>]*)>", p)
    assert m and "l_comment" not in m.group(1)


def test_stream_scoring_equals_batch(spark, sf):
    from growthspark.plans.q_apps import sc5, sc5_stream
    a = sorted(tuple(r) for r in sc5(spark, sf).collect())
    b = sorted(tuple(r) for r in sc5_stream(spark, sf).collect())
    assert a == b


def test_no_cartesian_or_nested_loop_joins(spark, sf):
    from growthspark.operators import kpi as K
    from growthspark.plans.q_eval import predictions
    w = W.weekly_feature_table(FX.daily_metrics(spark, sf))
    for df in (w, K.comparative_kpis(predictions(spark, sf)), K.threshold_accuracy(predictions(spark, sf))):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
