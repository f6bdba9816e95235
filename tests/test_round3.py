"""DG4's halves, the full processed table, per-creator scopes, report series, the optional part."""

import subprocess
import sys

import pytest

from growthspark.operators import clean as CL
from growthspark.operators import diagnostics as D
from growthspark.operators import features as FE
from growthspark.operators import metrics as ME
from growthspark.operators import quality as Q
from growthspark.operators import weekly as W
from growthspark.sources import fixtures as FX
from tests.conftest import ROOT


def predictions(spark, fitted, residuals):
    return spark.createDataFrame([(i, float(f + e), float(f)) for i, (f, e) in enumerate(zip(fitted, residuals))], "n long, y_true double, y_pred double")


@pytest.mark.parametrize(("negatives", "passed"), [(10, True), (2, True), (1, False), (0, False)])
def test_dg4_compares_halves_by_rank_where_r_does_not_exist(spark, negatives, passed):
    # residuals of one size: r does not exist; the lower half's mean m leaves it a variance of 1 - m^2
    fitted = [float(i) for i in range(40)]
    e = [-1.0] * negatives + [1.0] * (20 - negatives) + [(-1.0) ** i for i in range(20)]
    got = D.homoscedasticity(predictions(spark, fitted, e))
    least = max(1 - ((20 - 2 * negatives) / 20) ** 2, 1e-10)
    assert got["correlation_abs_residuals_fitted"] is None and got["p_value"] is None
    assert got["variance_ratio"] == pytest.approx(1 / least, rel=1e-6)  # 2.78 with two negatives: below 3, above 2
    assert got["passed"] is passed


def test_dg4_splits_ties_evenly(spark):
    same = predictions(spark, [7.0] * 41, [float(i) for i in range(41)])
    assert same.where(D._lower_half(same, 41)).count() == 20
    some = predictions(spark, [1.0] * 5 + [7.0] * 30 + [9.0] * 5, [float(i) for i in range(40)])
    low = [r["y_pred"] for r in some.where(D._lower_half(some, 40)).collect()]
    assert sorted(low) == [1.0] * 5 + [7.0] * 15
    assert D.homoscedasticity(same)["variance_ratio"] >= 1


def test_dg4_needs_rows(spark):
    assert D.homoscedasticity(predictions(spark, [], []))["passed"] is False
    assert D.homoscedasticity(predictions(spark, [1.0], [2.0]))["passed"] is False


def test_full_processed_table_passes_its_check(spark, sf):
    d = FX.daily_metrics(spark, sf)
    weekly = W.weekly_feature_table(d)
    lacking = {r["column_name"] for r in Q.validate_processed_data_schema(weekly, "full").where("is_issue").collect()}
    assert lacking == {"engagement_rate_smoothed", "posted_in_optimal_window"}
    full = W.add_processed_columns(weekly, d)
    assert Q.validate_processed_data_schema(full, "full").where("is_issue").count() == 0
    assert full.count() == weekly.count()


def test_scope_is_one_partitioning_without_joins(spark, sf):
    d = FX.daily_metrics(spark, sf)
    capped = FE.finalize_features(FE.create_daily_features(d), scope=["username"])
    plan = capped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile") > 0 and plan.split("Window")[0].count("Join") == 0
    a, n = CL.handle_outliers(d, "zscore", 2.0, "remove", cols=["reach", "posts"], scope=["username"])
    assert a.count() + n == d.count() and n > 0
    capped, k = CL.handle_outliers(d, "zscore", 2.0, "cap", cols=["reach"], scope=["username"])
    assert k > 0 and capped.count() == d.count()
    logged, _ = CL.handle_outliers(d, "zscore", 2.0, "transform", cols=["reach"], scope=["username"])
    assert logged.agg({"reach": "max"}).first()[0] <= d.agg({"reach": "max"}).first()[0]


def test_verdict_gives_advice(spark):
    m = spark.createDataFrame([(0.9, 90.0), (0.1, 90.0), (0.1, 10.0)], "r2 double, directional_accuracy double")
    got = [(r["overall_quality"], r["recommendations"].count(";") + bool(r["recommendations"])) for r in ME.quality_verdict(m).collect()]
    assert got == [("Excellent", 0), ("Good", 1), ("Poor", 2)]


def test_a_missing_library_of_the_optional_part_leaves_the_rest():
    code = ("import sys; sys.modules['ahocorasick'] = None; sys.path.insert(0, %r); import __spark_entry__ as E; "
            "q = E.queries(); assert E.LLM is None and 'cl22' in q and 'pipeline' not in q; print(len(q), len(E.oracle_sql()))" % ROOT)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_sampled_scatter_is_the_same_on_any_partitioning(spark):
    from growthspark.operators import report as R
    df = spark.range(5000).selectExpr("concat('u', id % 9) username", "date_add(date'2020-01-01', int(id div 9)) date",
                                      "cast(id % 100 as double) y_pred", "cast(id % 100 + (id % 7) as double) y_true")
    a, b = (sorted(map(tuple, R.residual_sample(d, per_band=20, bands=10).collect())) for d in (df.repartition(1), df.repartition(13)))
    assert a == b and len(a) == 200
    assert R.residual_sample(df.limit(0)).count() == 0
    assert R.residual_sample(df.withColumn("y_pred", df["y_true"] * 0)).count() == 100  # one band


def test_versions_of_one_millisecond_and_their_retirement(spark, tmp_path, monkeypatch):
    from growthspark.sources import io as IO
    monkeypatch.setattr(IO.time, "time", lambda: 1700000000.0)
    path = str(tmp_path / "t")
    made = {IO.save_dataframe(spark.range(i + 1), path) for i in range(4)}
    assert len(made) == 4 == len(IO.versions(spark, path))
    (tmp_path / "t" / "v=1600000000000-open").mkdir()  # a writer that has not committed
    gone = IO.retire_versions(spark, path, keep=2)
    assert len(gone) == 2 and len(IO.versions(spark, path)) == 2
    assert (tmp_path / "t" / "v=1600000000000-open").exists()
    assert spark.read.parquet(IO.current_version(spark, path)).count() >= 1
