"""Quarantine, quantiles with infinities, fold-table aggregates, selection paths, Anderson-Darling tails."""

import math

import numpy as np
import pytest

from growthspark import config as C
from growthspark.functions import dist, stats
from growthspark.operators import clean as CL
from growthspark.operators import diagnostics as D
from growthspark.operators import gram as G
from growthspark.operators import models as M
from growthspark.operators import select as S
from growthspark.operators import validate as V

DETAIL = [{"fold_number": i + 1, **{f"{side}_{m}": v for (side, m), v in zip(
    [(s, m) for s in ("train", "test") for m in C.CV_METRICS], vals)}}
    for i, vals in enumerate([(.9, 2., 1., .7, 4., 1.5), (.8, 2.5, 1.1, .75, 3.9, 1.4), (.85, 2.1, 1.2, .5, 6., 2.), (.9, 2., 1., .75, 4.1, 1.6)])]


def test_cleaning_keeps_creators_apart(spark):
    """Rows without a creator or date are neither merged nor filled from each other."""
    rows = [("a", f"{d:02d}-01-2024", 100 + d, 1, 0) for d in range(1, 8)] + [("b", f"{d:02d}-01-2024", None, 2, 0) for d in range(1, 6)]
    rows += [(None, f"{d:02d}-01-2024", 900, 3, 0) for d in range(1, 8)] + [("a", "bad", 900, 4, 0), ("a", "bad", 901, 4, 0), ("a", "01-01-2024", 500, 5, 1)]
    df = spark.createDataFrame(rows, "username string, date string, followers long, posts long, seq int")
    out, info = CL.clean_raw_data(df, collect_stats=True)
    got = out.collect()
    assert len(got) == len({(r["username"], r["date"]) for r in got}) == 12
    assert {r["followers"] for r in got if r["username"] == "b"} == {0}
    assert max(r["followers"] for r in got) <= 500 and info["quarantined_rows"] == 9
    lost = CL.quarantine(CL.fix_data_types(df)[0])[1]
    assert {r["reason"]: r["n"] for r in lost.groupBy("reason").count().withColumnRenamed("count", "n").collect()} == {"missing username": 7, "missing date": 2}


@pytest.mark.parametrize("task_max", [5, 5_000_000])
def test_quantiles_with_infinities_and_extremes(spark, monkeypatch, task_max):
    monkeypatch.setattr(stats, "TASK_MAX", task_max)
    rng = np.random.default_rng(1)
    v = np.concatenate((rng.normal(size=200), [1e308, -1e308, 5e-324, 0.0, 0.0, 0.0]))
    for extra in ([], [math.inf], [math.inf] * 150, [-math.inf] * 3 + [math.inf]):
        x = np.concatenate((v, extra))
        df = spark.createDataFrame([(float(a),) for a in x], "v double")
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            got = stats.global_quantiles(df, {"q": ("v", p)})["q"]
            s, h = np.sort(x), (len(x) - 1) * p
            a, b = s[math.floor(h)], s[math.ceil(h)]
            want = a if a == b or h == math.floor(h) else a + (h - math.floor(h)) * (b - a)
            assert got == pytest.approx(want, rel=1e-12), (p, len(extra))


def test_fold_tables_match_numpy(spark):
    scores = V.fold_scores(spark, DETAIL)
    summary = {r["metric"]: r.asDict() for r in V.cv_summary(scores, len(DETAIL)).collect()}
    for m in C.CV_METRICS:
        te, tr = (np.array([d[f"{s}_{m}"] for d in DETAIL]) for s in ("test", "train"))
        half = dist.t_ppf(.975, 3) * te.std(ddof=1) / 2
        want = {"mean": te.mean(), "std": te.std(), "min": te.min(), "max": te.max(), "cv": te.std() / abs(te.mean()),
                "ci95_lower": te.mean() - half, "ci95_upper": te.mean() + half, "train_mean": tr.mean(), "train_std": tr.std(),
                "overfitting_score": max(0, (tr.mean() - te.mean()) * (1 if m == "r2" else -1))}
        assert all(summary[m][k] == pytest.approx(w) for k, w in want.items())
    stable = {r["metric"]: r for r in V.stability(V.cv_summary(scores, len(DETAIL))).collect()}
    flags = {m: summary[m]["cv"] < .2 for m in C.CV_METRICS}
    assert all(stable[m]["stable"] == flags[m] and stable[m]["stability_score"] == pytest.approx(np.mean(list(flags.values()))) for m in flags)
    t = V.fold_trend(scores).first()
    r2 = [d["test_r2"] for d in DETAIL]
    assert t["r2_trend_correlation"] == pytest.approx(np.corrcoef([1, 2, 3, 4], r2)[0, 1])
    assert (t["best_fold"], t["worst_fold"], t["r2_range"]) == (2, 3, pytest.approx(.25))
    coefs = np.array([[1., -1., 0.], [2., 1., 0.], [3., -2., 0.]])
    got = {r["feature"]: r for r in V.coefficient_consistency(V.fold_weights(spark, ["a", "b", "c"], coefs)).collect()}
    for j, f in enumerate("abc"):
        assert got[f]["coef_std"] == pytest.approx(coefs[:, j].std())
        assert got[f]["sign_consistency"] == pytest.approx((np.sign(coefs[:, j]) == np.sign(coefs[:, j].mean())).mean())


def _gram(spark, x, y):
    names = [f"f{j}" for j in range(x.shape[1])]
    v = np.column_stack((x, y))
    return G.Gram([*names, "y"], float(len(y)), v.sum(0), v.T @ v, np.zeros(v.shape[1]))


def test_filter_selection_drops_the_redundant_half(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 3))
    x = np.column_stack((base[:, 0], base[:, 0] + .01 * rng.normal(size=300), base[:, 1], np.full(300, 3.) + 1e-3 * rng.normal(size=300), base[:, 2]))
    y = 2 * base[:, 0] + base[:, 1]
    t = {r["feature"]: r for r in S.filter_selection(spark, _gram(spark, x, y), 2).collect()}
    assert [f for f in sorted(t) if t[f]["selected"]] == ["f0", "f2"]
    assert t["f3"]["variance"] < .01 and t["f1"]["target_correlation"] == pytest.approx(abs(np.corrcoef(x[:, 1], y)[0, 1]))


def test_forward_path_is_greedy_and_stops_without_gain(spark):
    from growthspark.plans.q_models import model_frame
    des = M.build_design(model_frame(spark, "/root/testdata/sf0.001"), n_splits=3)
    path = S.forward_path(des, 4)
    got = S.forward_selection(des, 4)
    assert len({j for j, _ in path}) == len(path) == 4
    kept = got["selected_features"]
    assert kept == [des.features[j] for j, _ in path[:len(kept)]]
    r2 = [s for _, s in path]
    assert all(a < b for a, b in zip(r2[:len(kept)], r2[1:len(kept)])) and got["best_cv_score"] == r2[len(kept) - 1]
    assert len(kept) == 4 or r2[len(kept)] <= r2[len(kept) - 1]


def test_walk_forward_matches_refits(spark):
    from growthspark.plans.q_models import model_frame
    frame = model_frame(spark, "/root/testdata/sf0.001")
    dates = G.distinct_dates(frame, "week_start")
    start = len(dates) - 4
    got = V.walk_forward_validation(frame, start)
    assert [g["test_start"] for g in got] == dates[start:]
    des = M.build_design(frame, folds_pos=[(0, start, start, start + 1)])
    rows = des.df.select("week_start", des.target, *des.features).toPandas()
    x, y = rows[des.features].to_numpy(float), rows[des.target].to_numpy(float)
    for k, g in enumerate(got):
        train = (rows["week_start"] < dates[start + k]).to_numpy()
        test = (rows["week_start"] == dates[start + k]).to_numpy()
        a = np.column_stack((np.ones(train.sum()), x[train]))
        w = np.linalg.lstsq(a, y[train], rcond=None)[0]
        err = y[test] - np.column_stack((np.ones(test.sum()), x[test])) @ w
        assert g["n_test"] == test.sum() and g["mse"] == pytest.approx((err ** 2).mean(), rel=1e-4)


def test_log_tail_is_exact_far_out_and_needs_no_python_worker(spark):
    from growthspark.functions import dist
    zs = [0.0, 1e-9, 0.3, -1.0, 2.5, -5.0, 8.0, 12.0, 20.0, -30.0, 37.0, 60.0, -1e3, 1e8]
    df = dist.log_lower_tail(spark.createDataFrame([(z,) for z in zs], "z double"), "z", "l")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        x = abs(r["z"])
        if x < 37:
            want = math.log(0.5 * math.erfc(x / math.sqrt(2)))
        else:
            want = -x * x / 2 - math.log(x) - 0.5 * math.log(2 * math.pi) + math.log1p(-1 / x ** 2 + 3 / x ** 4 - 15 / x ** 6 + 105 / x ** 8)
        assert r["l"] == pytest.approx(want, rel=1e-12, abs=1e-12), r["z"]


def test_anderson_darling_with_a_spike(spark):
    rng = np.random.default_rng(3)
    e = np.append(rng.normal(size=3000), 1e4)
    df = spark.createDataFrame([("a", float(x), 0.0) for x in e], "username string, y_true double, y_pred double")
    got = D.anderson_darling(df)
    assert math.isfinite(got["statistic"]) and not got["passed"]


def test_shapiro_returns_every_group(spark):
    rows = [("few", float(i), 0.0) for i in range(3)] + [("flat", 1.0, 0.0)] * 10 + [("fine", float(x), 0.0) for x in np.random.default_rng(1).normal(size=50)]
    rows += [("many", float(i), 0.0) for i in range(5001)]
    df = spark.createDataFrame(rows, "username string, y_true double, y_pred double")
    got = {r["username"]: (r["n"], r["status"], r["statistic"] is not None) for r in D.shapiro_wilk_by(df).collect()}
    assert got == {"few": (3, "too few rows", False), "flat": (10, "constant", False), "fine": (50, "tested", True), "many": (5001, "too many rows", False)}


def test_health_and_advice(spark):
    schema = "r2 double, assumption_score double, outlier_rate double, degraded boolean, normal boolean, equal_variance boolean, collinear boolean"
    rows = [(.9, 1., .0, False, True, True, None), (.5, .5, .3, True, False, False, True), (-5., .0, 1., True, False, False, True)]
    got = [r.asDict() for r in D.health(spark.createDataFrame(rows, schema)).collect()]
    assert [g["overall_health_score"] for g in got] == pytest.approx([1., 1 - .2 - .15 - .06 - .1, 1 - .2 - .3 - .1 - .1])
    assert got[0]["recommendations"] == [C.DIAGNOSTIC_ALL_GOOD] and len(got[1]["recommendations"]) == 6


def test_unconverged_descent_is_an_error():
    s = np.array([[1., .999], [.999, 1.]])
    with pytest.raises(ArithmeticError):
        G.coordinate_descent(s * 100, np.array([50., -50.]), 100, 1e-6, .5, max_iter=2)


def test_cluster_needs_a_shared_folder():
    from growthspark import session

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_only_finished_versions_count(spark, tmp_path):
    from growthspark.sources import io as IO
    root = str(tmp_path / "data")
    assert IO.versions(spark, root) == [] and IO.load_external_data(spark, root) is None
    first = IO.save_dataframe(spark.range(3).toDF("x"), root)
    (tmp_path / "data" / "v=9999999999999").mkdir()  # a writer that has not committed
    assert IO.versions(spark, root) == [first] and IO.current_version(spark, root) == first


def test_loader_checks_business_ranges(spark, tmp_path):
    from growthspark.sources import io as IO
    path = str(tmp_path / "raw.csv")
    column, low, _ = next(r for r in C.RANGE_CONSTRAINTS if r[0] in C.INT_COLUMNS)
    rows = [(f"u{i}", f"{i % 27 + 1:02d}-01-2024", -5 if i == 0 else 5) for i in range(60)]
    spark.createDataFrame(rows, f"username string, date string, {column} long").coalesce(1).write.option("header", True).csv(path)
    _, issues, _ = IO.load_raw_data(spark, path)
    assert low <= 5 and issues.where("is_issue").where(f"column_name = '{column}'").count() >= 1


def test_retraining_job(spark, tmp_path, sf):
    from growthspark.plans import composed
    from growthspark.sources import fixtures as FX
    daily = FX.daily_metrics(spark, sf)
    raw = str(tmp_path / "raw")
    from pyspark.sql import functions as F
    daily.withColumn("date", F.date_format("date", "dd-MM-yyyy")).write.option("header", True).csv(raw)
    first = composed.retrain(spark, raw, str(tmp_path / "model"))
    again = composed.retrain(spark, raw, str(tmp_path / "model"))
    assert first["drift"] is None and first["bad_dates"] == 0
    drift = again["drift"].collect()
    assert len(drift) == 4 and all(abs(r["relative_change"]) < 1e-9 and not r["drift_detected"] for r in drift)
