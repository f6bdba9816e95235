"""Composed pipelines.

Path A  raw daily -> validate -> clean -> model-ready weekly features
Path B  features -> model (Gram fit + time folds) -> predictions -> KPIs, diagnostics
Path C  scenario requests -> scores (batch or stream, see ``streaming``)
Retrain load -> clean -> features -> fit -> drift against the previous model's metrics
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as CL
from ..operators import diagnostics as D
from ..operators import features as FE
from ..operators import kpi as K
from ..operators import models as M
from ..operators import quality as Q
from ..sources import io as IO


def path_a(raw: DataFrame, frequency: str = "weekly") -> tuple[DataFrame, DataFrame]:
    """Validate (issue table) and clean raw rows, then build model-ready features."""
    issues = Q.validate_raw_data_schema(raw, Q.business_ranges())
    cleaned, _ = CL.clean_raw_data(raw)
    return FE.transform_to_model_ready(cleaned, frequency), issues


def predictions_of(model: M.GrowthModel, features: DataFrame) -> DataFrame:
    """Predictions table in the KPI / diagnostics input schema."""
    date_col = model.date_col if model.date_col in features.columns else "date"
    keep = [c for c in ("weekly_posting_frequency", "follows_per_post") if c in features.columns]
    p = model.predict(features).select("username", F.col(date_col).alias("date"),
                                       F.col(model.target).cast("double").alias("y_true"), "y_pred", *keep)
    if "weekly_posting_frequency" in keep:
        p = p.withColumnRenamed("weekly_posting_frequency", "posting_frequency")
    if "follows_per_post" in keep:
        p = p.withColumnRenamed("follows_per_post", "roi_actual")
    return p


def path_b(features: DataFrame, model_type: str = "linear") -> dict:
    """Fit with time folds, score, and evaluate (KPIs long table + diagnostics dict)."""
    model = M.fit_model(features, model_type)
    pred = predictions_of(model, features)  # both evaluators checkpoint it
    gram = M.build_design(features, n_splits=None).total
    return {"model": model, "kpis": K.all_kpis(pred),
            "diagnostics": D.run_full_diagnostics(pred, gram, features=features.select(*model.features))}


def retrain(spark: SparkSession, raw_path: str, model_path: str, model_type: str = "linear",
            drift_threshold: float = 0.1) -> dict:
    """Retraining job: load raw CSV, clean, build features, fit, compare with the
    previous model's training metrics (DG17), save the new model version."""
    raw, issues, bad_dates = IO.load_raw_data(spark, raw_path, validate=False)
    features, _ = path_a(raw)
    model = M.fit_model(features, model_type)
    drift = None
    if IO.versions(spark, model_path):
        prev = IO.load_model(spark, model_path)
        rows = lambda m: spark.createDataFrame(
            [(k, float(m.train_metrics[k])) for k in ("r2", "rmse", "mae", "directional_accuracy")],
            "metric string, value double")
        drift = D.detect_model_drift(rows(prev), rows(model), drift_threshold)
    saved = IO.save_model(model, spark, model_path)
    return {"model": model, "saved_to": saved, "drift": drift, "bad_dates": bad_dates}
