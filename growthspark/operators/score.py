"""Scenario scoring (SC1-SC8): DataFrame in, DataFrame out.

Every step is a row-local Column expression (defaults, bounds, share
normalisation, the model's linear predictor, interval, category, advice), so
a batch of any size is one codegen stage without a shuffle, and the same
function runs unchanged on a ``readStream`` (see ``streaming``).  The
reference's 100-row batch limit is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from . import quality as Q

REQUEST_COLUMNS = [name for name, _, _, _ in C.REQUEST_FIELDS]


# SC1 ------------------------------------------------------------------------
def apply_request_defaults(df: DataFrame) -> DataFrame:
    """Optional request fields take their defaults; missing columns are added."""
    out = df
    for name, default, _, _ in C.REQUEST_FIELDS:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(default))
        elif default is not None:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    return out


# SC2 ------------------------------------------------------------------------
def normalise_request_shares(df: DataFrame) -> DataFrame:
    """Shares off 1 by more than .01 are divided by their sum (B20: the three shares)."""
    s = reduce(lambda a, b: a + b, [F.col(c).cast("double") for c in C.SHARE_COLUMNS])
    off = (F.abs(s - 1.0) > C.SHARE_SUM_TOLERANCE) & (s > 0)
    out = df.withColumn("_s", s)
    for c in C.SHARE_COLUMNS:
        out = out.withColumn(c, F.when(off, F.col(c) / F.col("_s")).otherwise(F.col(c).cast("double")))
    return out.drop("_s")


# SC4 ------------------------------------------------------------------------
def recommendation(pred_col: str = "predicted_growth") -> F.Column:
    p = F.col(pred_col)
    f = F.col("weekly_posting_frequency")
    parts = F.array(
        F.when(f < 5, F.lit("Consider increasing posting frequency"))
         .when(f > 15, F.lit("Monitor for posting saturation")),
        F.when(F.col("share_reels") < 0.4, F.lit("Increase reels content for better reach")),
        F.when(F.col("engagement_rate") < 0.03, F.lit("Focus on improving engagement quality")),
        F.when(p < 0, F.lit("Review content strategy immediately"))
         .when(p < 100, F.lit("Optimize posting timing and consistency")))
    kept = F.array_compact(parts)
    return F.when(F.size(kept) > 0, F.concat_ws("; ", kept)).otherwise(F.lit(C.DEFAULT_RECOMMENDATION))


# SC5 / SC6 ------------------------------------------------------------------
def predict_batch(requests: DataFrame, model, level: float = C.CONFIDENCE_LEVEL,
                  include_metadata: bool = True, validate: bool = True) -> DataFrame:
    """SC1 -> DQ14 -> SC2 -> ML10 -> SC3 -> SC4; rejected rows keep their reasons and no prediction."""
    x = apply_request_defaults(requests)
    if validate:
        x = Q.validate_inputs(x)
    x = normalise_request_shares(x)
    x = model.predict_with_confidence(x, level, out="predicted_growth")
    x = (x.withColumnRenamed("lower_bound", "confidence_interval_lower")
          .withColumnRenamed("upper_bound", "confidence_interval_upper"))
    if validate:
        for c in ("predicted_growth", "confidence_interval_lower", "confidence_interval_upper"):
            x = x.withColumn(c, F.when(F.col("accepted"), F.col(c)))
    if include_metadata:
        x = (x.withColumn("growth_category", X.growth_category("predicted_growth"))
              .withColumn("recommendation", F.when(F.col("predicted_growth").isNotNull(), recommendation())))
    return x


def batch_summary(scored: DataFrame) -> DataFrame:
    p = F.col("predicted_growth")
    return scored.agg(F.count(p).alias("total_predictions"), F.avg(p).alias("average_predicted_growth"),
                      F.min(p).alias("min_predicted_growth"), F.max(p).alias("max_predicted_growth"))


def predict_single(spark, model, **fields) -> DataFrame:
    """SC6: one request row through SC5."""
    row = {name: fields.get(name) for name in REQUEST_COLUMNS}
    schema = ", ".join(f"{n} double" for n in REQUEST_COLUMNS)
    return predict_batch(spark.createDataFrame([tuple(float(v) if v is not None else None for v in row.values())],
                                               schema), model)


# SC7 ------------------------------------------------------------------------
def model_status(spark, model) -> DataFrame:
    meta = model.metadata()
    return spark.createDataFrame([(meta["model_type"], meta["n_features"], meta["n_samples"], ",".join(model.features))],
                                 "model_type string, n_features int, n_samples long, features string")


# SC8 ------------------------------------------------------------------------
SCENARIO_MIXES = [  # engine's own mixes (the reference documents the names only)
    ("balanced", 0.34, 0.33, 0.33),
    ("reel_heavy", 0.2, 0.6, 0.2),
    ("post_focused", 0.6, 0.2, 0.2),
]


def scenario_sweep(base: DataFrame, model) -> DataFrame:
    """Every base row under each content mix (explode of a 3-entry literal array) scored by SC5."""
    mixes = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(a)).alias("share_posts"),
                               F.lit(float(b)).alias("share_reels"), F.lit(float(c)).alias("share_stories"))
                      for n, a, b, c in SCENARIO_MIXES])
    x = (base.drop(*[c for c in C.SHARE_COLUMNS if c in base.columns])
         .select("*", F.explode(mixes).alias("_mix")).select("*", "_mix.*").drop("_mix"))
    return predict_batch(x, model)
