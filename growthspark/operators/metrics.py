"""Prediction metrics (ML11, DG14) as single aggregates.

Every metric is one partial aggregate over the predictions, so a metric row
costs one scan and a tiny final merge, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r2_expr(y, yhat) -> Column:
    """sklearn r2_score: 1 - SSE/SST; SST == 0 -> 1 if SSE == 0 else 0."""
    y, yhat = _c(y).cast("double"), _c(yhat).cast("double")
    sse = F.sum((y - yhat) * (y - yhat))
    sst = F.var_pop(y) * F.count(y)
    return (F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
            .otherwise(1 - sse / sst))


def metric_columns(y="y_true", yhat="y_pred") -> dict[str, Column]:
    y, yhat = _c(y).cast("double"), _c(yhat).cast("double")
    err = y - yhat
    mse = F.avg(err * err)
    return {
        "n": F.count(F.lit(1)),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mae": F.avg(F.abs(err)),
        "r2": r2_expr(y, yhat),
        "mape": F.avg(F.abs(X.safe_divide(err, y))) * 100.0,
        "directional_accuracy": F.avg((F.signum(y) == F.signum(yhat)).cast("double")) * 100.0,
    }


def regression_metrics(pred: DataFrame, y="y_true", yhat="y_pred", by=None,
                       with_bias: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """ML11 (and DG14 with ``with_bias``): one row (per ``by`` group); ``extra``: more aggregates of the same pass."""
    cols = metric_columns(y, yhat) | (extra or {})
    if with_bias:
        cols["bias"] = F.avg(_c(yhat).cast("double") - _c(y).cast("double"))
    aggs = [e.alias(n) for n, e in cols.items()]
    return pred.groupBy(*by).agg(*aggs) if by else pred.agg(*aggs)


def quality_verdict(metrics: DataFrame, min_r2: float = 0.60, min_direction: float = 75.0) -> DataFrame:
    """ML13: warnings on R2 and direction with advice on each; Excellent / Good / Poor."""
    low_r2 = F.col("r2") < min_r2
    low_dir = F.col("directional_accuracy") < min_direction
    n_warn = low_r2.cast("int") + low_dir.cast("int")
    return metrics.select(
        "*",
        low_r2.alias("low_r2"),
        low_dir.alias("low_direction"),
        F.when(n_warn == 0, "Excellent").when(n_warn == 1, "Good").otherwise("Poor").alias("overall_quality"),
        F.concat_ws("; ", F.when(low_r2, C.LOW_R2_ADVICE), F.when(low_dir, C.LOW_DIRECTION_ADVICE)).alias("recommendations"),
    )
