"""Readers, writers and catalog (SRC1-SRC5, SNK1-SNK4, CAT1-CAT2).

Writers never rename or overwrite in place (object stores have no atomic
rename): every save goes to a new versioned folder ``<path>/v=<timestamp>-<random>``
with ``errorifexists``; the newest version is the current one.  Daily data
is written partitioned by month of ``date`` so date filters prune folders.
Excel is not supported (single-machine format).
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators import quality as Q
from .json_array import is_records_array, read_records_array, write_records_array

ZONES = ("raw", "interim", "processed", "external")
DEFAULT_FILES = {"raw": "creator_daily_metrics.csv", "interim": "cleaned.parquet",
                 "processed": "features.parquet", "external": "benchmarks.csv"}


def raw_schema() -> T.StructType:
    """Canonical daily schema as read from text (date kept as text, parsed after)."""
    f = [T.StructField("username", T.StringType()), T.StructField("date", T.StringType())]
    for c in C.INT_COLUMNS:
        f.append(T.StructField(c, T.LongType()))
    for c in C.FLOAT_COLUMNS:
        f.append(T.StructField(c, T.DoubleType()))
    f.append(T.StructField("post_time", T.StringType()))
    return T.StructType(f)


# CAT2 -----------------------------------------------------------------------
def get_data_path(root: str, data_type: str, filename: str | None = None) -> str:
    if data_type not in ZONES:
        raise ValueError(f"unknown data zone {data_type!r}; expected one of {ZONES}")
    return os.path.join(root, data_type, filename or DEFAULT_FILES[data_type])


def _folder(spark: SparkSession, path: str):
    """(Hadoop file system, path object): listings of one folder, in any store Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what stands directly in ``path``; empty if it does not exist."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    return sorted((x.getPath().getName(), x.isDirectory()) for x in fs.listStatus(p))


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder and all in it."""
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def finished(spark: SparkSession, path: str) -> bool:
    """A folder's writer has committed it: ``_SUCCESS`` in it, or in every folder of it."""
    found = children(spark, path)
    if any(name == "_SUCCESS" for name, _ in found):
        return True
    inner = [name for name, folder in found if folder]
    return bool(inner) and all(finished(spark, os.path.join(path, name)) for name in inner)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Finished version folders of ``path``, oldest first: one listing, no data file is looked at."""
    names = [name for name, folder in children(spark, path) if folder and name.startswith("v=")]
    return [v for v in (os.path.join(path, n) for n in names) if finished(spark, v)]


def current_version(spark: SparkSession, path: str) -> str:
    vs = versions(spark, path)
    return vs[-1] if vs else path


# SRC1 -----------------------------------------------------------------------
def load_raw_data(spark: SparkSession, path: str, validate: bool = True, date_format: str = "d-M-yyyy",
                  ranges: dict | None = None):
    """CSV with header -> typed frame; returns (frame or None if invalid, issues, bad_dates).

    ``ranges``: {column: (lowest, highest)} for DQ5; None takes the business
    bounds of ``RANGE_CONSTRAINTS``.
    """
    # read every column as text and type it by *name* (a CSV schema would bind by position)
    text = spark.read.option("header", True).csv(path)
    kinds = {f.name: f.dataType for f in raw_schema().fields}
    sel = []
    for c in text.columns:
        t = kinds.get(c)
        if isinstance(t, T.LongType):
            sel.append(F.col(c).try_cast("double").try_cast("long").alias(c))
        elif isinstance(t, T.DoubleType):
            sel.append(F.col(c).try_cast("double").alias(c))
        else:
            sel.append(F.col(c))
    df = text.select(*sel).withColumn("date", F.to_date(F.try_to_timestamp(F.trim("date"), F.lit(date_format))))
    bad_dates = (text.select(F.to_date(F.try_to_timestamp(F.trim("date"), F.lit(date_format))).alias("d"), "date")
                 .where(F.col("d").isNull() & F.col("date").isNotNull()).count())
    issues = Q.validate_raw_data_schema(df, Q.business_ranges() if ranges is None else ranges) if validate else None
    if validate and Q.verdict(issues).collect()[0]["is_valid"] is False:
        return None, issues, bad_dates
    return df, issues, bad_dates


# SRC2 -----------------------------------------------------------------------
def load_processed_data(spark: SparkSession, path: str, feature_set: str = "full", fmt: str = "parquet"):
    """Feature table; dates parsed if text; validated (DQ12) but returned anyway."""
    df = spark.read.format(fmt).option("header", True).option("inferSchema", True).load(path)
    for c in ("date", "week_start", "week_end"):
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, F.to_date(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd"))))
    return df, Q.validate_processed_data_schema(df, feature_set)


# SRC3 -----------------------------------------------------------------------
def load_external_data(spark: SparkSession, path: str):
    """Benchmark / competitor table (CSV, inferred schema); missing path -> None."""
    if not exists(spark, path):
        return None
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


# SRC4 / SNK2 ----------------------------------------------------------------
def save_train_test_split(train: DataFrame, test: DataFrame, root: str) -> tuple[str, str]:
    return save_dataframe(train, os.path.join(root, "train"), "parquet"), \
        save_dataframe(test, os.path.join(root, "test"), "parquet")


def load_train_test_data(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.parquet(current_version(spark, os.path.join(root, "train"))),
            spark.read.parquet(current_version(spark, os.path.join(root, "test"))))


# SRC5 -----------------------------------------------------------------------
def load_dataframe(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """csv / json (lines or a records array) / parquet by extension or explicit format."""
    if fmt == "auto":
        ext = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
        fmt = {"csv": "csv", "json": "json", "parquet": "parquet", "pq": "parquet"}.get(ext)
        if fmt is None:
            if path.rstrip("/").rsplit("/", 1)[-1].startswith("v="):
                fmt = "parquet"
            else:
                raise ValueError(f"cannot infer the format of {path}; xlsx is not supported")
    r = spark.read
    if fmt == "csv":
        r = r.option("header", True).option("inferSchema", True)
    elif fmt == "json":
        if is_records_array(spark, path):  # one array per file: cut at record borders, many tasks per file
            return read_records_array(spark, path)
    return r.format(fmt).load(path)


# versions -------------------------------------------------------------------
def new_version(path: str) -> str:
    """A version folder no other writer has: names order by time, a random part tells writers of one millisecond apart."""
    return os.path.join(path, f"v={int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}")


def retire_versions(spark: SparkSession, path: str, keep: int = 3) -> list[str]:
    """Removes all but the ``keep`` newest committed versions; returns what was removed.

    Folders without a commit mark are left alone: their writer may be at work.
    """
    if keep < 1:
        raise ValueError("the current version cannot be retired")
    old = versions(spark, path)[:-keep]
    for version in old:
        remove(spark, version)
    return old


# SNK1 / SNK3 ----------------------------------------------------------------
def save_dataframe(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> str:
    """Write to a :func:`new_version` of ``path`` with errorifexists; returns the version path.

    ``records``: JSON files that hold a records array each.
    """
    if fmt in ("excel", "xlsx"):
        raise ValueError("excel output is not supported")
    target = new_version(path)
    if fmt == "records":
        write_records_array(df, target)
        return target
    w = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(target)
    return target


def save_daily(df: DataFrame, path: str) -> str:
    """Daily metrics partitioned by month of date (prunable by date filters)."""
    return save_dataframe(df.withColumn("month_partition", F.date_format("date", "yyyy-MM")), path, "parquet",
                          ["month_partition"])


# SNK4 -----------------------------------------------------------------------
def save_model(model, spark: SparkSession, path: str) -> str:
    """Coefficient table (feature, coef, center, scale, median) + JSON metadata row."""
    target = new_version(path)
    model.coefficient_table(spark).coalesce(1).write.mode("errorifexists").parquet(os.path.join(target, "coefficients"))
    meta = {**model.metadata(), "created_at": time.strftime("%Y-%m-%dT%H:%M:%S")}
    spark.createDataFrame([(json.dumps(meta, default=str),)], "metadata string").coalesce(1).write.mode(
        "errorifexists").json(os.path.join(target, "metadata"))
    return target


def load_model(spark: SparkSession, path: str):
    """Restore a GrowthModel from the newest saved version."""
    import numpy as np
    from ..operators import gram as G
    from ..operators.models import GrowthModel
    base = current_version(spark, path)
    rows = spark.read.parquet(os.path.join(base, "coefficients")).collect()
    meta = json.loads(spark.read.json(os.path.join(base, "metadata")).collect()[0]["metadata"])
    feats = [r for r in rows if r["feature"] != "__intercept__"]
    b0 = [r for r in rows if r["feature"] == "__intercept__"][0]["coef"]
    fit = G.Fit([r["feature"] for r in feats], np.array([r["coef"] for r in feats]), b0,
                np.array([r["center"] for r in feats]), np.array([r["scale"] for r in feats]),
                meta["n_samples"], float(meta["train_metrics"].get("mse", 0.0)) * meta["n_samples"], 0.0)
    med = {r["feature"]: r["median"] for r in feats if r["median"] is not None}
    return GrowthModel(fit, meta["model_type"], meta["target"], meta.get("alpha", 1.0), meta.get("l1_ratio", 0.5),
                       med, meta["train_metrics"], meta.get("cv"), meta.get("date_col", "week_start"))


# CAT1 -----------------------------------------------------------------------
def list_available_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Dataset names per zone: one folder listing each."""
    rows = [(z, name) for z in ZONES for name, _ in children(spark, os.path.join(root, z)) if not name.startswith(("_", "."))]
    return spark.createDataFrame(rows, "zone string, dataset string")
