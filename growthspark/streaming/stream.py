"""Structured Streaming: the row-local operators on ``readStream``.

* ``score_stream`` -- SC5 scenario scoring (defaults, bounds, share
  normalisation, linear predictor, interval, category, advice) on a stream of
  request rows: one codegen stage, no state.
* ``weekly_stream`` -- AG1 on a stream of daily rows.  Each micro-batch writes
  its days' partials by creator, week and post time; what is read is their
  merge.  A day may come any time later: its week takes it in, and the result
  is that of the batch operator on all days.  No state is held between
  batches and no watermark closes a week.

The sinks are Parquet folders below the shared folder: nothing is kept on the
driver.

Both run with ``trigger(availableNow=True)`` in batch-like jobs and tests; a
real deployment uses a processing-time trigger and a checkpoint location in
the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators import score as SC
from ..operators import weekly as W
from ..sources import io as IO
from ..session import ensure_checkpoint_dir, scratch_path


def _checkpoint(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def _append(df: DataFrame, name: str) -> str:
    """Run the stream to the end of what has arrived; returns the folder of its sink."""
    path = scratch_path(df.sparkSession, f"sinks/{name}")
    q = (df.writeStream.format("parquet").option("path", path).outputMode("append")
         .option("checkpointLocation", _checkpoint(df.sparkSession, name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return path


def score_stream(spark: SparkSession, source_path: str, schema, model, sink_name: str) -> DataFrame:
    """Score every request row arriving under ``source_path``; returns the sink as a DataFrame."""
    src = spark.readStream.schema(schema).parquet(source_path)
    scored = SC.predict_batch(src, model)
    return spark.read.schema(scored.schema).parquet(_append(scored, sink_name))


# AG1 --------------------------------------------------------------------------
FOLD_EVERY = 16  # partial tables that are folded into one


def _numbered(spark: SparkSession, root: str, kind: str) -> dict[int, str]:
    """The committed folders ``<kind>=<batch>`` of ``root`` by batch; those without a commit mark are not seen."""
    names = {int(n.split("=")[1]): os.path.join(root, n) for n, folder in IO.children(spark, root) if folder and n.startswith(f"{kind}=")}
    return {k: p for k, p in sorted(names.items()) if IO.finished(spark, p)}


def _live(spark: SparkSession, root: str, before: int | None = None) -> list[str]:
    """The newest folded table and the partial tables of later batches (of batches below ``before``)."""
    wanted = lambda k: before is None or k < before
    folded = {k: p for k, p in _numbered(spark, root, "folded").items() if wanted(k)}
    last = max(folded, default=-1)
    return [folded[k] for k in folded if k == last] + [p for k, p in _numbered(spark, root, "part").items() if k > last and wanted(k)]


def upsert_week_partials(days: DataFrame, batch: int, root: str, creator: str = "username", fold_every: int = FOLD_EVERY) -> None:
    """Adds a micro-batch's days to the weekly table at ``root``.

    A batch has a folder of its own, so a batch that is run again (after a lost
    driver) replaces what it wrote and counts once.  Every ``fold_every``
    batches the tables so far are merged into one, which is committed beside
    them; what the fold before the last stood for is removed.
    """
    spark = days.sparkSession
    W.weekly_partials(days, creator).write.mode("overwrite").parquet(os.path.join(root, f"part={batch}"))
    if (batch + 1) % fold_every:
        return
    earlier = [k for k in _numbered(spark, root, "folded") if k < batch]
    parts = [*_live(spark, root, before=batch), os.path.join(root, f"part={batch}")]
    merged = W.merge_partials(_read_all(spark, parts), creator)
    merged.write.mode("overwrite").parquet(os.path.join(root, f"folded={batch}"))
    for kind in ("part", "folded"):  # a reader may still hold the tables of the last fold
        for k, path in _numbered(spark, root, kind).items():
            if earlier and (k < earlier[-1] or (kind == "part" and k == earlier[-1])):
                IO.remove(spark, path)


def _read_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    # the folder names are no partition columns: each table is read by itself
    return reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in paths])


def read_weeks(spark: SparkSession, root: str, creator: str = "username") -> DataFrame | None:
    """AG1 of all days that have been taken in at ``root``; None before the first batch."""
    live = _live(spark, root)
    return W.finish_weekly(_read_all(spark, live), creator_col=creator) if live else None


def weekly_stream(spark: SparkSession, source_path: str, schema, sink_name: str, creator: str = "username",
                  files_per_batch: int | None = None, fold_every: int = FOLD_EVERY) -> DataFrame:
    """AG1 of the daily rows that have arrived below ``source_path``, late ones included.

    A second call with the same ``sink_name`` takes in what has arrived since.
    """
    root = scratch_path(spark, f"sinks/{sink_name}")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    q = (reader.parquet(source_path).writeStream.foreachBatch(lambda days, batch: upsert_week_partials(days, batch, root, creator, fold_every))
         .option("checkpointLocation", _checkpoint(spark, sink_name)).trigger(availableNow=True).start())
    q.awaitTermination()
    weeks = read_weeks(spark, root, creator)
    if weeks is None:  # nothing has arrived
        weeks = W.finish_weekly(W.weekly_partials(spark.createDataFrame([], schema), creator), creator_col=creator)
    return weeks
