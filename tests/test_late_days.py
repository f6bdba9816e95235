"""AG1 on a stream: late days, batches run twice, folding; its rows are those of the batch operator."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from growthspark.operators import weekly as W
from growthspark.session import scratch_path
from growthspark.sources import fixtures as FX
from growthspark.sources import io as IO
from growthspark.streaming import stream as ST


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=str)


def fresh(spark):
    return scratch_path(spark, f"weeks-test-{uuid.uuid4().hex}")


@pytest.fixture(scope="module")
def daily(spark, sf):
    return FX.daily_metrics(spark, sf).cache()


def test_two_levels_equal_one(spark, daily):
    """Nulls in every column, ties of post times, a creator-week of many rows."""
    h = F.xxhash64("username", "date")
    holes = [F.when(F.pmod(h, F.lit(5 + i)) != 0, F.col(c)).alias(c) if c not in ("username", "date") else F.col(c) for i, c in enumerate(daily.columns)]
    odd = daily.select(*holes)
    assert rows(W.finish_weekly(W.weekly_partials(odd))) == rows(W.create_weekly_features(odd))
    no_time = odd.drop("post_time", "followers")
    assert rows(W.finish_weekly(W.weekly_partials(no_time))) == rows(W.create_weekly_features(no_time))
    assert W.finish_weekly(W.weekly_partials(odd.limit(0))).count() == 0


def test_late_days_repeats_and_folds(spark, daily):
    root = fresh(spark)
    share = lambda k: daily.where(F.pmod(F.xxhash64("date", "username"), F.lit(7)) == k)
    assert ST.read_weeks(spark, root) is None
    for k in range(7):
        ST.upsert_week_partials(share(k), k, root, fold_every=2)
        if k in (2, 3, 5):  # the driver was lost after the write: the batch comes again
            ST.upsert_week_partials(share(k), k, root, fold_every=2)
    assert rows(ST.read_weeks(spark, root)) == rows(W.create_weekly_features(daily))
    names = [n for n, _ in IO.children(spark, root)]
    assert "folded=5" in names and "folded=3" in names and "folded=1" not in names
    assert "part=6" in names and not {f"part={k}" for k in range(4)} & set(names)


def test_a_batch_without_commit_is_not_read(spark, daily):
    root = fresh(spark)
    ST.upsert_week_partials(daily, 0, root)
    before = rows(ST.read_weeks(spark, root))
    ST.upsert_week_partials(daily, 1, root)
    os.remove(os.path.join(root.removeprefix("file:"), "part=1", "_SUCCESS"))
    assert rows(ST.read_weeks(spark, root)) == before


def test_stream_takes_days_years_late(spark, daily):
    src, name = fresh(spark), f"late-{uuid.uuid4().hex}"
    first, last = daily.agg(F.min("date"), F.max("date")).first()
    old = F.col("date") < F.lit(first + (last - first) / 3)
    empty = fresh(spark)
    daily.limit(0).write.parquet(empty)
    assert ST.weekly_stream(spark, empty, daily.schema, f"none-{uuid.uuid4().hex}").count() == 0
    daily.where(~old).repartition(3).write.parquet(src)
    ST.weekly_stream(spark, src, daily.schema, name, files_per_batch=1, fold_every=2)
    daily.where(old).write.mode("append").parquet(src)
    assert daily.where(old).count() > 0
    assert rows(ST.weekly_stream(spark, src, daily.schema, name, files_per_batch=2, fold_every=2)) == rows(W.create_weekly_features(daily))
