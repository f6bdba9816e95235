"""Records arrays cut at any byte: the rows must be those of Spark's whole-file reader."""

import json
import os
import random

import pytest

from growthspark.sources import io as IO
from growthspark.sources import json_array as J

BITS = ["a", "}", "{", "]", "[", '"', "\\", "\n", "é", "},{", '\\"', "\\\\", ",", " ", "😀", "x" * 200, "\\u007d", "/"]


def records(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(BITS) for _ in range(rng.randint(0, 6)))
    return [{"id": i, "s": text(), "o": {"k": text(), "deep": {"l": [text(), text()]}}, "a": [{"v": j, "t": text()} for j in range(rng.randint(0, 3))],
             "n": rng.choice([None, 1.5, True and 2.0])} for i in range(n)]


def rows(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("seed", "style"), [(2, {"indent": 2}), (3, {"ensure_ascii": False, "separators": (",", ":")})])
def test_same_rows_as_the_whole_file_reader(spark, small_splits, tmp_path, seed, style):
    for part in range(2):
        (tmp_path / f"p{part}.json").write_text(json.dumps(records(seed + 10 * part, 14), **style))
    path = str(tmp_path)
    want = spark.read.option("multiLine", True).json(path)
    assert J.is_records_array(spark, path)
    got = IO.load_dataframe(spark, path, "json")
    assert got.schema == want.schema
    assert rows(got) == rows(want)
    assert rows(J.read_records_array(spark, path, want.schema)) == rows(want)


def test_one_file_is_read_by_many_tasks(spark, small_splits, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(records(5, 40)))
    size = os.path.getsize(tmp_path / "one.json")
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() >= size // 300
    assert J.record_texts(spark, str(tmp_path)).count() == 40


def test_odd_files(spark, small_splits, tmp_path):
    (tmp_path / "a.json").write_text("  \n[]\n")
    (tmp_path / "b.json").write_text('[{}, {"a": {}}, "}{", 5, null, {"a": {"b": "]"}}]  \n')
    (tmp_path / "c.json").write_text("[" + json.dumps({"a": {"b": "y}" * 600}}) + "]")  # a record over many splits
    got = sorted(r[0] for r in J.record_texts(spark, str(tmp_path)).collect())
    assert json.dumps({"a": {"b": "y}" * 600}}) in got
    assert '{"a": {"b": "]"}}' in got and "{}" in got


def test_written_arrays_come_back(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else "q\"}{", float(i)) for i in range(50)], "i long, s string, d double").repartition(3)
    path = str(tmp_path / "out")
    J.write_records_array(df, path)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert sum(len(json.load(open(os.path.join(path, f)))) for f in files) == 50
    assert rows(J.read_records_array(spark, path, df.schema)) == rows(df)
