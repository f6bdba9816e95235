"""Records arrays: JSON files that hold one array of objects (SRC5, SNK3).

Spark reads such a file as a whole (``multiLine``).  Here it is cut anywhere:
the text source splits it into fragments that end at a closing brace, and what
a fragment is depends on two numbers at its start only, whether a string is
open and how deep the nesting is.  A first pass sums up, per file split, how it
changes both; running sums over the splits give each one's start; a second pass
cuts out the records.  The ends of records that cross splits are put together
by the split they begin in.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

CLOSE = "}"
QUOTED = re.compile(r'\\.|"|\{', re.S)


def _outside(fragment: str, inside: bool) -> tuple[int, bool]:
    """(nesting opened less closed outside of strings, whether a string is open at the end)."""
    if "\\" in fragment:  # an escape never spans fragments: no escape ends with a brace
        fragment = fragment.replace("\\\\", "").replace('\\"', "")
    parts = fragment.split('"')
    bare = "".join(parts[inside::2])
    return bare.count("{") + bare.count("[") - bare.count("]") - bare.count("}"), inside ^ (len(parts) % 2 == 0)


def _change(fragment: str, inside: bool) -> tuple[int, bool]:
    """The same with the closing brace behind the fragment."""
    depth, inside = _outside(fragment, inside)
    return depth - (not inside), inside


def _record_start(fragment: str, inside: bool) -> int:
    """Place of the first brace that opens outside of strings, or -1."""
    for m in QUOTED.finditer(fragment):
        if m[0] == '"':
            inside = not inside
        elif m[0] == "{" and not inside:
            return m.start()
    return -1


def _summaries(batches):
    """(file, block, odd, flat, within) per file split: changes if it starts outside (flat) or in a string (within)."""
    key, odd, flat, within = None, 0, 0, 0
    names = ["file", "block", "odd", "flat", "within"]

    def rows(found):
        cols = list(zip(*found))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    for batch in batches:
        done = []
        for file, block, text in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
            if (file, block) != key:
                if key:
                    done.append((*key, odd, flat, within))
                key, odd, flat, within = (file, block), 0, 0, 0
            a, after = _change(text, bool(odd))
            b, _ = _change(text, not odd)
            flat, within, odd = flat + a, within + b, int(after)
        if done:
            yield rows(done)
    if key:
        yield rows([(*key, odd, flat, within)])


def _cut(batches):
    """Records of each split (piece 0), and the parts of records that cross into it (1) or out of it (2)."""
    key, inside, depth = None, False, 0
    buffer: list[str] = []
    begun = False  # the open record begins in this split

    def rows(found):
        cols = list(zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3])],
                                          names=["file", "block", "piece", "record"])

    for batch in batches:
        done = []
        for file, block, at_inside, at_depth, text in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "inside", "depth", "value"))):
            if (file, block) != key:
                if buffer:
                    done.append((*key, 2 if begun else 1, "".join(buffer)))
                key, inside, depth, buffer = (file, block), bool(at_inside), at_depth, []
                begun = depth < 2
                if not begun:
                    buffer.append("")
            if not buffer:
                start = _record_start(text, inside) if depth <= 1 else 0
                if start >= 0:
                    buffer.append(text[start:])
                    begun = True
            else:
                buffer.append(text)
            change, inside = _change(text, inside)
            depth += change
            if buffer:
                buffer.append(CLOSE)
                if not inside and depth <= 1:
                    done.append((*key, 0 if begun else 1, "".join(buffer)))
                    buffer = []
        if done:
            yield rows(done)
    if buffer:
        yield rows([(*key, 2 if begun else 1, "".join(buffer))])


def record_texts(spark: SparkSession, path) -> DataFrame:
    """One row ``record`` per object of the records arrays in ``path``; no order."""
    raw = (spark.read.option("lineSep", CLOSE).text(path)
           .select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"))
    splits = raw.mapInArrow(_summaries, "file long, block long, odd int, flat long, within long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    splits = splits.withColumn("change", F.when(F.col("inside") == 0, F.col("flat")).otherwise(F.col("within")))
    starts = splits.select("file", "block", F.col("inside").cast("int").alias("inside"), F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"))
    # 28 bytes per file split (spark.sql.files.maxPartitionBytes of text); the probed side keeps its order
    found = (raw.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "inside", "depth", "value")
             .mapInArrow(_cut, "file long, block long, piece int, record string"))
    whole = found.where("piece = 0").select("record")
    # a record that crosses splits: its parts are named by the split it begins in
    parts = found.where("piece > 0")
    first = F.last(F.when(F.col("piece") == 2, F.col("block")), ignorenulls=True)
    upto = Window.partitionBy("file").orderBy("block", "piece")
    crossing = (parts.withColumn("begun", first.over(upto)).groupBy("file", "begun")
                .agg(F.array_sort(F.collect_list(F.struct("block", "piece", "record"))).alias("p")).select(F.array_join("p.record", "").alias("record")))
    return whole.unionByName(crossing)


def read_records_array(spark: SparkSession, path, schema=None) -> DataFrame:
    """Table of the records arrays in ``path``, as ``multiLine`` reads them, but each file by many tasks.

    Files must be valid, their elements objects or scalars; scalars are passed over.  With a
    schema the records are parsed as they are cut; without, they are written
    below the shared checkpoint folder as JSON lines, whose types Spark infers.
    """
    lines = record_texts(spark, path).select(F.translate("record", "\n\r", "  ").alias("value"))
    if schema is not None:
        return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    target = scratch_path(spark, f"json-lines-{spark.range(1).select(F.expr('uuid()')).first()[0]}")
    lines.write.mode("errorifexists").text(target)
    return spark.read.json(target)


def is_records_array(spark: SparkSession, path) -> bool:
    """Whether the JSON in ``path`` starts with an array; no file is read as a whole."""
    first = spark.read.option("lineSep", "[").text(path).limit(1).collect()
    return bool(first) and not first[0][0].strip("\ufeff \t\r\n")


def write_records_array(df: DataFrame, path: str) -> None:
    """Every partition as a file that holds one records array, a record a line."""

    def lines(batches):
        lead = "["
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out.append(lead + text)
                lead = ","
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], names=["value"])

    texts = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
    texts.mapInArrow(lines, "value string").write.mode("errorifexists").text(path)
