"""Exact dedup by content-defined chunk recipes (operator 9).

Each text (white space deleted) is cut where a rolling hash of its bytes says
so.  A chunk is named by a 64-bit key that is checked against the chunk's
SHA-256 over the whole corpus: a key that stands for two contents is replaced
by the digest.  Two texts are equal when their ordered lists of chunk names
are.  Only names move between tasks, never the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthspark.llm.common import keep_marked, small_batches, stage, text_mark, utf8

WINDOW = 16          # bytes that decide a cut
MIN_CHUNK = 512      # bytes
MAX_CHUNK = 8192
CUT_BITS = 10        # a cut every 1024 bytes on average beyond the minimum

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_MULT = np.uint64(0x9E3779B97F4A7C15)


def cuts(data: np.ndarray) -> list[int]:
    """End offsets of the chunks of ``data``; a cut depends on the 16 bytes before it."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    lanes = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(lanes).view("<u8").ravel()
    mixed = words[:-8] * _MULT
    mixed ^= mixed >> np.uint64(29)
    mixed = (mixed + words[8:]) * _MULT
    marks = np.flatnonzero(mixed >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    out, start = [], 0
    while n - start > MIN_CHUNK:
        i = np.searchsorted(marks, start + MIN_CHUNK)
        end = min(int(marks[i]) if i < len(marks) else n, start + MAX_CHUNK, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


RECIPE = pa.struct([("key", pa.int64()), ("digest", pa.binary())])
_SCHEMA = "doc_id long, mark long, code_points long, text_sha256 string, chunks array<struct<key:long,digest:binary>>"


def _recipes(batches):
    for batch in batches:
        raw, off = utf8(batch.column("text"))
        whole = raw.tobytes()
        points, shas, lists = [], [], []
        for s, e in zip(off[:-1], off[1:]):
            text = whole[s:e]
            points.append(int(e - s) - int(np.count_nonzero((raw[s:e] & 0xC0) == 0x80)))
            text = text.translate(None, _SPACE)
            shas.append(hashlib.sha256(text).hexdigest())
            data, start, chunks = np.frombuffer(text, np.uint8), 0, []
            for end in cuts(data):
                part = text[start:end]
                key = xxhash.xxh3_64_intdigest(part)
                chunks.append({"key": key - (1 << 64) if key >> 63 else key, "digest": hashlib.sha256(part).digest()})
                start = end
            lists.append(chunks)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(points, pa.int64()), pa.array(shas, pa.string()), pa.array(lists, pa.list_(RECIPE))],
            names=["doc_id", "mark", "code_points", "text_sha256", "chunks"])


def named_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row_id, doc_id, mark, code_points, text_sha256, recipe), staged but for the recipe's spelling."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_mark(text_col).alias("mark"))
    rows = stage(source.mapInArrow(_recipes, _SCHEMA).withColumn("row_id", F.monotonically_increasing_id()), "recipes")
    # a key that names two contents is no identifier: such chunks go by their digest
    parts = rows.select("row_id", F.posexplode("chunks").alias("pos", "c")).select("row_id", "pos", "c.key", "c.digest")
    clash = parts.groupBy("key").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("key")
    clash = stage(clash, "clashes")
    # documents touched by a clash get their list renamed; the others' keys are verified as they stand
    fixed = (parts.join(parts.join(clash, "key", "left_semi").select("row_id").distinct(), "row_id", "left_semi")
             .join(clash.withColumn("bad", F.lit(True)), "key", "left")
             .withColumn("name", F.when(F.col("bad"), F.concat(F.lit("d"), F.hex("digest"))).otherwise(F.concat(F.lit("k"), F.hex("key"))))
             .groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("l"))
             .select("row_id", F.expr("array_join(transform(l, x -> x.name), '')").alias("renamed")))
    plain = F.array_join(F.transform("chunks", lambda c: F.concat(F.lit("k"), F.hex(c["key"]))), "")
    if clash.isEmpty():  # the join below would add nothing
        named = rows.withColumn("recipe", plain)
    else:
        named = rows.join(fixed, "row_id", "left").withColumn("recipe", F.coalesce("renamed", plain))
    return named.select("row_id", "doc_id", "mark", "code_points", "text_sha256", "recipe")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of :func:`named_recipes` with group_size, keep (the kept row's id) and keep_row (null: alone)."""
    named = named_recipes(docs, id_col, text_col)
    best = F.min(F.struct((-F.col("code_points")).alias("p"), F.col("doc_id").isNull().alias("z"),
                          F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id")))
    groups = (named.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best.alias("b"))
              .where("group_size > 1")
              .select("recipe", "group_size", F.col("b.doc_id").alias("keep"), F.col("b.row_id").alias("keep_row")))
    # written, so that the join's two sides are plain shuffles, which Spark splits where a group is large
    return named.join(stage(groups, "groups"), "recipe", "left")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts (equal after deleting ``[\\x20\\x09-\\x0D]``).

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256.  The row with the most code points in its original text,
    then the smallest doc_id, stays (null ids sort last).  Null text counts as
    empty; empty texts are equal to each other.  Repeated rows (same id, same
    text) all count in group_size; exactly one of them is kept.  Extra columns
    are ignored.  Empty input gives no rows.
    """
    return (_grouped(docs, id_col, text_col)
            .select("doc_id",
                    F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    F.coalesce(F.col("keep_row") == F.col("row_id"), F.lit(True)).alias("kept"),
                    "text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns."""
    kept = _grouped(docs, id_col, text_col).where("keep_row is null or keep_row = row_id")
    return keep_marked(docs, kept.select("doc_id", "mark"), id_col, text_col)
