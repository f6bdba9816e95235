"""Line dedup by winnowing over line hashes (operator 4).

A run is a stretch of consecutive non-blank lines (blank edges of a line do not
count).  Every run of at least ``MIN_WORDS`` words that occurred before, in an
earlier document or earlier in the same one, is deleted; the first stays.

Windows are the shortest runs of ``MIN_WORDS`` words that begin, or end, at
each line; any repeated run of that many words is a union of repeated windows.
The fingerprint of a window is its smallest line hash.  Fingerprints that occur
once are dropped; around the others the match is extended both ways, by
comparing the windows that hold them by the digest of their lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthspark.llm.common import small_batches, stage, text_mark

MIN_WORDS = 50

_WINDOW = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("print", pa.int64()), ("lines", pa.binary())])
_WINDOW_DDL = "array<struct<start:int,stop:int,print:long,lines:binary>>"


def line_windows(text: str, min_words: int = MIN_WORDS) -> tuple[list[dict], list[tuple[int, int]]]:
    """(windows, fingerprints): windows by non-blank line number, fingerprints as (line number, hash)."""
    lines = [s for s in (x.strip() for x in text.split("\n")) if s]
    if not lines:
        return [], []
    upto = np.concatenate(([0], np.cumsum([len(s.split()) for s in lines])))
    n = len(lines)
    spans = set()
    stops = np.searchsorted(upto, upto[:-1] + min_words)       # shortest run from each line
    spans.update((i, int(j)) for i, j in enumerate(stops) if j <= n)
    starts = np.searchsorted(upto, upto[1:] - min_words, "right") - 1  # and up to each line
    spans.update((int(i), j + 1) for j, i in enumerate(starts) if i >= 0)
    if not spans:
        return [], []
    digest = [xxhash.xxh3_128_digest(s.encode("utf-8", "replace")) for s in lines]
    small = [int.from_bytes(d[:8], "little", signed=True) for d in digest]
    windows, prints = [], {}
    for i, j in sorted(spans):
        at = min(range(i, j), key=small.__getitem__)
        prints[at] = small[at]
        windows.append({"start": i, "stop": j, "print": small[at], "lines": xxhash.xxh3_128_digest(b"".join(digest[i:j]))})
    return windows, sorted(prints.items())


def cut_lines(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """(text without the non-blank lines in the spans, number of lines deleted)."""
    gone = {k for a, b in spans for k in range(a, b)}
    out, k, n = [], -1, 0
    for line in text.split("\n"):
        if line.strip():
            k += 1
            if k in gone:
                n += 1
                continue
        out.append(line)
    return "\n".join(out), n


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, start, stop, first_id): windows that occurred before, and the document that had them first."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            got = [line_windows(t or "", min_words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array([w for w, _ in got], pa.list_(_WINDOW)),
                 pa.array([[h for _, h in p] for _, p in got], pa.list_(pa.int64()))], names=["doc_id", "mark", "windows", "prints"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    rows = stage(source.mapInArrow(run, f"doc_id long, mark long, windows {_WINDOW_DDL}, prints array<long>"), "windows")
    common = rows.select(F.explode("prints").alias("print")).groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    windows = rows.select("doc_id", "mark", F.explode("windows").alias("w")).select("doc_id", "mark", "w.start", "w.stop", "w.print", "w.lines")
    likely = stage(windows.join(stage(common, "prints"), "print", "left_semi").drop("print"), "likely")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("mark"), F.col("start"))
    first = likely.groupBy("lines").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "lines", F.col("f.doc_id").alias("first_id"), F.col("f.mark").alias("first_mark"), F.col("f.start").alias("first_start"))
    later = likely.join(stage(first, "first"), "lines")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    # within one document, lines of the first occurrence itself stay
    begin = F.when(same, F.greatest("start", F.col("first_start") + F.col("stop") - F.col("start"))).otherwise(F.col("start"))
    return later.where(~(same & (F.col("start") == F.col("first_start")))).select("doc_id", "mark", begin.alias("start"), "stop", "first_id").where("start < stop")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Delete repeated runs: doc_id, text, n_removed, spans, first_ids for every row.

    spans are the deleted ranges of non-blank lines (start, stop; merged) and
    first_ids the documents that had them first (sorted; null ids last in
    order, so they are named only among themselves).  Documents stand by
    doc_id, then text hash; rows equal in both are one document and get the
    same result.  Null text stays null, empty text empty; a text may become
    empty.  Lines shared in runs of fewer words stay.  Extra columns are
    ignored; empty input gives no rows.
    """
    spans = stage(repeated_spans(docs, min_words, id_col, text_col), "spans")
    per_doc = spans.groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("cuts"), F.array_sort(F.collect_set("first_id")).alias("first_ids"))
    per_doc = stage(per_doc, "cuts").select(F.col("doc_id").alias("cut_id"), F.col("mark").alias("cut_mark"), "cuts", "first_ids")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    # the same join at every size: the cuts grow with the corpus, so they are never broadcast
    joined = rows.join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("mark") == F.col("cut_mark")), "left").select(
        "doc_id", "text", "cuts", "first_ids")

    def run(batches):
        for batch in batches:
            texts, removed, merged = [], [], []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                spans: list[list[int]] = []
                for c in cuts or []:
                    if spans and c["start"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], c["stop"])
                    else:
                        spans.append([c["start"], c["stop"]])
                new, n = cut_lines(text, spans) if spans else (text, 0)
                texts.append(new)
                removed.append(n)
                merged.append([{"start": a, "stop": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int64()),
                 pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                 batch.column("first_ids")], names=["doc_id", "text", "n_removed", "spans", "first_ids"])

    out = joined.mapInArrow(run, "doc_id long, text string, n_removed long, spans array<struct<start:int,stop:int>>, first_ids array<long>")
    return out.withColumn("first_ids", F.coalesce("first_ids", F.array().cast("array<bigint>")))
