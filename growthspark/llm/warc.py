"""WARC archives: a writer with revisit records, and a salvage reader (operator 7).

The writer is Spark's own text writer, so archives can go to any store Spark
writes to.  The reader takes whole archive files (plain, or gzip with a member
per record), checks each record (version line, header, length, closing lines,
payload digest; for members also the gzip checks), and after a failed check
searches for the next place where a record or member is valid.  The bytes in
between are logged as a quarantined gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from growthspark.llm.common import small_batches, stage

MIN_REVISIT = 100            # payloads below this many bytes are always written in full
# records below so many bytes: at most so many of them in a file (256 MB); any larger record has a file of its own
FILE_CLASSES = [(64 << 10, 4096), (1 << 20, 256), (16 << 20, 16)]
VERSION = b"WARC/1.1"
CLOSING = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_HEADER_END = re.compile(rb"\r\n(?:\r\n|WARC/1\.[01]\r\n)")
_SLICE = 64 << 10            # bytes given to the decompressor at once
_IN_BYTES = 64 << 20         # archive bytes per Arrow batch given to a task, or one file
_OUT_BYTES = 4 << 20         # payload bytes per Arrow batch sent back


# ---------------------------------------------------------------- writer

def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, bytes, refers_to): refers_to is set on the rows that become revisits.

    Of equal payloads of at least ``MIN_REVISIT`` bytes, the row with the
    smallest page_id is written in full (rows that share that id all are), the
    others refer to it; a row without an id refers to it as well.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"),
                        F.octet_length(payload).cast("long").alias("bytes"))
    first = (rows.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # written, so that the join's two sides are plain shuffles, which Spark splits where a payload is common
    rows = rows.join(stage(first, "payloads"), "digest", "left")
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.withColumn("refers_to", F.when(later, F.col("first_id"))).drop("first_id")


def record_text() -> F.Column:
    """A record without its closing lines."""
    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def urn(c: str) -> F.Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    revisit = F.col("refers_to").isNotNull()
    safe_url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")  # a header value is one line
    extra = F.when(revisit, F.concat(line("WARC-Refers-To", urn("refers_to")), line("WARC-Profile", F.lit(PROFILE)),
                                     line("WARC-Payload-Length", F.col("bytes").cast("string")))).otherwise(F.lit(""))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit(VERSION.decode() + "\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")), line("WARC-Target-URI", safe_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("Content-Type", F.lit("text/html; charset=utf-8")),
        extra, line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body)


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    """Write one record per row below ``path`` (a folder in any store Spark writes to).

    Files are bounded by bytes: records are cut into files by size class and by
    their place among the task's rows (:data:`FILE_CLASSES`).
    """
    rows = plan_records(pages, **columns).select(record_text().alias("value"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
    size, kind, chunk = F.octet_length("value"), F.lit(len(FILE_CLASSES)), F.col("place")
    for k, (below, records_per_file) in reversed(list(enumerate(FILE_CLASSES))):
        kind = F.when(size < below, k).otherwise(kind)
        chunk = F.when(size < below, F.floor(F.col("place") / records_per_file)).otherwise(chunk)
    (rows.select("value", kind.alias("size_class"), chunk.alias("chunk"))
     .write.partitionBy("size_class", "chunk").option("lineSep", CLOSING.decode()).text(path))


# ---------------------------------------------------------------- salvage reader

class Found(NamedTuple):
    """A record (reason is None) or a quarantined gap, with its byte range in the archive."""

    start: int
    stop: int
    headers: dict[str, str]
    payload: bytes
    reason: str | None


def _record(data: bytes, at: int) -> tuple[Found | None, str]:
    """The valid record that begins at ``at``, or why there is none."""
    if not _VERSION_LINE.match(data, at):
        return None, "no version line"
    end = _HEADER_END.search(data, at)
    if not end:
        return None, "header does not end"
    if end.group() != CLOSING:  # another record begins first
        return None, "malformed header line"
    head = end.start()
    headers = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep:
            return None, "malformed header line"
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None, "no content length"
    body = head + len(CLOSING)
    stop = body + int(length)
    if data[stop:stop + len(CLOSING)] != CLOSING:
        return None, "record does not end where its length says"
    payload = data[body:stop]
    kind, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if kind == "sha256" and headers.get("warc-type") != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
        return None, "payload digest differs"
    return Found(at, stop + len(CLOSING), headers, payload, None), ""


def _member(data: bytes, at: int) -> tuple[list[Found], int, str]:
    """The records of the gzip member that begins at ``at`` and the member's end, or why it is not valid."""
    if not data.startswith(_MEMBER, at):
        return [], at, "no gzip member"
    unpack, plain, stop = zlib.decompressobj(31), [], at
    try:  # by slices: what is left over of the last one is copied, not the rest of the archive
        while not unpack.eof and stop < len(data):
            plain.append(unpack.decompress(data[stop:stop + _SLICE]))
            stop = min(len(data), stop + _SLICE)
    except zlib.error as e:
        return [], at, f"gzip: {e}"
    if not unpack.eof:
        return [], at, "gzip member does not end"
    stop -= len(unpack.unused_data)
    inner = list(_plain(b"".join(plain)))
    if not inner or any(f.reason for f in inner):
        return [], at, next((f.reason for f in inner if f.reason), "empty member")
    return [f._replace(start=at, stop=stop) for f in inner], stop, ""


def _plain(data: bytes) -> Iterator[Found]:
    at, bad, why = 0, -1, ""
    while at < len(data):
        got, reason = _record(data, at)
        if got:
            if bad >= 0:
                yield Found(bad, at, {}, b"", why)
                bad = -1
            yield got
            at = got.stop
            continue
        if bad < 0:
            bad, why = at, reason
        nxt = _VERSION_LINE.search(data, at + 1)
        at = nxt.start() if nxt else len(data)
    if bad >= 0:
        yield Found(bad, len(data), {}, b"", why)


def _members(data: bytes) -> Iterator[Found]:
    at, bad, why = 0, -1, ""
    while 0 <= at < len(data):
        got, stop, reason = _member(data, at)
        if got:
            if bad >= 0:
                yield Found(bad, at, {}, b"", why)
                bad = -1
            yield from got
            at = stop
            continue
        if bad < 0:
            bad, why = at, reason
        at = data.find(_MEMBER, at + 1)
    if bad >= 0:
        yield Found(bad, len(data), {}, b"", why)


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of an archive, in order; together they cover every byte.

    An archive is compressed if a gzip member comes before any version line.
    """
    member, plain = data.find(_MEMBER), _VERSION_LINE.search(data)
    return _members(data) if member >= 0 and (plain is None or member < plain.start()) else _plain(data)


def _number(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if re.fullmatch(r"-?\d+", tail) else None


_FIELDS = [("archive", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()),
           ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
           ("payload_digest", pa.string()), ("payload", pa.binary())]
_DDL = ("archive string, start long, stop long, reason string, page_id long, url string, record_type string, refers_to long, "
        "payload_bytes long, payload_digest string, payload binary")


def _row(archive: str, f: Found) -> tuple:
    if f.reason:
        return archive, f.start, f.stop, f.reason, None, None, None, None, None, None, None
    h, kind = f.headers, f.headers.get("warc-type")
    size, digest = len(f.payload), hashlib.sha256(f.payload).hexdigest()
    if kind == "revisit":  # its payload stands in the record it refers to
        size, digest = int(h.get("warc-payload-length") or 0), h.get("warc-payload-digest", "").rpartition(":")[2]
    return (archive, f.start, f.stop, None, _number(h.get("warc-record-id")), h.get("warc-target-uri"), kind,
            _number(h.get("warc-refers-to")), size, digest, f.payload)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record and every quarantined gap of the archive files below ``path``.

    Records have a null reason; gaps have a reason and only archive, start and
    stop (byte range, stop exclusive).  An empty file gives no rows.  A file is
    read as a whole by one task, so archives should be of the size of a
    partition.
    """
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_IN_BYTES))

    def run(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], names=[n for n, _ in _FIELDS])

        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size = [], 0
                for f in salvage(content or b""):
                    rows.append(_row(archive, f))
                    size += len(f.payload)
                    if size >= _OUT_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _DDL)


def records(found: DataFrame) -> DataFrame:
    return found.where("reason is null").drop("reason")


def gaps(found: DataFrame) -> DataFrame:
    return found.where("reason is not null").select("archive", "start", "stop", "reason")
