"""Sharding by a minimax contiguous partition (operator 2).

Equal texts form an atomic group.  The groups stand in the order of their text
digest; the smallest capacity that lets 16 contiguous shards hold them all is
found by binary search with a greedy check, and the order is cut there.

The greedy check asks "which group is the last to end at or before x?".  The
driver answers from a table of cells (smallest and largest group end in each
slice of the byte range).  Where the cells cannot decide a check, the slices in
doubt are cut finer by one more pass.  Each pass returns at most ``CELLS`` rows
whatever the corpus.  DataFrame functions only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from growthspark.llm.common import stage

CELLS = 16384     # rows a refining pass returns at most
BUCKETS = 4096    # slices of the digest order that prefix sums are made in
SLOT_BUCKETS = 256 # slices of a shard that rows are numbered in


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, grp): grp is the digest that orders the groups; null text is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("grp"))


def _bucket(grp: str = "grp") -> Column:
    return F.conv(F.substring(grp, 1, 3), 16, 10).cast("int")


def group_ends(rows: DataFrame) -> DataFrame:
    """(grp, bytes, end_at): inclusive prefix sums of the group sizes in digest order."""
    groups = rows.groupBy("grp").agg(F.sum("size").alias("bytes")).withColumn("bucket", _bucket())
    groups = stage(groups, "groups")
    totals = groups.groupBy("bucket").agg(F.sum("bytes").alias("t"))  # at most BUCKETS rows
    base = totals.select("bucket", (F.sum("t").over(W.orderBy("bucket")) - F.col("t")).alias("base"))
    inside = F.sum("bytes").over(W.partitionBy("bucket").orderBy("grp"))
    return groups.withColumn("inside", inside).join(F.broadcast(base), "bucket").select(
        "grp", "bytes", (F.col("base") + F.col("inside")).alias("end_at"))


class Cells:
    """Known group ends: exact points, and slices of which only the first and last end are known."""

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.lo = [c[0] for c in cells]     # smallest end in the cell
        self.hi = [c[1] for c in cells]     # largest
        self.exact = [c[2] <= 2 for c in cells]

    def before(self, x: int) -> tuple[int, int]:
        """Bounds of the largest end that is at most x (0: none)."""
        i = bisect_right(self.lo, x) - 1
        if i < 0:
            return 0, 0
        if self.hi[i] <= x:
            return self.hi[i], self.hi[i]
        return (self.lo[i], self.lo[i]) if self.exact[i] else (self.lo[i], min(x, self.hi[i]))

    def doubtful(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Cells that are not exact and meet the range [lo, hi]."""
        i = bisect_left(self.hi, lo)
        out = []
        while i < len(self.lo) and self.lo[i] <= hi:
            if not self.exact[i]:
                out.append((self.lo[i], self.hi[i]))
            i += 1
        return out


def greedy(cells: Cells, capacity: int, shards: int) -> tuple[list[int], list[int]]:
    """Lower and upper bounds of the cut after each shard when each is filled up to ``capacity``."""
    low, high = [], []
    a = b = 0
    for _ in range(shards):
        a, b = cells.before(a + capacity)[0], cells.before(b + capacity)[1]
        low.append(a)
        high.append(b)
    return low, high


def _cells(ends: DataFrame, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Smallest end, largest end and number of ends in at most CELLS slices of the ranges."""
    each = max(1, CELLS // len(ranges))
    slot = F.lit(None).cast("long")
    for k, (lo, hi) in enumerate(ranges):
        width = max(1, -(-(hi - lo + 1) // each))
        slot = F.when(F.col("end_at").between(lo, hi), F.lit(k * each) + F.floor((F.col("end_at") - lo) / width)).otherwise(slot)
    found = (ends.select("end_at", slot.alias("slot")).where("slot is not null").groupBy("slot")
             .agg(F.min("end_at").alias("lo"), F.max("end_at").alias("hi"), F.count(F.lit(1)).alias("n")))
    return sorted((r["lo"], r["hi"], r["n"]) for r in found.collect())


def minimax_cuts(ends: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the end of each shard in the prefix sums."""
    top = ends.agg(F.max("end_at").alias("total"), F.max("bytes").alias("most")).first()
    if top["total"] is None:
        return 0, [0] * shards
    total, most = int(top["total"]), int(top["most"])
    table = _cells(ends, [(1, total)])
    least, enough = max(most, -(-total // shards)), -(-total // shards) + most  # filling greedily to `enough` always fits
    while True:
        cells = Cells(table)
        doubt: list[int] = []
        lo, hi = least, enough
        while lo < hi:
            mid = (lo + hi) // 2
            low, high = greedy(cells, mid, shards)
            if low[-1] >= total:
                hi = mid
            elif high[-1] < total:
                lo = mid + 1
            else:
                doubt.append(mid)
                break
        if not doubt:
            low, high = greedy(cells, lo, shards)
            if low == high:
                return lo, low
            doubt.append(lo)
        # bounds proved so far hold in later rounds; cut the cells in doubt finer
        least, enough = lo, hi
        low, high = greedy(cells, doubt[0], shards)
        ranges = sorted({r for a, b in zip(low, high) if a != b for r in cells.doubtful(a, b)})
        ranges = ranges[:CELLS // 2]
        gone = set(ranges)
        table = sorted([c for c in table if (c[0], c[1]) not in gone] + _cells(ends, ranges))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into shards 0 to ``shards - 1`` of nearly equal bytes; equal texts stay together.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'),
    shard, slot (gapless from 0 in each shard, ordered by a hash slice, then
    doc_id) and grown_shard (null under this law).  Null text counts as empty
    and forms one group with the empty texts.  Repeated rows are all placed.
    No group is split, so one that outweighs a fair share sets the capacity.
    Empty input gives no rows; extra columns are ignored.
    """
    rows = sizes(docs, id_col, text_col)
    ends = stage(group_ends(rows), "ends")
    _, cuts = minimax_cuts(ends, shards)
    # the digest at which each shard ends turns the assignment into plain comparisons: no join
    borders = {r["end_at"]: r["grp"] for r in ends.where(F.col("end_at").isin(sorted(set(cuts)))).collect()}
    shard = F.lit(0)
    for at in cuts[:-1]:
        last = borders.get(at)
        shard = shard + (F.lit(1) if last is None else (F.col("grp") > F.lit(last)).cast("int"))
    placed = rows.withColumn("shard", F.least(shard, F.lit(shards - 1))).withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int"))
    placed = stage(placed.drop("grp"), "placed")
    counts = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))  # at most shards * SLOT_BUCKETS rows
    base = counts.select("shard", "slice", (F.sum("n").over(W.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("base"))
    number = F.row_number().over(W.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size"))
    return (placed.withColumn("number", number).join(F.broadcast(base), ["shard", "slice"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    (F.col("base") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
