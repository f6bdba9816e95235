"""SimHash near-dedup with pivot distance tables (operator 6).

Links are fingerprints at most ``max_bits`` apart.  Each distinct fingerprint
gets a table of Hamming distances to 33 reference fingerprints: zero, and one
with the two bits of each of 32 places set.  By the triangle inequality no
distance of a pair's tables differs by more than the pair's own distance; and
as the places are disjoint, at most ``max_bits`` places differ at all.  So the
places fall into ``max_bits + 2`` groups of which two agree entirely, and the
distances to the references of two groups are the join key: no link is lost.
Within a key, pairs whose tables differ by more than ``max_bits`` anywhere are
discarded, and the survivors are verified on the fingerprints themselves.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from growthspark.llm.common import components, keep_marked, local_roots, small_batches, stage, text_mark, utf8

PLACES = 32                                       # two bits each
REFERENCES = [0] + [3 << (2 * i) for i in range(PLACES)]
BLOCK = 2048                                      # fingerprints of one key compared with each other in one go


def fingerprint(text: bytes, words_per: int) -> int:
    """SimHash of the word shingles of a text whose letters A-Z are lower case already."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - words_per + 1)
    starts = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    stops = ends[min(words_per, len(words)) - 1:].tolist()
    h = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        hashes = np.array([h(joined[s:e], 42) for s, e in zip(starts[at:at + (1 << 15)], stops[at:at + (1 << 15)])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_per: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, fp): the fingerprint as a signed 64-bit integer; mark tells rows of one id apart."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            whole = raw.tobytes().lower()
            got = np.array([fingerprint(whole[s:e], words_per) for s, e in zip(off[:-1], off[1:])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(got.view(np.int64))], names=["doc_id", "mark", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_mark(text_col).alias("mark"))
    return source.mapInArrow(run, "doc_id long, mark long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def table_keys(fp: Column, max_bits: int) -> Column:
    """Join keys: the distances to the references of every two of ``max_bits + 2`` groups."""
    groups = max_bits + 2
    weight = F.bit_count(fp)
    # d(fp, 0) and d(fp, reference) together say how many bits are set in a place: 0, 1 or 2
    place = [((weight + 2 - F.bit_count(fp.bitwiseXOR(F.lit(_signed(r))))) / 2).cast("long") for r in REFERENCES[1:]]
    keys = []
    for k, pair in enumerate(combinations(range(groups), 2)):
        packed = F.lit(k).cast("long")
        for i in range(PLACES):
            if i % groups in pair:
                packed = packed * 3 + place[i]
        keys.append(packed)
    return F.array(*keys)


def _near(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int):
    """Of the candidate pairs, those that the tables do not exclude and the fingerprints confirm."""
    ok = np.ones(len(a), bool)
    for part in (slice(0, 1), slice(1, 9), slice(9, None)):  # most pairs fall at the first columns
        a, b = a[ok], b[ok]
        ok = (np.abs(table[a, part] - table[b, part]) <= max_bits).all(axis=1)
    a, b = a[ok], b[ok]
    ok = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
    return a[ok], b[ok]


def _links(max_bits: int):
    refs = np.array(REFERENCES, np.uint64)

    def links(run: np.ndarray, block: np.ndarray, crossed: np.ndarray, fp: np.ndarray):
        """Spanning links of sorted runs; a run of two blocks is compared across them only."""
        table = np.bitwise_count(fp[:, None] ^ refs).astype(np.int8)
        edge = np.flatnonzero(np.diff(run)) + 1
        starts, stops = np.concatenate(([0], edge)), np.concatenate((edge, [len(run)]))
        size = stops - starts
        found_a, found_b = [], []
        per_row = np.repeat(size, size)
        for step in range(1, min(int(size.max(initial=1)), 33)):  # short runs: all runs at once, by distance in the run
            i = np.flatnonzero((run[:-step] == run[step:]) & (per_row[:-step] <= 32))
            i = i[~crossed[i] | (block[i] != block[i + step])]
            if len(i):
                a, b = _near(fp, table, i, i + step, max_bits)
                found_a.append(a)
                found_b.append(b)
        for s, e in zip(starts[size > 32], stops[size > 32]):
            rows = s + np.argsort(table[s:e, 0], kind="stable")
            weight = table[rows, 0]
            far = np.searchsorted(weight, weight + max_bits, "right")  # beyond it the first coordinate excludes
            for k in range(0, len(rows), 64):
                most = int(far[k:k + 64].max())
                a = np.repeat(rows[k:k + 64], most - k)
                b = np.tile(rows[k:most], len(rows[k:k + 64]))
                keep = a != b
                if crossed[s]:
                    keep &= block[a] != block[b]
                a, b = _near(fp, table, a[keep], b[keep], max_bits)
                found_a.append(a)
                found_b.append(b)
        a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
        b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
        root = local_roots(len(fp), a, b)
        own = np.flatnonzero(root != np.arange(len(fp)))
        return fp[root[own]].view(np.int64), fp[own].view(np.int64)

    def run(batches):
        held: pa.Table | None = None

        def work(t: pa.Table):
            if not t.num_rows:
                return None
            col = lambda c: t.column(c).to_numpy()
            key, bi, bj = col("key"), col("bi"), col("bj")
            new = np.concatenate(([0], (np.diff(key) != 0) | (np.diff(bi) != 0) | (np.diff(bj) != 0)))
            a, b = links(np.cumsum(new), col("block"), bi != bj, col("fp").view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            ids = [held.column(c).to_numpy() for c in ("key", "bi", "bj")]
            same = np.logical_and.reduce([c == c[-1] for c in ids])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last run may go on
            if cut and (out := work(held.slice(0, cut))) is not None and out.num_rows:
                yield out
            held = held.slice(cut)
        if held is not None and (out := work(held)) is not None and out.num_rows:
            yield out

    return run


def fingerprint_links(distinct: DataFrame, max_bits: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints (column fp) within ``max_bits``, directly or through others.

    A key with more than ``block`` fingerprints is compared block against
    block in separate tasks; every task emits only a spanning set of links.
    """
    keyed = distinct.select(F.explode(table_keys(F.col("fp"), max_bits)).alias("key"), "fp")
    by = W.partitionBy("key")
    keyed = (keyed.withColumn("n", F.count(F.lit(1)).over(by)).where("n > 1")
             .withColumn("block", F.floor((F.row_number().over(by.orderBy("fp")) - 1) / block).cast("long")))
    blocks = F.floor((F.col("n") - 1) / block).cast("long")
    paired = keyed.select("key", "fp", "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks)).alias("other")).select(
        "key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "fp")
    dealt = paired.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return dealt.mapInArrow(_links(max_bits), "a long, b long").distinct()


def _grouped(docs: DataFrame, words_per: int, max_bits: int, block: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, mark, fp, grp, component_id): grp names the component."""
    rows = stage(fingerprints(docs, words_per, id_col, text_col), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct_fp")
    comps = stage(components(stage(fingerprint_links(distinct, max_bits, block), "links")), "fp_components")
    members = comps.join(distinct, comps["node"] == distinct["fp"]).select("node", "root", "least_id")
    least = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = members.join(least, "root").select(F.col("node").alias("fp"), "root", "component_id")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("grp"), F.coalesce("component_id", "least_id").alias("component_id"))
    # written, so that the join's two sides are plain shuffles, which Spark splits where a fingerprint is common
    return rows.join(stage(named, "named_fp"), "fp")


def simhash_groups(docs: DataFrame, words_per: int = 3, max_bits: int = 2, block: int = BLOCK,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; a text of
    fewer words than a shingle is one shingle, one without words (null, empty)
    has fingerprint zero and is linked like any other.  component_id is the
    smallest doc_id reachable (null only where a component has no id).
    Repeated rows fall into one component and all are returned.  Extra columns
    are ignored; empty input gives no rows.
    """
    rows = _grouped(docs, words_per, max_bits, block, id_col, text_col)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_per: int = 3, max_bits: int = 2, block: int = BLOCK,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that of the smallest doc_id (then mark), with all its columns."""
    rows = _grouped(docs, words_per, max_bits, block, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("mark")))
    kept = rows.groupBy("grp").agg(first.alias("f")).select("f.doc_id", "f.mark")
    return keep_marked(docs, kept, id_col, text_col)
