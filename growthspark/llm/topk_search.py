"""Exact top-k search by inner product over vector-approximation files (operator 11).

Vectors become integers; equal ones are searched once.  A block of vectors is
approximated by one byte a component, the cell of a grid of its own (where a
component's range is below 256, a cell holds one integer and leaves nothing open).  Query
blocks meet the approximations of every block: the product with the cell
centres, give or take what the cells leave open, bounds the score.  A query's
candidates are those whose upper bound reaches its k-th best lower bound.  Exact
vectors are read in waves, best bound first, until no unread candidate's bound
reaches the k-th exact score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from growthspark.llm.common import stage

SCALE = 256
CELLS = 256               # cells of a component: one byte
BLOCK_BYTES = 2 << 20     # of a block's approximations, or of a block of query vectors, at most (one vector at least)
SLAB = 1 << 22            # bounds computed at a time
FIRST_WAVE = 2            # times k: candidates read exactly in the first wave


def usable(vector: F.Column) -> F.Column:
    """True where a vector has components and all are finite."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0)


def _integers(scale: float):
    """floor(scale * x), little-endian: 16 bits a component where all fit, else 64 (saturating)."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            flat = np.floor(np.asarray(batch.column("vector").flatten(), np.float64) * scale)
            ends = np.cumsum(dims)
            out = []
            for end, dim in zip(ends, dims):
                v = flat[end - dim:end]
                if np.abs(v).max() <= 32767:
                    out.append(v.astype("<i2").tobytes())
                else:
                    top = 2.0 ** 63 - 1024  # the largest double below 2^63
                    out.append(np.clip(v, -top, top).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("dim"), pa.array(out, pa.binary())], names=["vec_id", "dim", "ints"])

    return run


def integer_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, ints) of all usable rows."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(usable(F.col("vector"))).select("vec_id", F.size("vector").alias("dim"), "vector")
    return rows.mapInArrow(_integers(scale), "vec_id long, dim int, ints binary")


def unpack(blobs: list[bytes], dim: int) -> np.ndarray:
    """Rows of integer vectors as doubles (exact below 2^53)."""
    out = np.empty((len(blobs), dim))
    for i, b in enumerate(blobs):
        out[i] = np.frombuffer(b, "<i2" if len(b) == 2 * dim else "<i8")
    return out


def _runs(batches, rows_of):
    """(dim, ids, vectors) runs of at most ``rows_of(dim)`` rows of one dimension, across batches of (id, dim, ints)."""
    held: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for i, dim, b in zip(*(batch.column(c).to_pylist() for c in ("id", "dim", "ints"))):
            ids, blobs = held.setdefault(dim, ([], []))
            ids.append(i)
            blobs.append(b)
            if len(ids) >= rows_of(dim):
                yield dim, ids, blobs
                del held[dim]
    for dim, (ids, blobs) in held.items():
        yield dim, ids, blobs


def decode(codes: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Integers nearest to the cells' centres: the component itself where a cell is no wider than one."""
    return np.rint((codes + 0.5) * width + low)


def approximate(x: np.ndarray):
    """(codes, low, width, off, wide): cells, their grid, each vector's distance from its centre, each component's largest."""
    low = x.min(axis=0)
    width = np.maximum((x.max(axis=0) - low) / CELLS, 1e-9)
    codes = np.clip(np.floor((x - low) / width), 0, CELLS - 1).astype(np.uint8)
    left = np.abs(x - decode(codes, low, width))
    return codes, low, width, np.sqrt((left * left).sum(axis=1)) * (1 + 1e-9), left.max(axis=0)


def _file(block_bytes: int):
    """Vector-approximation blocks of a partition."""
    names = ["block", "dim", "ids", "codes", "grid", "off"]

    def run(batches):
        for dim, ids, blobs in _runs(batches, lambda d: max(1, block_bytes // d)):
            codes, low, width, off, wide = approximate(unpack(blobs, dim))
            row = [ids[0], dim, np.array(ids, np.int64).tobytes(), codes.tobytes(), np.concatenate((low, width, wide)).tobytes(), off.tobytes()]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return run


def _query_blocks(block_bytes: int):
    def run(batches):
        for dim, ids, blobs in _runs(batches, lambda d: max(1, block_bytes // (8 * d))):
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[0]]), pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                 pa.array([unpack(blobs, dim).tobytes()], pa.binary())], names=["query_block", "dim", "queries", "vectors"])

    return run


def bounds(q: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray, off: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of queries with approximated vectors."""
    centre = decode(codes, low, width)
    dim = q.shape[1]
    length = np.sqrt((q * q).sum(axis=1))
    size = length[:, None] * np.sqrt((centre * centre).sum(axis=1))
    about = (q.astype(np.float32) @ centre.astype(np.float32).T).astype(np.float64)
    cell = np.minimum(length[:, None] * off, (np.abs(q) @ wide)[:, None])
    # sums of integers below 2^24 are exact in single precision; others slip by its rounding of components, products and sums
    slip = np.where(size < 2.0 ** 23, 0, 2.0 ** -22 * (dim + 8) * size)
    open_ = (cell + slip) * (1 + 1e-9) + 1e-6
    return about - open_, about + open_


def _scan(k: int):
    """Candidates (query, id, low, high) of each pair of a query block and a block of approximations."""

    def run(batches):
        for batch in batches:
            for dim, ids, codes, grid, off, queries, vectors in zip(*(
                    batch.column(c).to_pylist() for c in ("dim", "ids", "codes", "grid", "off", "queries", "vectors"))):
                ids, queries = np.frombuffer(ids, np.int64), np.frombuffer(queries, np.int64)
                codes = np.frombuffer(codes, np.uint8).reshape(-1, dim)
                low, width, wide = np.frombuffer(grid).reshape(3, dim)
                off, q = np.frombuffer(off), np.frombuffer(vectors).reshape(-1, dim)
                step = max(1, SLAB // len(ids))
                for at in range(0, len(q), step):
                    lo, hi = bounds(q[at:at + step], codes, low, width, off, wide)
                    bar = np.partition(lo, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(lo), -np.inf)
                    i, j = np.nonzero(hi >= bar[:, None])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(queries[at + i]), pa.array(ids[j]), pa.array(lo[i, j]), pa.array(hi[i, j])], names=["query", "id", "low", "high"])

    return run


def exact_score(a: bytes, b: bytes, dim: int) -> int:
    """Integer inner product, saturating at the ends of a long."""
    x, y = (np.frombuffer(v, "<i2" if len(v) == 2 * dim else "<i8").astype(np.int64) for v in (a, b))
    if float(np.abs(x.astype(np.float64)).max()) * float(np.abs(y.astype(np.float64)).max()) * dim < 2.0 ** 62:
        return int(x @ y)
    s = sum(int(p) * int(q) for p, q in zip(x, y))
    return min(max(s, -2 ** 63), 2 ** 63 - 1)


def _scores(batches):
    for batch in batches:
        dims, x, y = (batch.column(c).to_pylist() for c in ("dim", "query_ints", "ints"))
        score = [exact_score(a, b, d) for a, b, d in zip(x, y, dims)]
        same = [a == b for a, b in zip(x, y)]
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("ids"), pa.array(score, pa.int64()), pa.array(same)],
                                         names=["query", "ids", "score", "same"])


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = SCALE, block_bytes: int = BLOCK_BYTES, first_wave: int = FIRST_WAVE,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product for each row whose id ``every`` divides.

    Components are floor(scale * x); vectors that are null, empty or hold null or
    non-finite components take no part, and vectors meet those of their own
    dimension only.  All rows but the query's own are candidates: a repeated row
    (same id and vector) is another row, and each of them is a query.  Ties go to
    the smaller vec_id; rows without id are candidates, last among ties, and
    never queries.  Scores beyond a long saturate.  Extra columns are ignored;
    an empty table, or one without queries, gives no rows.
    """
    most = k + 1  # one of them may be the query's own row
    rows = integer_vectors(vectors, scale, id_col, vector_col)
    name = F.struct(F.col("vec_id").isNull().alias("unnamed"), "vec_id")
    # of equal vectors no more than the first k + 1 rows can be among the best: cut before the shuffle, too
    firsts = rows.withColumn("nth", F.row_number().over(W.partitionBy("dim", "ints").orderBy(F.asc_nulls_last("vec_id")))).where(F.col("nth") <= most)
    unique = stage(firsts.groupBy("dim", "ints").agg(F.array_sort(F.collect_list(name)).alias("ids"))
                   .withColumn("id", F.monotonically_increasing_id()), "unique_vectors")
    asked = stage(rows.where(F.col("vec_id") % every == 0), "asked")
    wanted = stage(asked.groupBy("dim", "ints").agg(F.count(F.lit(1)).alias("rows")).withColumn("id", F.monotonically_increasing_id()), "wanted")
    file = stage(unique.select("id", "dim", "ints").mapInArrow(
        _file(block_bytes), "block long, dim int, ids binary, codes binary, grid binary, off binary"), "approximations")
    queries = stage(wanted.select("id", "dim", "ints").mapInArrow(
        _query_blocks(block_bytes), "query_block long, dim int, queries binary, vectors binary"), "query_blocks")
    # lists of block numbers, one long for each BLOCK_BYTES of vectors
    query_list = F.broadcast(queries.groupBy("dim").agg(F.collect_list("query_block").alias("others")))
    block_list = F.broadcast(file.groupBy("dim").agg(F.collect_list("block").alias("others")))
    pairs = max(1, file.count() * queries.count())
    tasks = min(pairs, 16 * vectors.sparkSession.sparkContext.defaultParallelism)
    left = file.join(query_list, "dim").withColumn("query_block", F.explode("others")).drop("others").repartition(tasks, "dim", "query_block", "block")
    right = queries.join(block_list, "dim").withColumn("block", F.explode("others")).drop("others").repartition(tasks, "dim", "query_block", "block")
    found = stage(left.join(right.hint("shuffle_hash"), ["dim", "query_block", "block"])
                  .mapInArrow(_scan(most), "query long, id long, low double, high double"), "bounds")
    by_low = W.partitionBy("query").orderBy(F.desc("low"))
    bars = found.withColumn("nth", F.row_number().over(by_low)).where(F.col("nth") == most).select("query", F.col("low").alias("bar"))
    open_ = found.join(bars, "query", "left").where("bar is null or high >= bar")
    ranked = stage(open_.select("query", "id", "high", F.row_number().over(W.partitionBy("query").orderBy(F.desc("high"), "id")).alias("nth")), "candidates")
    asks = wanted.select(F.col("id").alias("query"), F.col("ints").alias("query_ints"))
    done = None
    at, size, left_over = 0, first_wave * most, ranked
    while True:
        wave = left_over.where((F.col("nth") > at) & (F.col("nth") <= at + size))
        read = (wave.select("query", "id").join(unique, "id").join(asks, "query").select("query", "dim", "ids", "ints", "query_ints")
                .mapInArrow(_scores, "query long, ids array<struct<unnamed: boolean, vec_id: long>>, score long, same boolean"))
        best = read.select("query", "score", "same", F.inline("ids"))
        best = best if done is None else best.unionByName(done)
        order = W.partitionBy("query").orderBy(F.desc("score"), "unnamed", "vec_id")
        done = stage(best.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth"), "best")
        at, size = at + size, 2 * size
        sure = done.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
        left_over = stage(ranked.where(F.col("nth") > at).join(sure, "query", "left")
                          .where((F.col("n") < most) | F.col("n").isNull() | (F.col("high") >= F.col("worst"))).select("query", "id", "high", "nth"), "left_over")
        if left_over.isEmpty():
            break
    lists = done.groupBy("query").agg(F.collect_list(F.struct(F.bitwise_not("score").alias("falling"), "unnamed", "vec_id", "score", "same")).alias("best"))
    lists = stage(lists.join(wanted.select(F.col("id").alias("query"), "dim", "ints"), "query").select("dim", "ints", F.array_sort("best").alias("best")), "results")
    own = F.expr("array_position(transform(best, b -> b.same AND b.vec_id <=> query_id), true)")
    others = F.expr(f"slice(filter(best, (b, i) -> i + 1 <> own), 1, {k})")
    return (asked.join(lists, ["dim", "ints"]).select(F.col("vec_id").alias("query_id"), "best").withColumn("own", own)
            .select("query_id", F.posexplode(others).alias("at", "b"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")))
