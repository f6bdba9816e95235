"""Embedding near-dedup: spherical k-means cells, blocked cosine products (operator 10).

Equal vectors are compared once, with their count.  Centroids are fitted on a
bounded sample; every vector is then put into the cell of its nearest centroid
and, as a guest, into each cell whose border is nearer than a margin that no link
can span.  Inside a cell, residents are compared with residents and guests,
block by block, so the links of a vector are all counted in its own cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthspark.llm.common import components, local_roots, stage

SAMPLE = 32768      # vectors the centroids are fitted on, at most
SAMPLE_PER_CELL = 32  # and for each centroid
CELL_ROWS = 4096    # vectors per cell aimed at: few cells, as every one near enough gets a copy of a vector
MAX_CELLS = 2048    # centroids of one dimension, at most; they travel with the task code
DIMENSIONS = 8      # dimensions that get centroids of their own (the commonest)
BLOCK = 4096        # vectors of one side of a block product
ODD = 1024          # cells that vectors of all other dimensions are dealt into


def unit(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    x = np.asarray(col.flatten(), np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids; an emptied cell is reseeded with the vector that fits worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        sims = x @ c.T
        own = sims.argmax(axis=1)
        order = np.argsort(own, kind="stable")
        filled, first = np.unique(own[order], return_index=True)
        sums = np.zeros_like(c)
        sums[filled] = np.add.reduceat(x[order], first, axis=0)
        norm = np.sqrt((sums * sums).sum(axis=1))
        worst = np.argsort(sims.max(axis=1))
        for i, j in enumerate(np.flatnonzero(norm < 1e-12)):
            sums[j], norm[j] = x[worst[i]], 1.0
        c = sums / norm[:, None]
    return c


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(id, least_id, weight, dim, embedding) per distinct usable vector, ids unique."""
    groups = rows.where("usable").groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("weight"))
    return groups.select(F.monotonically_increasing_id().alias("id"), "least_id", "weight", F.size("embedding").alias("dim"), "embedding")


def exact_margin(least: float) -> float:
    """Sine of the largest angle of a link: no link at ``least`` spans more across a border.

    For x and y at angle t, and centroids c and e with y nearest to e:
    x.(c - e) <= cos(t) y.(c - e) + sin(t) |c - e|, whose first term is not
    positive while cos(t) >= 0; a negative ``least`` lets every vector visit.
    """
    return 1.0 if least <= 0 else float(np.sqrt(max(0.0, 1 - least * least))) + 1e-9


def _assign(centroids: dict[int, np.ndarray], base: dict[int, int], margins: dict[int, float]):
    """Rows of each cell a vector lives in or visits; cells of the dimensions without centroids are below zero."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                n = part.num_rows
                if dim not in centroids:
                    at, cell, home = np.arange(n), np.full(n, -1 - dim % ODD), np.ones(n, bool)
                else:
                    c = centroids[dim]
                    sims = unit(part.column("embedding"), dim) @ c.T
                    own = sims.argmax(axis=1)
                    gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 1e-300))
                    near = sims[np.arange(n), own][:, None] - sims <= margins[dim] * gap[own]
                    near[np.arange(n), own] = True
                    at, cell = np.nonzero(near)
                    home = cell == own[at]
                    cell = cell + base[dim]
                got = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [got.column("id"), got.column("weight"), got.column("dim"), got.column("embedding"), pa.array(cell, pa.int32()), pa.array(home)],
                    names=["id", "weight", "dim", "embedding", "cell", "home"])

    return run


def _compare(least: float):
    """Residents (left) of block bi against members of block bj of one cell: link counts, and spanning links."""

    def run(table: pa.Table) -> pa.Table:
        is_left = table.column("left").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        dim = len(table.column("embedding")[0])
        x = unit(table.column("embedding"), dim)
        short = x.astype(np.float32)
        other = short[right].T
        bar = least - 2.0 ** -22 * (dim + 8)  # single precision errs by less
        a, b = [], []
        for k in range(0, len(left), 512):
            i, j = np.nonzero(short[left[k:k + 512]] @ other >= bar)
            i, j = left[k + i], right[j]
            other_id = ids[i] != ids[j]
            i, j = i[other_id], j[other_id]
            for m in range(0, len(i), 65536):  # what may link is told in double precision
                p, q = i[m:m + 65536], j[m:m + 65536]
                near = np.einsum("nd,nd->n", x[p], x[q]) >= least
                a.append(p[near])
                b.append(q[near])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, a, weight[b])
        _, one = np.unique(ids, return_inverse=True)  # a resident may stand on both sides
        first = np.zeros(one.max() + 1, np.int64)
        first[one] = ids
        root = local_roots(len(first), one[a], one[b])
        own = np.flatnonzero(root != np.arange(len(first)))
        hit = np.flatnonzero(count)
        return pa.table({
            "a": np.concatenate((ids[hit], first[own])), "b": np.concatenate((ids[hit], first[root[own]])),
            "links": np.concatenate((count[hit], np.zeros(len(own), np.int64)))})

    return run


def embedding_groups(vectors: DataFrame, least: float = 0.95, margin: float | None = None, cell_rows: int = CELL_ROWS,
                     block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Groups of vectors linked by cosine >= ``least``: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or that hold null or non-finite
    components, link with nothing (n_links 0, their own component, kept), and
    vectors of different dimension never link.  Equal vectors link with each
    other.  Repeated rows (same id and vector) are separate rows that link.
    Pairs below ``least`` never link; all others do and count at both ends.
    ``margin`` is the sine of the angle up to which a vector visits cells
    across their borders (None: :func:`exact_margin`, with which no link is
    missed; with a smaller one links across borders may be).
    Extra columns are ignored; empty input gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda e: e != 0), F.lit(False))
    plus_zero = F.transform(v, lambda e: e + F.lit(0.0))  # -0.0 and 0.0 are one value
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), plus_zero.alias("embedding"), usable.alias("usable"))
    unique = stage(distinct_vectors(rows), "vectors")
    common = unique.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(DIMENSIONS).collect()
    centroids, base, margins, next_cell = {}, {}, {}, 0
    for r in common:  # a dimension of few vectors needs no cells
        dim, k = r["dim"], min(-(-r["n"] // cell_rows), MAX_CELLS)
        if k < 2:
            continue
        sample = unique.where(F.col("dim") == dim).orderBy(F.xxhash64("embedding")).limit(min(SAMPLE, SAMPLE_PER_CELL * k)).select("embedding").toArrow()
        centroids[dim], base[dim] = spherical_kmeans(unit(sample.column("embedding"), dim), k), next_cell
        margins[dim] = exact_margin(least) if margin is None else margin
        next_cell += k
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    dealt = stage(unique.select("id", "weight", "dim", "embedding").mapInArrow(
        _assign(centroids, base, margins), "id long, weight long, dim int, embedding array<double>, cell int, home boolean"), "cells")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.sum(F.col("home").cast("long")) / block).cast("int").alias("lefts"),
                                      F.ceil(F.count(F.lit(1)) / block).cast("int").alias("rights"))
    # at most DIMENSIONS * MAX_CELLS + ODD rows
    members = dealt.join(F.broadcast(sizes.where("lefts > 0")), "cell")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    pair = lambda i, j, left: F.struct(i.alias("bi"), j.alias("bj"), F.lit(left).alias("left"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: pair(i, at("rights"), False))
    as_resident = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: pair(at("lefts"), j, True))
    placed = members.select("id", "weight", "dim", "embedding", "cell", F.explode(
        F.when(F.col("home"), F.concat(as_member, as_resident)).otherwise(as_member)).alias("p")).select("*", "p.bi", "p.bj", "p.left").drop("p")
    found = stage(placed.groupBy("cell", "dim", "bi", "bj").applyInArrow(_compare(least), "a long, b long, links long"), "found")
    links = found.where("links > 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    comps = stage(components(found.where("links = 0").select("a", "b").distinct()), "vector_components")
    members = comps.join(unique.select(F.col("id").alias("node"), "least_id"), "node")
    lowest = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = members.join(lowest, "root").select(F.col("node").alias("id"), "component_id")
    named = (unique.select("id", "embedding", "least_id", "weight").join(links, "id", "left").join(linked, "id", "left")
             .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                     F.coalesce("component_id", "least_id").alias("component_id")))
    # written, so that the join's two sides are plain shuffles, which Spark splits where a vector is common
    good = rows.where("usable").join(stage(named, "named_vectors"), "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
