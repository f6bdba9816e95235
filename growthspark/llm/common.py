"""Helpers shared by the operators: staged tables, Arrow text buffers, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from growthspark.session import ensure_checkpoint_dir

ARROW_ROWS = 512  # rows per Arrow batch sent to Python: bounds a task's memory


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor loses no staged work.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    n = len(col)
    _, off, data = col.buffers()
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, kind)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of ``n`` nodes through the links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    return root


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), one per node named.

    Random-priority contraction: in each round every node moves to its
    neighbour of lowest hash (itself included), edges are renamed to the
    survivors and deduplicated.  The expected number of survivors falls by a
    constant factor a round whatever the shape (chains and stars included).
    Each round's tables are staged; nothing is gathered on the driver.  The
    root is an arbitrary node of the component, never null; null ends and
    loops are ignored.
    """
    live = stage(edges.select("a", "b").where("a <> b"), "edges0")
    moves: list[DataFrame] = []
    while not live.isEmpty():
        k = len(moves)
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))
        move = stage(
            both.groupBy("a").agg(F.min(rank("b")).alias("m"))
            .select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("up")), f"move{k}")
        moves.append(move)
        left = live.join(move.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
        right = left.join(move.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        live = stage(
            right.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .distinct(), f"edges{k + 1}")
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("a").alias("root"))
    out = moves[-1].select("node", F.col("up").alias("root"))
    for move in reversed(moves[:-1]):
        later = out.select(F.col("node").alias("up"), "root")
        out = stage(move.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root")), "roots")
    return out


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column is called so."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_mark(text_col: str) -> F.Column:
    """64-bit hash of a text; with the id it tells the rows of a table apart (equal rows share it)."""
    return F.xxhash64(F.col(text_col).cast("string"))


def keep_marked(docs: DataFrame, keep: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, one for each row (doc_id, mark) of ``keep``, with all their columns."""
    mark = free_name(docs.columns, "mark")
    number = free_name([*docs.columns, mark], "number")
    marked = docs.withColumn(mark, text_mark(text_col))
    wanted = keep.select(F.col("doc_id").alias("_keep_id"), F.col("mark").alias("_keep_mark"))
    found = marked.join(wanted, marked[id_col].cast("long").eqNullSafe(wanted["_keep_id"]) & (marked[mark] == wanted["_keep_mark"]), "left_semi")
    one = W.partitionBy(F.col(id_col).cast("long"), mark).orderBy(mark)
    return found.withColumn(number, F.row_number().over(one)).where(F.col(number) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
