"""Quality classifier: Naive Bayes support vectors (operator 1).

Features are indicators of hashed n-grams of a text: of its bytes, of its
words' shapes, and of which of four consecutive words repeat an earlier one.  Each indicator is scaled by the log-count ratio of the two
classes; a linear hinge-loss model on the scaled, length-normalised vectors is
fitted by dual coordinate descent; a logistic curve fitted on rows kept out of
that fit turns margins into scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthspark.llm.common import free_name, small_batches, utf8
from growthspark.llm.pieces import hashes

BITS = 16               # n-grams are hashed into 2^16 features
TRAIN_ROWS = 8_000     # labelled rows the model is fitted on, at most (the smallest hashes of their ids)
FOLDS = 5               # every fifth of them fits the logistic curve instead of the margins
C = 1.0
EPOCHS = 8
SMOOTH = 1.0
_SIZE = 1 << BITS
_MULT = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20        # bytes of a text handled at once


def _classes() -> np.ndarray:
    """Shape class of each byte: letters by case, digits, blanks, other bytes by themselves."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("a"):ord("z") + 1] = ord("a")
    out[ord("A"):ord("Z") + 1] = ord("A")
    out[ord("0"):ord("9") + 1] = ord("0")
    out[0x80:] = ord("a")  # parts of letters beyond ASCII
    return out


_SHAPE = _classes()


def _grams(data: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hashed n-grams of ``size`` (at most 8) bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value |= data[k:k + n].astype(np.uint64) << np.uint64(8 * k)
    value = (value + np.uint64(salt)) * _MULT
    value ^= value >> np.uint64(32)
    return ((value * _MULT) >> np.uint64(64 - BITS)).astype(np.int64)


def _echoes(data: np.ndarray) -> np.ndarray:
    """4-grams of words, each word told only by whether it is one of the two before it."""
    blank = np.flatnonzero(data <= 0x20)
    starts, stops = np.append(0, blank + 1), np.append(blank, len(data))
    word = stops > starts
    h = hashes(data.astype(np.uint32), starts[word], stops[word])
    same = np.zeros(len(h), np.uint8)
    same[1:] |= h[1:] == h[:-1]
    same[2:] |= (h[2:] == h[:-2]).astype(np.uint8) << 1
    return same


def features(text: np.ndarray) -> np.ndarray:
    """Distinct features of a text (UTF-8 bytes), ascending.

    Texts beyond ``_CHUNK`` bytes are handled by chunks that overlap by the
    longest n-gram; a word that such a border cuts counts as two.
    """
    seen = np.zeros(_SIZE, bool)
    for k in range(0, max(1, len(text)), _CHUNK):
        part = text[k:k + _CHUNK + 8]
        shape = _SHAPE[part]
        kinds = ((part, 2, 1), (part, 3, 2), (part, 4, 3), (shape, 4, 4), (shape, 6, 5), (shape, 8, 6), (_echoes(part), 4, 7))
        for data, size, salt in kinds:
            seen[_grams(data, size, salt)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))); margin = weights . x / |x|, x = ratio at the features seen."""

    weights: np.ndarray   # float64[2^BITS]: hinge-loss weights times the ratios
    squares: np.ndarray   # ratios squared, for the norm
    bias: float
    slope: float
    shift: float

    def margin(self, seen: np.ndarray) -> float:
        norm = np.sqrt(self.squares[seen].sum())
        return float(self.weights[seen].sum() / norm if norm else 0.0) + self.bias

    def score(self, seen: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(seen) + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log of each feature's smoothed share in class 1 over its share in class 0."""
    counts = [np.full(_SIZE, SMOOTH), np.full(_SIZE, SMOOTH)]
    for seen, label in zip(rows, y):
        counts[label][seen] += 1
    return np.log(counts[1] / (SMOOTH * 2 + (y == 1).sum())) - np.log(counts[0] / (SMOOTH * 2 + (y == 0).sum()))


def hinge_fit(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Dual coordinate descent for min |w|^2 / 2 + sum cost_i max(0, 1 - y_i w.x_i); the last weight is the bias."""
    w = np.zeros(_SIZE + 1)
    alpha = np.zeros(len(rows))
    square = np.array([v @ v for v in values]) + 1.0
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v, s = rows[i], values[i], y[i]
            gradient = s * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * s
                w[at] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def logistic_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with smoothed targets."""
    up, down = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        v = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum() + 1e-6 * a, (p - target).sum()])
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Fit on rows of features and labels 0 or 1; with one class only, the scores are its share."""
    y = np.asarray(y, np.int64)
    if len(y) == 0 or y.min() == y.max():
        shift = 0.0 if len(y) == 0 else (5.0 if y[0] == 1 else -5.0)
        return Model(np.zeros(_SIZE), np.zeros(_SIZE), 0.0, 0.0, shift)
    kept_out = np.arange(len(y)) % FOLDS == FOLDS - 1
    if len(set(y[kept_out].tolist())) < 2 or len(set(y[~kept_out].tolist())) < 2:
        kept_out[:] = False
    train = np.flatnonzero(~kept_out)
    ratio = log_count_ratios([rows[i] for i in train], y[train])
    values = [(ratio[rows[i]] / max(np.sqrt((ratio[rows[i]] ** 2).sum()), 1e-12)).astype(np.float32) for i in train]
    sign = np.where(y[train] == 1, 1.0, -1.0)
    share = (y[train] == 1).mean()
    cost = C * np.where(sign > 0, 0.5 / share, 0.5 / (1 - share))
    w = hinge_fit([rows[i] for i in train], values, sign, cost)
    model = Model(w[:-1] * ratio, ratio ** 2, float(w[-1]), 1.0, 0.0)
    judged = np.flatnonzero(kept_out) if kept_out.any() else train
    model.slope, model.shift = logistic_fit(np.array([model.margin(rows[i]) for i in judged]), y[judged])
    return model


def held_out(doc_id) -> F.Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``max_rows`` labelled rows that are not held out.

    The rows are those of the smallest id hashes, so the choice depends on ids
    alone.  Labels other than 0 and 1 and null ids are left out; an id labelled
    twice counts once (its smallest label), and so does an id of several
    documents (the smallest features).  Texts become features where they are;
    the fit, bounded by ``max_rows``, is one task.
    """
    small_batches(docs.sparkSession)
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def extract(batches):
        for batch in batches:
            raw, off = utf8(batch.column("text"))
            got = [features(raw[s:e]).astype("<u2").tobytes() for s, e in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(got, pa.binary())],
                                             names=["doc_id", "quality", "seen"])

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("seen", "ascending")])
        rows = [np.frombuffer(b, "<u2").astype(np.int32) for b in table.column("seen").to_pylist()]
        m = fit(rows, table.column("quality").to_numpy())
        return pa.table({"weights": pa.array([m.weights.tobytes()], pa.binary()), "squares": pa.array([m.squares.tobytes()], pa.binary()),
                         "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    rows = _text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    seen = rows.mapInArrow(extract, "doc_id long, quality int, seen binary")
    once = seen.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("seen").alias("seen"))
    got = once.withColumn("model", F.lit(1)).groupBy("model").applyInArrow(solve, "weights binary, squares binary, bias double, slope double, shift double").collect()
    if not got:
        return fit([], np.zeros(0, np.int64))
    r = got[0]
    return Model(np.frombuffer(bytes(r["weights"])), np.frombuffer(bytes(r["squares"])), r["bias"], r["slope"], r["shift"])


def with_score(rows: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """All rows and columns and, as ``name``, the score (0 to 1) of the whole text.

    The model travels with the task code (1 MB whatever the corpus).
    """
    small_batches(rows.sparkSession)
    place = rows.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            raw, off = utf8(batch.column(place).cast(pa.string()))
            got = [model.score(features(raw[s:e])) for s, e in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, schema)


THRESHOLD = 0.3


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where score >= threshold) of every document.

    Null and empty texts have no features and get the score of the bias alone.
    A null doc_id is not held out.  Without usable labels every score is 0.5.
    Repeated rows are scored each; extra columns are ignored; no documents, no
    rows.
    """
    model = train(docs, labels, max_rows)
    return with_score(_text(docs, "doc_id", "text"), model, "score").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, with their columns, that :func:`classify` does not reject."""
    model = train(docs, labels, max_rows)
    name = free_name(docs.columns, "score")
    return with_score(docs, model, name).where(F.col(name) >= threshold).drop(name)
