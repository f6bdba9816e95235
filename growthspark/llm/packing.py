"""Lexical retrieval packing (operator 8).

Documents are dealt into shards of about ``SHARD_TOKENS`` tokens.  A shard
keeps a BM25 inverted index of its documents over token ids; document
frequencies, document count and mean length are those of the whole corpus.  A
seed document opens a window of 2048 tokens, its unused neighbours follow by
falling BM25 score until the window is full, and the one that is cut there goes
on in the next window as its seed.  The last window of a shard is split into
sequences whose lengths are powers of two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from growthspark.llm.common import small_batches, stage
from growthspark.llm.pieces import PieceEncoder, to_letters

WINDOW = 2048
SHARD_TOKENS = 1_000_000
QUERY_TERMS = None    # a seed's query is not cut: all its terms count
DENSE = 16            # a term that more than one in so many documents of a shard hold has a row of all their weights
K1, B = 1.2, 0.75     # the usual BM25 parameters
SEPARATOR = 1         # closes every document


@cache
def load(path: str) -> PieceEncoder:
    """Encoder of a byte-level BPE file: pieces by array operations, each distinct piece by the library's model."""
    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    encoder = PieceEncoder(lambda p: [t.id for t in model.tokenize(to_letters(p))], special, keep_space=True)
    encoder.vocabulary = 1 + max(*tokenizer.get_vocab(with_added_tokens=True).values(), SEPARATOR)
    return encoder


def width(encoder: PieceEncoder) -> str:
    """Type the ids travel in: two bytes where the vocabulary allows."""
    return "<u2" if encoder.vocabulary <= 1 << 16 else "<u4"


def tokenise(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n, crc, ids): token ids (little-endian, see :func:`width`) with the separator at the end.

    Besides them, each partition yields rows with ``df`` set: the number of
    its documents that hold each token id.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        encoder = load(path)
        df = np.zeros(0, np.int64)
        for batch in batches:
            ids, off = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            n = np.diff(off) + 1
            flat = np.insert(ids, off[1:], SEPARATOR).astype(width(encoder))
            ends = np.cumsum(n)
            parts = [flat[e - k:e] for e, k in zip(ends, n)]
            seen = np.concatenate([np.unique(p) for p in parts]) if parts else np.zeros(0, np.int64)
            if len(seen):
                count = np.bincount(seen, minlength=len(df))
                count[:len(df)] += df
                df = count
            blobs = [p.tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(blobs, pa.binary()),
                 pa.nulls(len(blobs), pa.list_(pa.int64()))], names=["doc_id", "n", "crc", "ids", "df"])
        if len(df):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                 pa.array([df.tolist()], pa.list_(pa.int64()))], names=["doc_id", "n", "crc", "ids", "df"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n long, crc long, ids binary, df array<long>")


class Index:
    """BM25 inverted index of a shard: postings by term (rows of weights for common terms), and each document's terms."""

    def __init__(self, ids: np.ndarray, off: np.ndarray, idf: np.ndarray, mean: float):
        n = len(off) - 1
        size = np.diff(off).astype(np.int32)
        narrow = ids.astype(np.uint16, copy=False) if len(idf) <= 1 << 16 else ids
        order = np.argsort(narrow, kind="stable")  # by term, documents ascending within; 16 bits sort in linear time
        term, doc = narrow[order], np.repeat(np.arange(n, dtype=np.int32), size)[order]
        del order
        new = np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))
        first = np.flatnonzero(new).astype(np.int32)
        tf = np.diff(np.append(first, len(term))).astype(np.float32)
        self.doc, term = doc[first], term[first]
        del doc, new, first
        long = (K1 * (1 - B + B * size / mean)).astype(np.float32)
        self.weight = idf.astype(np.float32)[term] * (tf * np.float32(K1 + 1) / (tf + long[self.doc]))
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        stops = np.append(starts[1:], len(term))
        of = np.repeat(np.arange(len(starts), dtype=np.int32), stops - starts)
        self.starts, self.stops, self.n = starts, stops, n
        df = stops - starts
        common = np.flatnonzero(df > max(1, n // DENSE))  # at most DENSE weights for each posting
        self.row = np.full(len(df), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        held = np.flatnonzero(self.row[of] >= 0)
        self.rows[self.row[of[held]], self.doc[held]] = self.weight[held]
        # the terms of a document that others have too: its query
        shared = np.flatnonzero(df[of] > 1).astype(np.int32)
        by = shared[np.argsort(self.doc[shared], kind="stable")]
        self.query_term = of[by]
        self.query_at = np.concatenate(([0], np.cumsum(np.bincount(self.doc[by], minlength=n))))

    def neighbours(self, seed: int, free: np.ndarray):
        """Unused documents with a positive score, best first (ties: first in order)."""
        terms = self.query_term[self.query_at[seed]:self.query_at[seed + 1]]
        row = self.row[terms]
        score = self.rows[row[row >= 0]].sum(axis=0)
        rare = terms[row < 0]
        if len(rare):
            s, k = self.starts[rare], self.stops[rare] - self.starts[rare]
            at = np.arange(k.sum()) + np.repeat(s - np.cumsum(k) + k, k)
            score += np.bincount(self.doc[at], self.weight[at], self.n).astype(np.float32)
        score *= free
        want = 16
        if self.n > want:  # the few best will do nearly always
            some = np.argpartition(-score, want)[:want]
            bar = score[some].min()
            some = some[score[some] > bar]
            yield from some[np.lexsort((some, -score[some]))].tolist()
            score[some] = 0
        rest = np.flatnonzero(score)
        yield from rest[np.lexsort((rest, -score[rest]))].tolist()


def pack_shard(ids: np.ndarray, off: np.ndarray, idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    n = len(off) - 1
    size = np.diff(off).tolist()
    index = Index(ids, off, idf, mean)
    free = np.ones(n, np.float32)
    pieces: list[tuple[int, int, int, int, int]] = []
    seq = filled = 0

    def place(d: int) -> bool:
        """Put document d; true if a window was closed on the way and a new one holds its rest."""
        nonlocal seq, filled
        free[d] = 0
        at, closed = 0, False
        while at < size[d]:
            take = min(window - filled, size[d] - at)
            pieces.append((d, at, take, seq, filled))
            at, filled = at + take, filled + take
            if filled == window:
                seq, filled, closed = seq + 1, 0, True
        return closed

    for d in range(n):
        if not free[d]:
            continue
        seed: int | None = d
        place(d)
        while seed is not None and filled:
            now, seed = seed, None
            for other in index.neighbours(now, free):
                if place(other):
                    seed = other  # its rest, if any, opens the next window
                    break
    if filled:  # the open window becomes sequences of falling powers of two
        tail = [p for p in pieces if p[3] == seq]
        del pieces[len(pieces) - len(tail):]
        room = 1 << (filled.bit_length() - 1)
        left, at = filled - room, 0
        for d, start, length, _, _ in tail:
            while length:
                take = min(room - at, length)
                pieces.append((d, start, take, seq, at))
                start, length, at = start + take, length - take, at + take
                if at == room:
                    seq, at = seq + 1, 0
                    if left:
                        room = 1 << (left.bit_length() - 1)
                        left -= room
    return pieces


def pack(docs: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS, window: int = WINDOW,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids (the piece's tokens, little-endian unsigned 32-bit).  A null or empty text is the
    separator alone.  Documents of any length are cut at window ends only, and
    in the last window of a shard at powers of two.  Documents of a shard stand
    by doc_id, then length and checksum of their tokens, so the result does not
    depend on the order of arrival; repeated rows are packed each.  Extra
    columns are ignored; empty input gives no rows.
    """
    tokens = stage(tokenise(docs, path, id_col, text_col), "tokens")
    rows = tokens.where("df is null").select("doc_id", "n", "crc", "ids")
    total = rows.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    encoder = load(path)  # on the driver only for the size of the vocabulary
    kind = width(encoder)
    counts = (tokens.where("df is not null").select(F.posexplode("df").alias("term", "k")).where("k > 0")
              .groupBy("term").agg(F.sum("k").alias("df")).collect())  # one row per vocabulary entry at most
    idf = np.zeros(encoder.vocabulary)
    for r in counts:
        idf[r["term"]] = np.log1p((total["docs"] - r["df"] + 0.5) / (r["df"] + 0.5))
    mean = total["tokens"] / max(1, total["docs"])
    shards = max(1, round(total["tokens"] / shard_tokens))

    def run(key, table):
        load.cache_clear()  # the worker's encoder is not needed any more
        shard = key[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("n", "ascending"), ("crc", "ascending")])
        blobs = table.column("ids").to_pylist()
        off = np.concatenate(([0], np.cumsum(table.column("n").to_numpy())))
        ids = np.frombuffer(b"".join(blobs), kind)
        cut = pack_shard(ids, off, idf, mean, window)
        own = np.array([p[0] for p in cut], np.int64)
        start, length, seq, at = (np.array([p[k] for p in cut], np.int64) for k in (1, 2, 3, 4))
        shown = [ids[off[d] + s:off[d] + s + k].astype("<u4").tobytes() for d, s, k, _, _ in cut]
        return pa.table({
            "doc_id": table.column("doc_id").combine_chunks().take(pa.array(own)), "start": start, "length": length,
            "ids_crc32": pa.array([zlib.crc32(b) for b in shown], pa.int64()), "doc_tokens": table.column("n").to_numpy()[own],
            "sequence_id": (np.int64(shard) << 32) + seq, "offset": at, "ids": pa.array(shown, pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "n", "crc"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
