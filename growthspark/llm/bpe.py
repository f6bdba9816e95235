"""BPE encoding by backtracking over longest matches, and decoding by an offset table (operator 3).

A word's encoding is the one split into tokens in which every neighbouring
pair is compatible: merging, in rank order, the symbols of the two tokens never
joins anything across their border.  An Aho-Corasick automaton finds the
longest token at each place of a word; where the pair table forbids it, the
next shorter prefix token is tried, and places that lead nowhere are marked, so
each place and token is tried once.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthspark.llm.common import small_batches
from growthspark.llm.pieces import PieceEncoder, to_letters

_MARK = "\n"   # stands for the end-of-word suffix; no byte-level letter
_NEVER = 1 << 60


class MergeTable:
    """Which tokens may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, (x, y) in enumerate(merges):
            pair, whole = (vocab[x], vocab[y]), vocab[x + y]
            self.rank.setdefault(pair, r)
            if whole not in self.born:
                self.born[whole], self.halves[whole] = r, pair
        self.known: dict[tuple[int, int], bool] = {}

    def apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """No merge of a rank below ``until`` crosses the border between tokens a and b.

        Runs time backwards: the younger of the two symbols at the border is
        undone first (of two equals the right one, as merging goes from left
        to right).  A merge across wins if it ranks before the merge that ends
        its left symbol, and not after the one that ends its right symbol.
        """
        end_a = end_b = until
        born, rank = self.born, self.rank
        while True:
            r = rank.get((a, b), _NEVER)
            if r < end_a and r <= end_b and r < until:
                return False
            age_a, age_b = born.get(a, -1), born.get(b, -1)
            if age_a < 0 and age_b < 0:
                return True
            if age_a > age_b:
                end_a, a = age_a, self.halves[a][1]
            else:
                end_b, b = age_b, self.halves[b][0]

    def compatible(self, a: int, b: int) -> bool:
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > 1 << 20:
                self.known.clear()
            got = self.known[a, b] = self.apart(a, b)
        return got

    def reachable(self, tokens: list[int]) -> set[int]:
        """Tokens that their own symbols merge into."""
        good = {t for t in tokens if t not in self.born}
        for t in sorted(self.born, key=self.born.get):
            x, y = self.halves[t]
            if x in good and y in good and self.rank[x, y] == self.born[t] and self.apart(x, y, self.born[t]):
                good.add(t)
        return good


class WordEncoder:
    """Exact BPE of one word (byte-level letters, last one marked)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.table = MergeTable(vocab, merges)
        good = self.table.reachable(list(vocab.values()))
        self.spelled = {i: (t[:-len(suffix)] + _MARK if suffix and t.endswith(suffix) and t != suffix else t) for t, i in vocab.items() if i in good}
        self.size = {i: len(t) for i, t in self.spelled.items()}
        self.suffix = suffix
        self.automaton = ahocorasick.Automaton()
        for i, t in self.spelled.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        by_text = {t: i for i, t in self.spelled.items()}
        self.shorter = {i: next((by_text[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in by_text), -1) for i, t in self.spelled.items()}

    def encode(self, word: str) -> list[int]:
        text = word + _MARK if self.suffix else word
        n = len(text)
        longest = [-1] * (n + 1)
        for end, (token, size) in self.automaton.iter(text):
            longest[end - size + 1] = token  # ends ascend: the last is the longest
        out: list[int] = []
        dead = bytearray(n + 1)  # places from which no compatible split reaches the end
        at, token = 0, longest[0]
        size, shorter, compatible = self.size, self.shorter, self.table.compatible
        while at < n:
            while token >= 0:
                end = at + size[token]
                if not dead[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, token = end, longest[end]
            else:
                if not out:
                    raise ValueError(f"no tokens spell {word!r}")
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                token = shorter[token]
        return out


def _normalise(text: str) -> str:
    """NFC, then lower case letter by letter (no rule for a final sigma)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Decoder:
    """Token strings end to end with their offsets; tokens are joined by blanks, as no decoder is set."""

    def __init__(self, vocab: dict[str, int]):
        spelled = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            spelled[i] = t.encode() + b" "
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in spelled])))

    def decode(self, ids: np.ndarray) -> bytes:
        parts = []
        for k in range(0, len(ids), 1 << 18):
            first = self.offsets[ids[k:k + (1 << 18)]]
            size = self.offsets[ids[k:k + (1 << 18)].astype(np.int64) + 1] - first
            upto = np.cumsum(size)
            parts.append(self.blob[np.repeat(first - (upto - size), size) + np.arange(upto[-1])].tobytes())
        return b"".join(parts)[:-1]


@cache
def load(path: str) -> tuple[PieceEncoder, Decoder]:
    """Encoder and decoder of a tokenizer file (lower-cased words with an end-of-word suffix); once per worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    words = WordEncoder(model["vocab"], merges, model["end_of_word_suffix"] or "")
    encoder = PieceEncoder(lambda p: words.encode(to_letters(p)), special, keep_space=False, normalise=_normalise)
    return encoder, Decoder(model["vocab"] | special)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode it again: doc_id, ids (little-endian unsigned 32-bit), decoded.

    Null and empty texts have no ids and decode to the empty string.  Special
    strings of the tokenizer in a text become their own id.  Repeated rows are
    encoded each; extra columns are ignored; empty input gives no rows.
    ``path`` must be readable where the tasks run.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        encoder, decoder = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, off = encoder.encode(texts)
            flat = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([flat[s:e].tobytes() for s, e in zip(off[:-1], off[1:])], pa.binary()),
                 pa.array([decoder.decode(ids[s:e]).decode() for s, e in zip(off[:-1], off[1:])], pa.string())],
                names=["doc_id", "ids", "decoded"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, ids binary, decoded string")
