"""Splitting texts into BPE pieces with array operations, and encoding each distinct piece once.

A batch of texts becomes one array of code points; piece borders follow from
the class of each character (letter, number, white space, other) and its
neighbours.  Pieces are looked up by a 64-bit hash in a bounded cache that
lives as long as the Python worker; only pieces not met before are encoded.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import numpy as np

CHUNK = 1 << 19        # code points handled at once
CACHE_PIECES = 1 << 19  # the cache is emptied beyond this
HASHED = 64            # longer pieces are encoded without the cache

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# the characters of the Unicode property White_Space (fixed values)
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_BASE = 0x9E3779B97F4A7C15 | 1
_SAFE_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8)
    out[WHITE] = SPACE
    return out


@cache
def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def _latin_table() -> dict[int, str]:
    return {b: c for b, c in byte_letters().items()}


def to_letters(piece: str) -> str:
    """The UTF-8 bytes of a piece in the byte-level alphabet."""
    return piece.encode("utf-8", "replace").decode("latin-1").translate(_latin_table())


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _contractions(cp: np.ndarray, cls: np.ndarray, begins: np.ndarray, ends_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apostrophes (among ``begins``) that open a contraction, and the length of each."""
    n = len(cp)
    at = begins[cp[begins] == 39]
    at = at[at + 1 < ends_at[at]]
    if not len(at):
        return at, at
    first = cp[at + 1]
    second = np.where(at + 2 < ends_at[at], cp[np.minimum(at + 2, n - 1)], 0)
    one = np.isin(first, [ord(c) for c in "stmd"])
    two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    hit = one | two
    return at[hit], np.where(one, 2, 3)[hit]


def split(cp: np.ndarray, row_starts: np.ndarray, keep_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the pieces of concatenated texts (none of them empty).

    keep_space: a blank goes to the piece after it and other white space forms
    pieces; else white space is dropped and every number is a piece alone.
    """
    n = len(cp)
    cls = classes()[cp]
    new_row = np.zeros(n + 1, bool)
    new_row[row_starts] = True
    new_row[n] = True
    begin = new_row[:-1].copy()
    begin[1:] |= cls[1:] != cls[:-1]
    row_end = np.repeat(np.append(row_starts[1:], n), np.diff(np.append(row_starts, n)))
    space = cls == SPACE
    start = begin.copy()
    if keep_space:
        blank = np.zeros(n, bool)  # the character before is a blank of the same text
        blank[1:] = (cp[:-1] == 32) & ~new_row[1:-1]
        start &= space | ~blank
        last = np.zeros(n, bool)   # white space whose next character, in the same text, is none
        last[:-1] = space[:-1] & ~space[1:] & ~new_row[1:-1]
        start |= last
        opens = np.flatnonzero(begin & ~space & ~blank)
    else:
        start |= cls == NUMBER
        opens = np.flatnonzero(begin & ~space)
    alone = opens[(cp[opens] == 39) & (opens + 1 < row_end[opens])]
    alone = alone[cls[alone + 1] == LETTER]
    at, size = _contractions(cp, cls, alone, row_end)
    start[at + 1] = False
    rest = at + size
    rest = rest[rest < row_end[at]]
    start[rest] = True
    starts = np.flatnonzero(start)
    stops = np.append(starts[1:], n)
    if not keep_space:
        word = cls[starts] != SPACE
        starts, stops = starts[word], stops[word]
    return starts, stops


def hashes(cp: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each piece: a polynomial in its code points, by prefix sums."""
    n = len(cp)
    size = CHUNK * 2
    while size < n + 1:
        size *= 2
    up, down = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((cp + np.uint32(1)).astype(np.uint64) * up[:n], out=sums[1:])
    h = (sums[stops] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    h = h * np.uint64(0xD6E8FEB86659FD93) + (stops - starts).astype(np.uint64)
    return h ^ (h >> np.uint64(32))


class PieceEncoder:
    """Encodes texts piece by piece.

    encode_piece: str -> ids.  specials: strings that become their id wherever
    they stand in the raw text.  normalise: applied to the text between them.
    """

    def __init__(self, encode_piece, specials: dict[str, int], keep_space: bool, normalise=None):
        self.encode_piece, self.specials, self.keep_space, self.normalise = encode_piece, specials, keep_space, normalise
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        self._empty()

    def _empty(self):
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Add pieces (keys ascending, none known) to the cache."""
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self._empty()
        got = [self.encode_piece(p) if p else [] for p in pieces]  # "": a long piece, encoded apart
        count = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.array([i for g in got for i in g], np.uint32)
        while self.filled + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.filled:self.filled + len(flat)] = flat
        first = self.filled + np.cumsum(count) - count
        self.filled += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.count, at, count)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per text) of texts that hold no special string."""
        joined = "".join(texts)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        row_starts = (np.cumsum(lens) - lens)[lens > 0]
        starts, stops = split(cp, row_starts, self.keep_space)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        h = hashes(cp, starts, stops)
        long = np.flatnonzero(stops - starts > HASHED)
        h[long] = 0  # looked up like the others, replaced below
        keys, one, which = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            fresh = np.flatnonzero(~known)
            if len(self.keys) + len(fresh) > CACHE_PIECES:
                self._empty()
                fresh = np.arange(len(keys))
            pieces = [joined[s:e] if e - s <= HASHED else "" for s, e in zip(starts[one[fresh]].tolist(), stops[one[fresh]].tolist())]
            self._learn(keys[fresh], pieces)
            at = np.searchsorted(self.keys, keys)
        first, count = self.first[at][which], self.count[at][which]
        pool = self.ids
        if len(long):
            own = [self.encode_piece(joined[s:e]) for s, e in zip(starts[long].tolist(), stops[long].tolist())]
            count[long] = [len(o) for o in own]
            first[long] = self.filled + np.cumsum(count[long]) - count[long]
            pool = np.concatenate((pool[:self.filled], np.array([i for o in own for i in o], np.uint32)))
        upto = np.cumsum(count)
        ids = pool[np.repeat(first - (upto - count), count) + np.arange(upto[-1])]
        text_of = np.searchsorted(np.cumsum(lens), starts, "right")
        return ids, np.bincount(text_of, weights=count, minlength=len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets: text i has ids[offsets[i]:offsets[i + 1]])."""
        parts: list[str] = []
        owner: list[int] = []
        fixed: dict[int, int] = {}  # part -> id of a special string
        for i, text in enumerate(texts):
            for p in self.special.split(text) if self.special and any(s in text for s in self.specials) else (text,):
                if self.special and p in self.specials:
                    fixed[len(parts)] = self.specials[p]
                    parts.append("")
                    owner.append(i)
                    continue
                p = self.normalise(p) if self.normalise else p
                while len(p) > CHUNK and (m := _SAFE_CUT.search(p, CHUNK)):  # a blank between words is a border anyway
                    parts.append(p[:m.start()])
                    owner.append(i)
                    p = p[m.start():]
                parts.append(p)
                owner.append(i)
        found, counts, k = [], [], 0
        while k < len(parts):
            size, j = len(parts[k]), k + 1
            while j < len(parts) and size + len(parts[j]) <= CHUNK:
                size += len(parts[j])
                j += 1
            ids, count = self._chunk(parts[k:j])
            found.append(ids)
            counts.append(count)
            k = j
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if fixed:
            where = np.fromiter(fixed, np.int64, len(fixed))
            ids = np.insert(ids, (np.cumsum(count) - count)[where], np.fromiter(fixed.values(), np.uint32, len(fixed)))
            count[where] = 1
        per_text = np.bincount(np.array(owner, np.int64), weights=count, minlength=len(texts)).astype(np.int64) if owner else np.zeros(len(texts), np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_text)))
