"""BPE and packing against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from growthspark.llm import bpe, packing, pieces

from .helpers import collect, documents

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ATOMS = ["a", "b", "th", "e", "'s", "'ll", "'re ", "'t", "'", "'S", " ", "  ", "\n", "\t", "\r\n", "1", "23", "é", "ß", "Σ", "İ", "ﬁ", "中", "文", "%", "!!",
         "<|endoftext|>", "<|startoftext|>", "<|", "|>", "́", "é", " ", "　", "Ⅷ", "½", "😀", "</w>", "\x00", "\x1c", "\x85",
         "ing", "tion", "A", "Q", "-", "_", "’s", "a" * 70, "xyz" * 30]


def texts(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", "a" * 3000, " " * 300, "!" * 500, "ab" * 700, "\n" * 5 + "a"]


@pytest.mark.parametrize("path,load", [(WORD, lambda p: bpe.load(p)[0]), (BYTE, packing.load)])
def test_ids_are_the_librarys(path, load, monkeypatch):
    library, encoder = Tokenizer.from_file(path), load(path)
    monkeypatch.setattr(pieces, "CHUNK", 5000)
    given = texts(1)
    ids, off = encoder.encode(given)
    want = [e.ids for e in library.encode_batch(given, add_special_tokens=False)]
    assert [ids[s:e].tolist() for s, e in zip(off[:-1], off[1:])] == want


def test_cache_may_be_emptied_at_any_time(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_PIECES", 50)
    monkeypatch.setattr(pieces, "CHUNK", 400)
    bpe.load.cache_clear()
    given = texts(2)[:300]
    encoder = bpe.load(WORD)[0]
    for _ in range(2):
        ids, off = encoder.encode(given)
        want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(given, add_special_tokens=False)]
        assert [ids[s:e].tolist() for s, e in zip(off[:-1], off[1:])] == want
    bpe.load.cache_clear()


def test_long_text_is_cut_at_blanks_only(monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 64)
    text = " ".join(["alpha's", "beta", "  gamma", "12", "\n", "d" * 200] * 40)
    ids, _ = packing.load(BYTE).encode([text])
    assert ids.tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_every_character_class():
    """Each code point between letters and blanks, as the library splits it."""
    chars = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    given = ["".join(f"a{c}b {c}{c} " for c in chars[k:k + 256]) for k in range(0, len(chars), 256)]
    library, encoder = Tokenizer.from_file(BYTE), packing.load(BYTE)
    ids, off = encoder.encode(given)
    assert [ids[s:e].tolist() for s, e in zip(off[:-1], off[1:])] == [e.ids for e in library.encode_batch(given, add_special_tokens=False)]


def test_backtracking_on_a_tangled_vocabulary():
    """Merges whose longest match is wrong: against merging step by step."""
    merges = [("b", "c"), ("a", "b"), ("a", "bc"), ("c", "a"), ("ca", "b"), ("a", "a"), ("aa", "a"), ("b", "b"), ("bb", "c")]
    vocab = {t: i for i, t in enumerate(["a", "b", "c", *dict.fromkeys(x + y for x, y in merges)])}
    encoder = bpe.WordEncoder(vocab, merges, "")
    rank = {m: r for r, m in enumerate(merges)}

    def slow(word):
        parts = list(word)
        while True:
            found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
            if not found:
                return [vocab[p] for p in parts]
            r, i = min(found)
            parts[i:i + 2] = ["".join(parts[i:i + 2])]

    rng = random.Random(4)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        assert encoder.encode(word) == slow(word), word


def test_encode_decode(spark):
    docs = documents(spark)
    library = Tokenizer.from_file(WORD)
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append(str((r["doc_id"], np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))))
    got = collect(bpe.encode_decode(docs, WORD))
    assert sorted(str((g["doc_id"], bytes(g["ids"]), g["decoded"])) for g in got) == sorted(want)
    assert bpe.encode_decode(docs.limit(0), WORD).count() == 0


def check_pieces(got, want, window):
    """want: id -> list of token lists; every token of every document in one piece, windows without gaps."""
    by_seq, covered = defaultdict(list), defaultdict(int)
    for g in got:
        by_seq[g["sequence_id"]].append(g)
        ids = [t for t in want[g["doc_id"]] if len(t) == g["doc_tokens"]
               and zlib.crc32(np.array(t[g["start"]:g["start"] + g["length"]], "<u4").tobytes()) == g["ids_crc32"]]
        assert ids and g["length"] > 0
        covered[g["doc_id"], g["doc_tokens"]] += g["length"]
    for g in by_seq.values():
        at = 0
        for p in sorted(g, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or at < window and at & (at - 1) == 0  # no padding at all
    for i, lists in want.items():
        assert sum(n for (d, _), n in covered.items() if d == i) == sum(map(len, lists))


@pytest.mark.parametrize("shard_tokens,window", [(4_000_000, 2048), (3000, 256)])
def test_pack(spark, shard_tokens, window):
    docs = documents(spark)
    library, want = Tokenizer.from_file(BYTE), defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    got = collect(packing.pack(docs, BYTE, shard_tokens, window))
    check_pieces(got, want, window)
    assert packing.pack(docs.limit(0), BYTE).count() == 0


def test_neighbours_are_bm25():
    rng = np.random.default_rng(0)
    docs = [rng.zipf(1.5, rng.integers(5, 60)) % 50 for _ in range(60)]
    off = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    ids = np.concatenate(docs).astype(np.uint32)
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50)
    idf, mean = np.log1p((60 - df + 0.5) / (df + 0.5)), len(ids) / 60
    index = packing.Index(ids, off, idf, mean)
    free = np.ones(60, np.float32)
    free[[3, 7]] = 0
    for seed in range(60):
        def weight(d, t):
            tf = (docs[d] == t).sum()
            return idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean))

        query = sorted((t for t in set(docs[seed].tolist()) if df[t] > 1), key=lambda t: (-np.float32(weight(seed, t)), t))[:packing.QUERY_TERMS]
        score = {d: sum(weight(d, t) for t in query) for d in range(60) if free[d]}
        got = list(index.neighbours(seed, free))
        assert set(got) == {d for d, s in score.items() if s > 0}
        assert all(score[a] >= score[b] - 1e-4 for a, b in zip(got, got[1:]))


def test_every_term_of_a_seed_counts():
    """Long seeds, neighbours that share only light terms with them: against BM25 over all terms."""
    rng = np.random.default_rng(1)
    docs = [np.concatenate((np.repeat(np.arange(100), 9), np.arange(200, 500))), np.repeat(np.arange(100), 9)]  # heavy terms are theirs alone
    docs += [rng.choice(np.arange(200, 500), rng.integers(1, 40)) for _ in range(98)]
    n = len(docs)
    off = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    ids = np.concatenate(docs).astype(np.uint32)
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=500)
    idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)), len(ids) / n
    index = packing.Index(ids, off, idf, mean)
    tf = np.array([np.bincount(d, minlength=500) for d in docs])
    long = packing.K1 * (1 - packing.B + packing.B * tf.sum(axis=1, keepdims=True) / mean)
    weight = idf * tf * (packing.K1 + 1) / (tf + long)
    for seed in range(n):
        score = weight[:, tf[seed] > 0].sum(axis=1)
        score[seed] = 0
        free = np.ones(n, np.float32)
        free[seed] = 0
        got = list(index.neighbours(seed, free))
        assert set(got) == set(np.flatnonzero(score).tolist())
        assert all(score[a] >= score[b] - 1e-3 for a, b in zip(got, got[1:]))
