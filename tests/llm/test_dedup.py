"""Exact, SimHash and line dedup against brute force."""

import random
import re
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from growthspark.llm import exact_dedup, line_dedup, simhash

from .helpers import collect, components, documents, words

SPACE = re.compile("[\x20\x09-\x0d]")


def test_exact_groups(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t)].append((-len(t), i is None, i or 0))
    want = sorted(str((i, min(groups[SPACE.sub("", t)])[2] if not min(groups[SPACE.sub("", t)])[1] else None,
                       len(groups[SPACE.sub("", t)]), sha256(SPACE.sub("", t).encode()).hexdigest())) for i, t in rows)
    got = collect(exact_dedup.exact_groups(docs))
    assert sorted(str((g["doc_id"], g["keep_id"], g["group_size"], g["text_sha256"])) for g in got) == want
    kept = defaultdict(int)
    for g in got:
        kept[g["text_sha256"]] += g["kept"]
    assert set(kept.values()) == {1}


def test_exact_keeps_whole_rows(spark):
    docs = documents(spark)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == exact_dedup.exact_groups(docs).where("kept").count()
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0 == exact_dedup.exact_groups(docs.limit(0)).count()


def test_colliding_chunk_keys_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a "), (4, "c" * 5000), (5, "c" * 5000)], "doc_id long, text string")
    rows = exact_dedup.named_recipes(docs).select("doc_id", "recipe").collect()
    names = {r["doc_id"]: r["recipe"] for r in rows}
    assert names[1] == names[3] != names[2] and names[4] == names[5]
    # every chunk under one key: the digests must tell them apart
    monkeypatch.setattr(exact_dedup, "_recipes", _one_key(exact_dedup._recipes))
    got = {g["doc_id"]: g["keep_id"] for g in collect(exact_dedup.exact_groups(docs))}
    assert got == {1: 3, 3: 3, 2: 2, 4: 4, 5: 4}


def _one_key(recipes):
    import pyarrow as pa

    def run(batches):
        for b in recipes(batches):
            chunks = [[c | {"key": 7} for c in row] for row in b.column("chunks").to_pylist()]
            yield b.set_column(b.schema.get_field_index("chunks"), "chunks", pa.array(chunks, pa.list_(exact_dedup.RECIPE)))

    return run


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 60_000).astype(np.uint8)
    ends = exact_dedup.cuts(data)
    assert ends[-1] == len(data) and all(b - a <= exact_dedup.MAX_CHUNK for a, b in zip([0, *ends], ends))
    moved = exact_dedup.cuts(np.concatenate((rng.integers(0, 256, 777).astype(np.uint8), data)))
    assert len({e - 777 for e in moved} & set(ends)) > len(ends) // 2


def slow_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_groups(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [slow_fingerprint(t) for _, t in rows]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    least = defaultdict(list)
    for (i, _), r in zip(rows, root):
        least[r].append(i)
    want = [str((i, f"{f:016x}", min((x for x in least[r] if x is not None), default=None))) for (i, _), f, r in zip(rows, fps, root)]
    got = collect(simhash.simhash_groups(docs))
    assert sorted(str((g["doc_id"], g["fingerprint"], g["component_id"])) for g in got) == sorted(want)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [3, 64, 2048])
def test_links_lose_nothing(spark, block):
    """Clusters around a few centres, in blocks from tiny to larger than the key."""
    rng = random.Random(block)
    fps = {0, (1 << 64) - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(df, 2, block).collect()]
    at = {simhash._signed(f): i for i, f in enumerate(fps)}
    got = components(len(fps), [(at[a], at[b]) for a, b in links])
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    assert got == want


def brute_lines(docs, min_words):
    """Delete every line that lies in a run of min_words words or more that occurred before (all runs tried)."""
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    seen, out = {}, {}
    for i, text in docs:
        lines = [s.strip() for s in (text or "").split("\n") if s.strip()]
        gone = set()
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if sum(len(s.split()) for s in run) < min_words:
                    continue
                first = seen.setdefault(run, (i, a))
                if first[0] != i:
                    gone |= set(range(a, b))
                elif first[1] < a:
                    gone |= set(range(max(a, first[1] + b - a), b))
        out[i] = "\n".join(s for k, s in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [" ".join(words(rng, rng.choice([2, 4, 9, 30, 55]))) for _ in range(30)]
    docs = []
    for i in range(50):
        lines = [" ".join(words(rng, rng.randint(1, 12))) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            at, size = rng.randrange(len(pool)), rng.randint(1, 6)
            k = rng.randint(0, len(lines))
            lines[k:k] = [x + rng.choice(["", " ", "\r"]) for x in pool[at:at + size]]
        if i % 7 == 0:
            lines += ["same short line"] * 40 + [""]
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, spans int")
    got = {g["doc_id"]: "\n".join(s.strip() for s in g["text"].split("\n") if s.strip()) for g in collect(line_dedup.dedup_lines(df))}
    assert got == brute_lines(docs, 50)


def test_line_dedup_edges(spark):
    passage = " ".join(f"w{k}" for k in range(51))
    rows = [(2, f"own\n{passage}\nend"), (1, passage), (3, None), (4, ""), (5, "\n \n"), (1, passage), (None, passage), (6, f"{passage}\n{passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collect(line_dedup.dedup_lines(df))
    by = defaultdict(list)
    for g in got:
        by[g["doc_id"]].append(g)
    assert len(got) == len(rows) and by[2][0]["text"] == "own\nend" and by[2][0]["first_ids"] == [1] and by[2][0]["n_removed"] == 1
    assert [g["text"] for g in by[1]] == [passage] * 2 and by[None][0]["text"] == "" and by[6][0]["text"] == ""
    assert by[3][0]["text"] is None and by[4][0]["text"] == "" and by[5][0]["text"] == "\n \n"
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
