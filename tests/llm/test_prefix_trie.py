import hashlib
import random
import zlib

import pytest

from growthspark.llm import prefix_trie
from tests.llm.helpers import collect

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """(conv_id, turn, role, text) rows, whose turns must differ within a conversation: the nodes by their prefixes."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        built[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
        ends.setdefault(t, []).append(c)
    below = {p: [] for p in members}
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in below[p]) if below[p] else 1
        saved[p] = sum(saved[q] for q in below[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below[p]), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "s", 1, b"") for c, t, r, x in rows],
                                 "conv_id long, turn int, role string, text string, key string, n int, blob binary")


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in collect(df)), key=str)


def talks(seed, n=70):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -7, 1000, 1001, 1004, 2503]:
        long = rng.choice([1, 2, 5, 12, 13, 30])
        texts = rng.choice([["a"], ["a", "é"], ["x", "y", "z" * 50, ""]])
        for k in range(long):
            rows.append((c, 2 * k, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ["user", "assistant"][k % 2], rng.choice(texts)))
    rows += [(3, None, "system", "first"), (8, None, None, None), (None, 1, "user", "no id"), (5000, 0, None, "only"), (7001, 0, "user", "gone")]
    same = [(100 + 5 * c, k, "user", "copy") for c in range(40) for k in range(14)]
    return rows + same


@pytest.mark.parametrize(("seed", "page", "limit"), [(2, 4, 12), (5, 50, 40)])
def test_nodes_match_brute_force(spark, seed, page, limit):
    rows = talks(seed)
    random.Random(seed).shuffle(rows)
    assert got(prefix_trie.prefix_trie(table(spark, rows), page, limit)) == brute(rows)


def test_one_long_conversation_and_copies_of_it(spark):
    rows = [(c, k, "user", f"turn {k % 11}") for c in (20, 25, 30) for k in range(300)] + [(40, k, "user", "alone") for k in range(200)]
    rows += [(20, k, "user", "tail") for k in range(300, 420)]
    assert got(prefix_trie.prefix_trie(table(spark, rows), 64, 100)) == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    assert got(prefix_trie.prefix_trie(table(spark, []))) == []
    rows = [(0, 0, "user", "a")] * 3 + [(5, 0, "user", "a")]
    nodes = got(prefix_trie.prefix_trie(table(spark, rows)))
    assert max(n[1] for n in nodes) == 3  # a repeated row is a turn of its own
