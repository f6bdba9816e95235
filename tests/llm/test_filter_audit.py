import random
import re
from itertools import permutations

import pytest

from growthspark.llm import filter_audit
from tests.llm.helpers import collect, documents


def brute(rows, labels):
    """Runs all 120 orders one after the other over (doc_id, text, lang) rows."""
    labels = [r for r in labels if r[0] is not None]  # a null id names no document
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = {}
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
             "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts.setdefault(lang or "", []).append((i, f))
    out = {}
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = docs, []
            for k, c in enumerate(order):
                hit = [d for d in left if d[1][c]]
                out[part, "".join(order), k + 1] = [
                    len(left) - len(hit), len(hit), sum(d[1][c] for d in gone),
                    sum(d[1][c] and sum(d[1].values()) == 1 for d in docs), sum(d[0] in good for d in hit), sum(d[0] in toxic for d in hit)]
                shapley[c] += len(hit)
                left, gone = [d for d in left if not d[1][c]], gone + hit
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                out[part, "".join(order), k + 1].append(shapley[c])
    return out


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
            for r in collect(df)}


@pytest.mark.parametrize("seed", [1, 2])
def test_steps_match_running_every_order(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        n = rng.choice([0, 5, 99, 100, 101, 140])
        words = [rng.choice(["the", "The", "A", "BIG", "x#", "50%", "né", "ok"]) + (str(rng.randint(0, 60)) if rng.random() < 0.8 else "") for _ in range(n)]
        rows.append((i, rng.choice([" ", "\n", "  ", "\t\x0b"]).join(words), rng.choice(["en", "fr", None])))
    rows += [(rng.randint(0, 160), rows[rng.randrange(20)][1], rng.choice(["en", "", "xx"])) for _ in range(60)]
    rows += [(5, rows[5][1], "en")] * 3 + [(None, rows[1][1], "en"), (None, None, None), (300, None, "zz"), (301, "", "zz"), (302, "Word " * 30000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, lang, 1, "m") for i, t, lang in rows], "doc_id long, text string, lang string, n int, mask string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(filter_audit.audit_filters(docs, marks)) == brute(rows, labels)


def test_shared_fixture_and_empty_tables(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    assert got(filter_audit.audit_filters(docs, labels)) == brute(rows, [])
    assert filter_audit.audit_filters(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("n", [2, 3, 5])
def test_normal_equations_give_shapley_values(n):
    rng = random.Random(n)
    v = [0] + [rng.randint(0, 99) for _ in range((1 << n) - 1)]
    want = [0] * n
    for order in permutations(range(n)):
        s = 0
        for i in order:
            want[i] += v[s | 1 << i] - v[s]
            s |= 1 << i
    assert [sum(w * x for w, x in zip(row, v)) for row in filter_audit.shapley_map(n)] == want
