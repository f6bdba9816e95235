"""The classifier, the pipeline and the registered queries."""

import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from growthspark.llm import common, quality

from .helpers import collect, documents, words


def labelled(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = " ".join(words(rng, rng.randint(20, 120)) if good else [w.upper() + "!!" for w in words(rng, rng.randint(20, 120))])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    got = {g["doc_id"]: g for g in collect(quality.classify(docs, labels))}
    kept_out = [i for i, _, _ in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, g in got.items() if g["held_out"]} == set(kept_out)
    assert np.mean([got[i]["predicted"] == q for i, q, _ in truth if got[i]["held_out"]]) >= 0.97
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.3) for g in got.values())


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = labelled(spark, n=200)
    flipped = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, 1 - quality, quality) as quality", "toxic")
    a, b = (sorted((g["doc_id"], g["score"]) for g in collect(quality.classify(docs, x))) for x in (labels, flipped))
    assert a == b


def test_dual_coordinate_descent_reaches_the_optimum():
    """Primal and dual objectives of the hinge-loss model meet."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(40) < 0.3) for _ in range(120)]
    values = [rng.normal(size=len(r)) for r in rows]
    y = np.where(rng.random(120) < 0.5, 1.0, -1.0)
    cost = np.full(120, 0.7)
    w = quality.hinge_fit(rows, values, y, cost, epochs=300)
    margins = np.array([w[r] @ v + w[-1] for r, v in zip(rows, values)])
    primal = (w @ w) / 2 + (cost * np.maximum(0, 1 - y * margins)).sum()
    better = min((lambda u: (u @ u) / 2 + (cost * np.maximum(0, 1 - y * np.array([u[r] @ v + u[-1] for r, v in zip(rows, values)]))).sum())(
        w + rng.normal(size=len(w)) * np.append(np.arange(len(w) - 1) < 40, True) * s) for s in (1e-3, 1e-2, 1e-1) for _ in range(50))
    assert primal <= better + 1e-6


def slow_features(text):
    """The features by their definition: one n-gram at a time, in Python integers."""
    mult, whole = 0x9E3779B97F4A7C15, (1 << 64) - 1
    out = set()

    def add(data, size, salt):
        for i in range(len(data) - size + 1):
            v = (int.from_bytes(bytes(data[i:i + size]), "little") + salt) * mult & whole
            out.add(((v ^ v >> 32) * mult & whole) >> 64 - quality.BITS)

    def shape(b):
        return ord("a") if b >= 0x80 or chr(b).islower() else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else b

    for size, salt in ((2, 1), (3, 2), (4, 3)):
        add(text, size, salt)
    for size, salt in ((4, 4), (6, 5), (8, 6)):
        add([shape(b) for b in text], size, salt)
    found = bytes(b if b > 0x20 else 0x20 for b in text).split(b" ")
    found = [w for w in found if w]
    add([(k > 0 and found[k] == found[k - 1]) + 2 * (k > 1 and found[k] == found[k - 2]) for k in range(len(found))], 4, 7)
    return sorted(out)


def texts(n=30, seed=8):
    rng = random.Random(seed)
    fixed = ["", "a", "é", "a a a b a b", "tab\there\nand\x01there", "  lead and trail  ", "ÀÉ 12 x7 X7!"]
    return [t.encode() for t in fixed] + [" ".join(words(rng, rng.randint(1, 60))).encode() for _ in range(n)]


def test_features_by_definition():
    for t in texts():
        assert quality.features(np.frombuffer(t, np.uint8)).tolist() == slow_features(t)


def test_chunks_of_a_long_text_lose_no_gram(monkeypatch):
    t = b"".join(texts())
    whole = set(slow_features(t))
    monkeypatch.setattr(quality, "_CHUNK", 50)
    monkeypatch.setattr(quality, "_echoes", lambda data: np.zeros(0, np.uint8))
    got = set(quality.features(np.frombuffer(t, np.uint8)).tolist())
    assert got <= whole and len(whole - got) <= 4 ** 4  # all but the word-repeat grams


def test_scores_by_definition():
    """Ratios, margins and the logistic curve from plain sums over the training rows."""
    rng = random.Random(9)
    rows = [np.array(sorted(rng.sample(range(60), rng.randint(1, 20)))) for _ in range(80)]
    y = np.array([int(r.mean() + rng.gauss(0, 5) > 30) for r in rows])
    m = quality.fit(rows, y)
    train = [i for i in range(80) if i % quality.FOLDS != quality.FOLDS - 1]
    up, down = [rows[i] for i in train if y[i]], [rows[i] for i in train if not y[i]]
    ratio = np.array([np.log((1 + sum(f in r for r in up)) / (2 + len(up))) - np.log((1 + sum(f in r for r in down)) / (2 + len(down))) for f in range(60)])
    assert np.allclose(m.squares[:60], ratio ** 2)
    w = np.divide(m.weights[:60], ratio, out=np.zeros(60), where=ratio != 0)
    margin = np.array([sum(w[f] * ratio[f] for f in r) / np.sqrt(sum(ratio[f] ** 2 for f in r)) + m.bias for r in rows])
    judged = [i for i in range(80) if i not in train]
    target = np.where(y[judged] == 1, (y[judged].sum() + 1) / (y[judged].sum() + 2), 1 / ((1 - y[judged]).sum() + 2))
    loss = lambda a, b: -(target * np.log(1 / (1 + np.exp(-a * margin[judged] - b))) + (1 - target) * np.log(1 / (1 + np.exp(a * margin[judged] + b)))).sum() + 5e-7 * a * a
    best = loss(m.slope, m.shift)
    assert all(best <= loss(m.slope + da, m.shift + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    assert all(m.score(r) == pytest.approx(1 / (1 + np.exp(-m.slope * g - m.shift))) for r, g in zip(rows, margin))


def test_a_common_id_is_learned_from_once(spark):
    docs, labels, _ = labelled(spark, n=120)
    common_id = docs.where("doc_id = 1")
    many = docs.unionByName(common_id.crossJoin(spark.range(2000)).select(*docs.columns))
    a, b = (dict(quality.classify(d, labels).select("doc_id", "score").distinct().collect()) for d in (docs, many))
    assert a == b


def test_awkward_rows_and_no_labels(spark):
    docs, labels, _ = labelled(spark, n=100)
    odd = documents(spark)
    odd_labels = labels.union(spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 7, 0), (5, 0, 0), (5, 0, 0)], labels.schema))
    got = collect(quality.classify(docs.union(odd.select("doc_id", "text")), odd_labels))
    assert len(got) == docs.count() + odd.count()
    assert {g["score"] for g in collect(quality.classify(odd, labels.limit(0)))} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    from .helpers import components
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    want = components(len(nodes), [(at[a], at[b]) for a, b in pairs if a != b])
    assert set(got) == set(nodes)
    assert all((want[at[x]] == want[at[y]]) == (got[x] == got[y]) for x in nodes for y in rng.sample(nodes, 20))


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = common.stage(step(spark, kept, sf), name)
        assert kept.columns == columns and 0 < kept.count() <= before
        before = kept.count()
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in kept.collect()}


def test_pipeline_takes_awkward_and_empty_tables(spark, sf):
    for docs in (documents(spark), documents(spark).limit(0)):
        for _, step in corpus_pipeline.STAGES:
            docs = common.stage(step(spark, docs, sf), "odd")
        docs.count()


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert [q for q in names if q.startswith(f"op{n}_")]
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op2_sharding", "op4_line_dedup", "op6_simhash", "op9_exact_dedup"])
def test_one_row_per_document(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
