import numpy as np
import pytest

from growthspark.llm import embedding_dedup as ed

from .helpers import collect, components


def table(spark, n=600, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        if i and rng.random() < 0.4:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=dim) * rng.choice([0, 0.02, 0.05, 0.07])
        rows.append((i, (v * 10.0 ** rng.integers(-3, 3)).astype(np.float32).tolist()))
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0], [-1.0]]
    rows += [(n + k, v) for k, v in enumerate(odd)] + [(5, rows[5][1]), (None, rows[5][1])]
    return rows, spark.createDataFrame([(i, v, 3, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, cell int")


def brute(rows, least):
    def ok(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok(v) else None for _, v in rows]
    n, links, pairs = len(rows), [0] * len(rows), []
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    root = components(n, pairs)
    least_id = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least_id[r] = min(least_id.get(r, i), i)
    return [(i, links[k], least_id.get(root[k])) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("cell_rows,block,margin", [(2048, 2048, 0.1), (64, 16, 0.4)])
def test_groups(spark, cell_rows, block, margin):
    """Exact with one cell, and with many cells and a margin that no link can span."""
    rows, df = table(spark)
    want = brute(rows, 0.95)
    got = collect(ed.embedding_groups(df, 0.95, margin, cell_rows, block))
    assert sorted(str((g["vec_id"], g["n_links"], g["component_id"])) for g in got) == sorted(map(str, want))
    assert all(g["kept"] == (g["vec_id"] == g["component_id"]) for g in got)


def test_recall_of_many_cells(spark):
    rows, df = table(spark, n=800, seed=4)
    want = sum(n for _, n, _ in brute(rows, 0.95))
    got = sum(g["n_links"] for g in collect(ed.embedding_groups(df, 0.95, cell_rows=64)))
    assert 0.9 * want <= got <= want


def test_all_links_of_few_effective_dimensions(spark):
    """Vectors of 8 effective dimensions of 64, in many cells: every link counts at both ends."""
    rng = np.random.default_rng(5)
    plane = np.linalg.qr(rng.normal(size=(64, 8)))[0].T
    low = rng.normal(size=(2000, 8))
    low /= np.linalg.norm(low, axis=1)[:, None]
    for i in range(0, 2000, 2):  # pairs at cosine .951 to .99
        u = rng.normal(size=8)
        u -= (u @ low[i]) * low[i]
        c = rng.uniform(0.951, 0.99)
        low[i + 1] = c * low[i] + np.sqrt(1 - c * c) * u / np.linalg.norm(u)
    x = low @ plane
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    least = components(len(x), np.argwhere(near).tolist())
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {g["vec_id"]: (g["n_links"], g["component_id"]) for g in collect(ed.embedding_groups(df, 0.95, cell_rows=32))}
    assert got == {i: (int(near[i].sum()), least[i]) for i in range(len(x))}


def test_empty(spark):
    _, df = table(spark, n=9)
    assert ed.embedding_groups(df.limit(0)).count() == 0
    assert ed.embedding_groups(df.where("embedding is null")).count() == 1
