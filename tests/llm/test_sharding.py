import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from growthspark.llm import sharding

from .helpers import collect, documents


def smallest_capacity(sizes, shards):
    def fits(cap):
        used, now = 1, 0
        for s in sizes:
            if now + s > cap:
                used, now = used + 1, 0
            now += s
        return used <= shards

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("shards,cells", [(16, 4096), (3, 64), (1, 64), (200, 64)])
def test_minimax(spark, monkeypatch, shards, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    docs = documents(spark, n=150)
    source = docs.select("doc_id", "text").collect()
    got = collect(sharding.shard_documents(docs, shards))
    assert len(got) == len(source)
    groups, wanted = defaultdict(int), []
    for r in source:
        data = (r["text"] or "").encode()
        groups[sha256(data).hexdigest()] += len(data) + 1
        wanted.append((r["doc_id"], len(data) + 1, zlib.crc32(data)))
    assert sorted(map(str, wanted)) == sorted(str((g["doc_id"], g["size"], g["text_crc32"])) for g in got)
    load, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for g in got:
        load[g["shard"]] += g["size"]
        slots[g["shard"]].append(g["slot"])
        where[g["size"], g["text_crc32"]].add(g["shard"])
        assert 0 <= g["shard"] < shards and g["law"] == "bytes" and g["grown_shard"] is None
    assert max(load.values()) == smallest_capacity([groups[k] for k in sorted(groups)], shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(w) == 1 for w in where.values())


def test_hot_group_and_empty(spark):
    docs = spark.createDataFrame([(i, "same text " * 9 if i % 3 else f"t{i}") for i in range(300)], "doc_id long, text string")
    got = collect(sharding.shard_documents(docs, 4))
    assert len(got) == 300 and len({g["shard"] for g in got if g["doc_id"] % 3}) == 1
    assert sharding.shard_documents(docs.limit(0), 4).count() == 0


def test_native(spark):
    plan = sharding.shard_documents(documents(spark), 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
