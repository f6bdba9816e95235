import gzip
import os
import random
import time
from hashlib import sha256

from growthspark.llm import warc
from growthspark.llm.common import new_path

from .helpers import collect

BIG = "<html>" + "x" * 200


def pages(spark):
    rows = [(1, "http://a", BIG), (2, "http://b", BIG), (3, "http://c\r\nX: y", "small"), (4, None, "small"), (5, "http://d", None), (6, "http://e", ""),
            (7, "http://f", "body\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "é" * 60), (2, "http://b", BIG), (1, "http://a", BIG),
            (None, "http://g", BIG), (8, "http://h", "long " * 200_000), (9, "u", "a" * 99), (10, "u", "a" * 99), (11, "u", "a" * 100), (12, "u", "a" * 100)]
    return rows, spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")


def test_write_and_read_back(spark):
    rows, df = pages(spark)
    path = new_path(spark, "warc-test")
    warc.write_archives(df, path)
    found = warc.read_archives(spark, path)
    assert warc.gaps(found).count() == 0
    got = collect(warc.records(found))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min((j for j, _, h in rows if (h or "").encode() == data and j is not None), default=None) if len(data) >= 100 else None
        later = first is not None and i != first
        want.append((i, len(data), sha256(data).hexdigest(), "revisit" if later else "response", first if later else None))
    keys = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(str, want)) == sorted(str(tuple(g[k] for k in keys)) for g in got)


def test_no_pages(spark):
    _, df = pages(spark)
    path = new_path(spark, "warc-none")
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def record(n, body):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha256:{sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def covered(data, found):
    assert [f.start for f in found[1:]] == [f.stop for f in found[:-1]] and found[0].start == 0 and found[-1].stop == len(data)


def test_salvage_after_any_damage():
    """Cut out, overwrite or insert bytes: undamaged records come back, and every byte is in a record or a gap."""
    rng = random.Random(2)
    for packed in (False, True):
        whole = [record(n, bytes(rng.randrange(256) for _ in range(rng.randint(0, 300)))) for n in range(12)]
        parts = [gzip.compress(r) for r in whole] if packed else whole
        data = b"".join(parts)
        clean = list(warc.salvage(data))
        assert [f.payload for f in clean] == [w.partition(b"\r\n\r\n")[2][:-4] for w in whole] and not any(f.reason for f in clean)
        for _ in range(150):
            a = rng.randrange(len(data))
            b = min(len(data), a + rng.randint(1, 120))
            hurt = data[:a] + rng.choice([b"", bytes(b - a), b"WARC/1.1\r\nnonsense\r\n\r\n"]) + data[b:]
            if hurt == data:
                continue
            found = list(warc.salvage(hurt))
            covered(hurt, found)
            ends = [sum(map(len, parts[:k + 1])) for k in range(12)]
            safe = {k for k in range(12) if ends[k] <= a or ends[k] - len(parts[k]) >= b}
            bodies = [w.partition(b"\r\n\r\n")[2][:-4] for w in whole]
            assert {f.payload for f in found if not f.reason} >= {bodies[k] for k in safe}


def test_archives_from_elsewhere(spark, tmp_path):
    good, bad = record(1, b"payload"), record(2, b"other")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(bad)[:-9] + gzip.compress(record(3, b"x")))
    (tmp_path / "b.warc").write_bytes(b"rubbish" + good + bad[:-8])
    (tmp_path / "c.warc").write_bytes(b"")
    found = warc.read_archives(spark, str(tmp_path))
    assert sorted(g["page_id"] for g in collect(warc.records(found))) == [1, 1, 3]
    assert warc.gaps(found).count() == 3


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    """Small limits stand for the large ones: no file of several records holds more than its class allows."""
    monkeypatch.setattr(warc, "FILE_CLASSES", [(1000, 8), (4000, 2)])
    rng = random.Random(5)
    rows = [(i, f"u{i}", "".join(rng.choice("abc ") for _ in range(rng.choice([3, 90, 1500, 9000])))) for i in range(120)]
    path = new_path(spark, "warc-sizes")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
    found = collect(warc.read_archives(spark, path))
    assert sorted((g["page_id"], bytes(g["payload"]).decode()) for g in found) == sorted((i, h) for i, _, h in rows)
    files = {}
    for g in found:
        files.setdefault(g["archive"], []).append(g["stop"] - g["start"])
    assert 1 < max(map(len, files.values())) <= 8
    assert all(len(sizes) == 1 or sum(sizes) <= 8 * 1000 + 8 * 4 for sizes in files.values())


def test_archives_read_in_byte_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(warc, "_IN_BYTES", 1)
    _, df = pages(spark)
    path = new_path(spark, "warc-batches")
    warc.write_archives(df.repartition(6), path)
    assert warc.records(warc.read_archives(spark, path)).count() == df.count()


def seconds(data):
    start = time.process_time()
    assert not any(f.reason for f in warc.salvage(data))
    return time.process_time() - start


def test_time_grows_with_the_archive():
    """Four times the members, about four times the time (16 times where each member copies the rest)."""
    member = gzip.compress(record(1, os.urandom(15_000)))
    assert seconds(member * 4000) < 8 * max(seconds(member * 1000), 0.05)


def test_many_version_lines_without_a_header():
    bad = b"WARC/1.1\r\n" * 200_000
    start = time.process_time()
    found = list(warc.salvage(bad + record(1, b"kept")))
    assert [f.payload for f in found if not f.reason] == [b"kept"] and time.process_time() - start < 20
