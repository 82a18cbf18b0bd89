import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from wattlens.llm import warc

PAGES = "page_id long, url string, html string"


def brute(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(b)
        revisit = to is not None and i != to
        out.append((str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def pages():
    r = random.Random(4)
    big = "<html>" + "é" * 60
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://b/ü\r\nX-Page-Id: 9", "x" * 99), (4, "u", "x" * 99), (9, "u", big), (7, "u", big), (8, "u", big), (7, "u", big),
            (None, "u", big), (None, "u", "y" * 200), (None, "u", "y" * 200), (20, "u", "\r\n\r\n" * 50), (21, "u", "z" * 3_000_000), (22, "u", "z" * 3_000_000)]
    rows += [(100 + i, f"http://h/{i}", r.choice(["same " * 30, "other " * 40, f"own {i} " * 30])) for i in range(60)]
    r.shuffle(rows)
    return rows


def test_round_trip(spark, tmp_path, monkeypatch):
    rows = pages()
    got = warc.round_trip(spark, spark.createDataFrame(rows, PAGES).repartition(3).withColumn("digest", F.lit("mine")), f"file://{tmp_path}/w", payload=True).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    for r in got:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    # every file is plain WARC in gzip, one member a record
    files = list((tmp_path / "w" / "archives").glob("*.warc.gz"))
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == len(rows)


def test_empty_table(spark, tmp_path):
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES), f"file://{tmp_path}/w").count() == 0


def archive(*items):
    return b"".join(warc.member(warc.record_bytes(i, "u", p, hashlib.sha256(p).hexdigest())) for i, p in items)


class Slow(io.BytesIO):
    """Hands out a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7))


def test_reader_frames_any_chunking():
    items = [(1, b""), (2, b"\r\n\r\n"), (3, b"a" * 5000), (4, bytes(range(256)))]
    for source in (io.BytesIO, Slow):
        got = list(warc.records(source(archive(*items))))
        assert [(int(r.headers["x-page-id"]), r.payload) for r in got] == items


def test_reader_rejects_damage():
    good = archive((1, b"payload " * 40))
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(good[:-9])))
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(good + b"junk")))
    plain = warc.record_bytes(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest())
    for bad in (plain.replace(b"payload\r\n\r\n", b"payl0ad\r\n\r\n"), plain + b"x", plain.replace(b"Content-Length: ", b"Content-Size: "), plain[:-4],
                warc.record_bytes(1, "u", b"payload", "0" * 64)):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(warc.member(bad))))


def test_files_roll(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 300)
    a = warc.member(b"x")
    class Context:
        def partitionId(self): return 3
        def taskAttemptId(self): return 5
    monkeypatch.setattr(warc.TaskContext, "get", staticmethod(Context))
    out = warc._Archive(f"file://{tmp_path}/r")
    for _ in range(40):
        out.add(a)
    out.close()
    assert len(out.done) > 1 and sum(n for _, n, _ in out.done) == 40 and len({p for p, _, _ in out.done}) == len(out.done)
