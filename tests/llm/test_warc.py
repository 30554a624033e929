import hashlib
import random

import pytest
from pyspark.sql import functions as F

import elevata.llm.warc as w
from elevata.llm.common import new_path


def test_record_round_trip():
    for body in (b"", "é\r\n\r\nWARC/1.1".encode(), b"x" * 5000):
        got = w.parse(w.record("7", "http://a/\r\nb", body, None, "2024-01-01T00:00:00Z"))
        assert (got["id"], got["payload"], got["payload_bytes"], got["digest"]) == ("7", body, len(body), hashlib.sha1(body).hexdigest())
        got = w.parse(w.record("7", "", body, "9", "2024-01-01T00:00:00Z"))
        assert (got["record_type"], got["refers_to"], got["payload"], got["payload_bytes"]) == ("revisit", "9", None, len(body))
    with pytest.raises(ValueError):
        w.parse(w.record("7", "u", b"abc", None, "d").replace(b"abc", b"abd"))


def test_write_and_read(spark, monkeypatch):
    monkeypatch.setattr(w, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(w, "GAP_BYTES", 100)
    big, other = "<p>" + "é" * 900, "".join(chr(33 + i * 7 % 90) for i in range(2000))
    rows = [(1, "u1", big), (5, None, big), (3, "u3", big), (2, "u", "tiny"), (4, "u", "tiny"), (6, "u", None), (8, "u", other), (8, "u", other), (7, "u", other), (None, "u", other)]
    pages = spark.createDataFrame(rows, "id long, url string, payload string").withColumn("digest", F.lit("own")).withColumn("key", F.lit(1)).repartition(3)
    folder = new_path(spark, "warc-test")
    index = w.write_archives(w.with_revisits(pages), folder)
    got = w.read_archives(index, folder).collect()
    want = []
    for i, u, p in rows:
        p = p or ""
        same = [j for j, _, q in rows if (q or "") == p and j is not None]
        again = len(p.encode()) >= 1000 and i != max(same)
        want.append(("" if i is None else str(i), u or "", "revisit" if again else "response", str(max(same)) if again else None, hashlib.sha1(p.encode()).hexdigest(), len(p.encode()), None if again else p))
    order = lambda rows: sorted(map(repr, rows))
    assert order(map(tuple, got)) == order(want)
    some = w.read_archives(index.filter("length % 2 = 0"), folder)
    assert some.count() == index.filter("length % 2 = 0").count()
    none = w.write_archives(w.with_revisits(pages.limit(0)), new_path(spark, "warc-none"))
    assert none.count() == 0 and w.read_archives(none, folder).count() == 0


def test_very_long_payload(spark):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz<>/ é") for _ in range(3_000_000))
    pages = spark.createDataFrame([(1, "u", body), (2, "u", body), (3, "u", "x")], "id long, url string, payload string")
    folder = new_path(spark, "warc-long")
    got = {r["id"]: r for r in w.read_archives(w.write_archives(w.with_revisits(pages), folder), folder).collect()}
    assert got["2"]["payload"] == body and got["1"]["refers_to"] == "2" and got["1"]["payload_bytes"] == len(body.encode())


def test_reading_is_dealt_over_tasks(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"{i} " * 50) for i in range(400)], "id long, url string, payload string")
    folder = new_path(spark, "warc-tasks")
    assert w.read_archives(w.write_archives(w.with_revisits(pages), folder), folder).rdd.getNumPartitions() > 1
