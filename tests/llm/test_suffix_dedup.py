import random
from collections import Counter

import numpy as np
import pytest

import elevata.llm.suffix_dedup as sd


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[i: i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if n[r[i: i + length]] > 1:
                gone[i: i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append(([[int(a), int(b)] for a, b in edge.reshape(-1, 2)], bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rng.randrange(20, 60)) for _ in range(4)]
    out = []
    for _ in range(n):
        t = text(rng.randrange(0, 120))
        kind = rng.randrange(6)
        if kind == 0 and out:
            t = rng.choice(out) or ""
        if kind == 1:
            t = t[: len(t) // 2] + rng.choice(passages) + t[len(t) // 2:]
        if kind == 2 and out:
            t = list(rng.choice(out) or "x")
            for _ in range(3):
                t[rng.randrange(len(t))] = "Z"
            t = "".join(t)
        if kind == 3:
            t += rng.choice(["ab", "x", "hello "]) * rng.randrange(1, 150) + text(9)
        out.append(t)
    return out


@pytest.mark.parametrize("length,bucket,lead", [(60, 4 << 20, 100), (60, 4 << 20, 15), (45, 3000, 11), (45, 200, 11), (5, 1000, 3)])
def test_against_brute_force(spark, monkeypatch, length, bucket, lead):
    monkeypatch.setattr(sd, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(sd, "LEAD", lead)
    monkeypatch.setattr(sd.anchors, "__defaults__", (lead,))
    monkeypatch.setattr(sd, "PIECE_BYTES", 3000)
    texts = corpus(length, 150) + [None, "", "short", "a" * 20000 + "b" + "a" * 9000]
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(5)
    want = brute(texts, length)
    got = {r["kept"]: r for r in sd.suffix_dedup(frame, length).collect()}
    assert len(got) == len(texts)
    for i, (cuts, kept) in enumerate(want):
        assert (got[i]["n_bytes"], got[i]["removed_spans"], bytes(got[i]["kept_"])) == (len((texts[i] or "").encode()), cuts, kept), i


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(0).choice("abcdefgh ") for _ in range(1000))
    frame = spark.createDataFrame([(1, text), (1, text), (2, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"], len(r["kept"]), r["removed_spans"]) for r in sd.suffix_dedup(frame).collect())
    assert got == [(1, 0, [[0, 1000]]), (1, 0, [[0, 1000]]), (2, 1, [])]
    assert sd.suffix_dedup(frame.limit(0)).count() == 0


def test_minima():
    x = np.random.default_rng(0).integers(0, 50, 1000).astype(np.uint64)
    for w in (1, 7, 301, 1000, 1001):
        assert sd.window_minima(x, w).tolist() == [x[i: i + w].min() for i in range(1000 - w + 1)]


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    for length in (3, 8, 9, 20):
        raw = rng.integers(97, 99, 4000).astype(np.uint8)
        raw[1000:1400] = raw[3000:3400]
        starts, group = np.arange(4000 - length + 1), rng.integers(0, 3, 4000 - length + 1).astype(np.uint64)
        data = raw.tobytes()
        n = Counter((int(g), data[i: i + length]) for i, g in zip(starts, group, strict=True))
        want = [n[int(g), data[i: i + length]] > 1 for i, g in zip(starts, group, strict=True)]
        assert sd.repeated_windows(raw, starts, length, group).tolist() == want
    assert not len(sd.repeated_windows(raw[:0], starts[:0], 9, group[:0]))


def test_many_repeated_rows(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    own, shared = text(900), text(700)
    frame = spark.createDataFrame([(1, own)] * 40 + [(None, shared)] * 9 + [(2, shared + text(500)), (3, text(50))], "doc_id long, text string")
    got = [(r["doc_id"], r["n_bytes"], r["removed_spans"]) for r in sd.suffix_dedup(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, 900, [[0, 900]])] * 40 + [(None, 700, [[0, 700]])] * 9 + [(2, 1200, [[0, 700]]), (3, 50, [])]))


@pytest.mark.parametrize("shared", [0, 1, 40])
def test_token_of_many_buckets(spark, monkeypatch, shared):
    """In all hash ranges, in all but one or in none, no window occurs again."""
    monkeypatch.setattr(sd, "BUCKET_BYTES", 500)
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    many = text(200000)
    at = int(sd.token_hashes(np.frombuffer(many.encode(), np.uint8), 100).argmin())
    texts = [text(120) + many[at: at + 100] + text(120) for _ in range(80)]
    # One window of another text, between other bytes.
    texts += [text(90) + "B" + t[70: 230] + "C" + text(90) for t in texts[:shared]]
    across = []
    monkeypatch.setattr(sd, "_across", lambda *a, f=sd._across: across.append(1) or f(*a))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["removed_spans"], bytes(r["kept"])) for r in sd.suffix_dedup(frame, 160).collect()}
    assert got == dict(enumerate(brute(texts, 160)))
    assert sum(len(cuts) for cuts, _ in got.values()) == 2 * shared
    assert across
