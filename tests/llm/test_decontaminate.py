import random
import re

import numpy as np

from elevata.llm.decontaminate import FMIndex, decontaminate, remove_spans, suffix_array

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, window):
    grams = {}
    for i, t in items:
        w = WORD.findall(fold(t))
        k = min(window, len(w))
        for a in range(len(w) - k + 1) if w else []:
            grams.setdefault(tuple(w[a: a + k]), set()).add("" if i is None else str(i))
    out = []
    for t in docs:
        w = WORD.findall(fold(t))
        hit, found = set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                own = grams.get(tuple(w[a: a + k]))
                if own:
                    hit |= {*range(a, a + k)}
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_index():
    rng = np.random.default_rng(0)
    for _ in range(30):
        s = np.append(rng.integers(0, 5, rng.integers(1, 300)), 0)
        order = suffix_array(s, 5)
        assert sorted(order) == list(range(len(s)))
        index = FMIndex(s, 5)
        phrases = rng.integers(1, 5, (40, 3)).astype(np.int32)
        lengths = rng.integers(1, 4, 40)
        lo, hi = index.search(phrases, lengths)
        for p, k, a, b in zip(phrases, lengths, lo, hi, strict=True):
            want = [i for i in range(len(s) - k + 1) if (s[i: i + k] == p[:k]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b)))) == want


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "B", "c1", "é", "É", "dd", "zz", "naïve"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.randrange(0, 14))) for i in range(30)] + [(3, text(9)), (None, text(8)), (99, None), (98, "...")]
    docs = [text(rng.randrange(0, 60)) for _ in range(200)] + [None, "", "x" * 9000, text(30000)]
    frame = spark.createDataFrame([(i % 150, t, i) for i, t in enumerate(docs)], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (2, 5, 10):
        got = {r["items"]: r for r in decontaminate(frame, bench, window).collect()}
        want, want_text = brute(docs, items, window), {}
        for i, (n, hit, found) in enumerate(want):
            runs = got[i]["removal_spans"]
            assert (got[i]["n_words"], sum(b - a for a, b, _, _ in runs), got[i]["items_"]) == (n, hit, found)
            raw, at, left = (docs[i] or "").encode(), 0, b""
            for _, _, a, b in runs:
                left, at = left + raw[at:a], b
            want_text[i] = None if docs[i] is None else (left + raw[at:]).decode()
        cut = {r["items"]: r["text"] for r in remove_spans(decontaminate(frame, bench, window)).collect()}
        assert cut == want_text
    assert decontaminate(frame.limit(0), bench).count() == 0
    assert all(not r["items_"] for r in decontaminate(frame, bench.limit(0)).collect())


def test_blocks_of_items(spark, monkeypatch):
    import elevata.llm.decontaminate as d

    monkeypatch.setattr(d, "PHRASE_BYTES", 60)
    monkeypatch.setattr(d, "SHARD_BYTES", 40)
    monkeypatch.setattr(d, "SHARDS", 3)
    items = [(i, f"w{i} x y z w{i}") for i in range(9)] + [(None, "w1 x y z"), (77, None), (78, "x y")]
    docs = ["w1 x y z w1 x y z w1", "w2 x y z", "q w8 x y z w8 w3 x y z w3", None, "", "..."] + [f"a b w{i} x y z w{i}, c" for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate(frame, bench, 4)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(docs) and decontaminate(frame.limit(0), bench, 4).count() == 0
    for i, (n, hit, found) in enumerate(brute(docs, items, 4)):
        assert (got[i]["n_words"], sum(b - a for a, b, _, _ in got[i]["removal_spans"]), got[i]["items"]) == (n, hit, found)
