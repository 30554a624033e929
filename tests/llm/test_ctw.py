import zlib
from collections import Counter
from math import lgamma, log, log10

import numpy as np
import pytest

import elevata.llm.ctw as ctw


def words_of(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        fold = fold.replace(c, " ")
    return [w for w in fold.split(" ") if w]


def bytes_of(text):
    return b"\0" * ctw.DEPTH + b"".join(w.encode() + b" " for w in words_of(text)) + b"\n"


class Brute:
    """The tree by definition: recursion over children, one dict of counts."""

    def __init__(self, texts):
        self.counts = Counter()
        for t in texts:
            s = bytes_of(t)
            for i in range(ctw.DEPTH, len(s)):
                for bit in range(8):
                    prefix, b = 1 << bit | s[i] >> 8 - bit, s[i] >> 7 - bit & 1
                    for d in range(ctw.DEPTH + 1):
                        self.counts[s[i - d: i], prefix, b] += 1
        self.kids = {}
        for c, p, _ in self.counts:
            if c:
                self.kids.setdefault((c[1:], p), set()).add(c)
        self.memo = {}

    def kt(self, c, p):
        a, b = self.counts[c, p, 0], self.counts[c, p, 1]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - 2 * lgamma(0.5) - lgamma(a + b + 1)

    def lw(self, c, p):
        if (c, p) not in self.memo:
            e = self.kt(c, p)
            if len(c) < ctw.DEPTH:
                e = log(0.5) + np.logaddexp(e, sum(self.lw(k, p) for k in self.kids.get((c, p), ())))
            self.memo[c, p] = e
        return self.memo[c, p]

    def predict(self, c, p, b, d=0):
        own = c[len(c) - d:]
        n = self.counts[own, p, 0] + self.counts[own, p, 1]
        if not n:
            return 0.5
        kt = (self.counts[own, p, b] + 0.5) / (n + 1)
        if d == ctw.DEPTH:
            return kt
        w = np.exp(log(0.5) + self.kt(own, p) - self.lw(own, p))
        return w * kt + (1 - w) * self.predict(c, p, b, d + 1)

    def score(self, text):
        s, out = bytes_of(text), 0.0
        for i in range(ctw.DEPTH, len(s)):
            for bit in range(8):
                out += log10(self.predict(s[i - ctw.DEPTH: i], 1 << bit | s[i] >> 8 - bit, s[i] >> 7 - bit & 1))
        return out


TEXTS = ["The cat sat on the mat", "the dog sat  on\tthe log\n", None, "", "Été à la plage été", "zzz qqq \x00\x01", "the cat and the dog " * 30, "x" * 300, "The cat sat on the mat"]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 300)
    monkeypatch.setattr(ctw, "PIECE_BYTES", 100)
    monkeypatch.setattr(ctw, "HELD_PAIRS", 50)
    train = [t for i, t in enumerate(TEXTS) if i not in (1, 4)]
    brute = Brute(train)
    tokens = Counter(w for t in train for w in [*words_of(t), None])
    n, v = sum(tokens.values()), len(tokens)
    frame = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, score int").repartition(3)
    model = ctw.fit(frame.filter("doc_id not in (1, 4)"))
    assert (model.n_tokens, model.n_words) == (n, v)
    got = {r["doc_id"]: r for r in ctw.score(frame, model).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        own = [*words_of(t), None]
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(own), sum(tokens[w] > 0 for w in own))
        assert got[i]["base_score"] == pytest.approx(sum(log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert got[i]["score"] == pytest.approx(brute.score(t), rel=1e-9)
        assert got[i]["bits_per_byte"] == pytest.approx(-got[i]["score"] / log10(2) / (len(bytes_of(t)) - ctw.DEPTH))


def test_nothing_to_learn_or_score(spark):
    frame = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, None)], "doc_id long, text string")
    model = ctw.fit(frame.limit(0))
    got = sorted((r["doc_id"] or 0, round(r["bits_per_byte"], 9), r["n_known"]) for r in ctw.score(frame, model).collect())
    assert got == [(0, 8.0, 0), (1, 8.0, 0), (1, 8.0, 0)]
    assert ctw.score(frame.limit(0), ctw.fit(frame)).count() == 0


def test_sums_to_one(spark):
    pairs = np.sort(np.random.default_rng(0).integers(0, 3, (4000, ctw.DEPTH + 1)) @ (np.uint64(256) ** np.arange(ctw.DEPTH + 1, dtype=np.uint64)))
    pairs, counts = np.unique(pairs.astype(np.uint64), return_counts=True)
    tree = ctw.build(pairs, counts.astype(np.int64), 0)
    for context in (0, 0x0102010002, 0xFF00000000):
        every = np.uint64(context << 8) + np.arange(256, dtype=np.uint64)
        assert np.exp(ctw.code_lengths(tree, every)).sum() == pytest.approx(1)


def test_held_out_beats_single_words(spark):
    rows = ctw.op4_ctw(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_repeated_rows_are_scored_once(spark, monkeypatch):
    import elevata.llm.ctw as ctw

    monkeypatch.setattr(ctw, "COPIES", 7)
    rows = [(1, "a b a")] * 30 + [(None, "same")] * 15 + [(2, None), (2, ""), (3, "b")]
    docs = spark.createDataFrame(rows, "score long, text string")
    out = ctw.score(docs, ctw.fit(docs), id_col="score").collect()
    assert len(out) == len(rows)
    assert len({tuple(r) for r in out}) == 4 and sum(r["score"] == 1 for r in out) == 30 and sum(r["score"] is None for r in out) == 15
    assert all(r["score_"] < 0 for r in out)
