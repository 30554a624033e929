import random

import numpy as np
import pytest

import elevata.llm.ngram_join as nj


def sets(text, k=5):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        fold = fold.replace(c, " ")
    w = [x for x in fold.split(" ") if x]
    return {tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(s[i] & s[j])
            if s[i] and s[j] and 100 * inter >= 80 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def corpus(seed, groups, most, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, words))]
        if rng.random() < 0.3:
            base += passage.split()
        for _ in range(rng.randrange(1, most)):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", " \t"]).join(copy).title() if rng.random() < 0.5 else " ".join(copy))
    return out


@pytest.mark.parametrize("frequent,chunk", [(16, 150_000), (3, 1500)])
def test_against_brute_force(spark, monkeypatch, frequent, chunk):
    monkeypatch.setattr(nj, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(nj, "FREQUENT", frequent)
    texts = corpus(1, 60, 8, 150) + corpus(2, 2, 120, 120) + [None, "", " \n", "a b", "A  b", "a b c d e", "x"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[0]), (None, "alone in the world of texts")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    got = sorted((tuple(r) for r in nj.ngram_groups(frame).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_empty(spark):
    assert nj.ngram_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_meet():
    """Any two linked sets share an entry, whatever is frequent."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(3, 400))
        base = rng.integers(0, 1 << 60, n).astype(np.uint64)
        a, b = base.copy(), base[: max(1, int(n * rng.uniform(0.8, 1)))].copy()
        for x in (a, b):
            change = rng.random(len(x)) < 0.05
            x[change] = rng.integers(0, 1 << 60, int(change.sum())).astype(np.uint64)
        a, b = set(a.tolist()), set(b.tolist())
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        both, share = a & b, rng.random()
        frequent = {x for x in both if x % 997 < 997 * share}
        entries = []
        for x in (a, b):
            order = sorted(both, key=lambda t: (t in frequent, t))
            entries.append({*nj.signatures(len(x), np.array(order, np.uint64), len(both) - len(frequent), 80).tolist()})
        assert entries[0] & entries[1]
