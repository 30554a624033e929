"""The queries on a whole table, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import tiktoken

from elevata.llm.bpe import load_ranks, public_ranks
from elevata.llm.pii import luhn
from elevata.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def fold(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def test_op2(spark, docs):
    raw = {i: t.encode() for i, t in docs.items()}
    n = Counter(hash(r[k: k + 400]) for r in raw.values() for k in range(len(r) - 399))
    got = {r["doc_id"]: r for r in QUERIES["op2_suffix_dedup"](spark, SF).collect()}
    assert got.keys() == raw.keys()
    for i, r in raw.items():
        edge = np.zeros(len(r) + 1, np.int64)
        for k in range(len(r) - 399):
            if n[hash(r[k: k + 400])] > 1:
                edge[k] += 1
                edge[k + 400] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want = (len(r), int(gone.sum()), spans, sha(np.frombuffer(r, np.uint8)[~gone].tobytes()))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want


def test_op3(spark, docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall("[^\x20\x09-\x0d]+", fold(t))
        sets[i] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op3_ngram_join"](spark, SF).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_op6(spark, docs):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    grams = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(fold(r["text"] or ""))
        k = min(10, len(w))
        for a in range(len(w) - k + 1) if w else ():
            grams[tuple(w[a: a + k])].add(str(r["item_id"]))
    sizes = {len(g) for g in grams}
    got = {r["doc_id"]: r for r in QUERIES["op6_decontaminate"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        w, hit, items = word.findall(fold(t)), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if own := grams.get(tuple(w[a: a + k])):
                    hit.update(range(a, a + k))
                    items |= own
        want = (len(w), len(hit), len(items), sha(",".join(sorted(items)).encode()), bool(hit))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"], got[i]["contaminated"]) == want


def test_op10(spark, docs):
    path, pattern = public_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in QUERIES["op10_bpe"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        ids = library.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))


def test_op1(spark, docs):
    private = [r"[\w.+-]+@[\w.-]+\.[a-z]{2,}", r"\b\d{16}\b", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\bAKIA[A-Z0-9]{16}\b", r"(?<=password=)[0-9a-f]+", r"(?<=token = \")[0-9a-f]+"]
    new, changed = {}, 0
    for r in QUERIES["op1_pii"](spark, SF).collect():
        old = docs[r["doc_id"]]
        for p in private:
            for a, b in zip(regex.findall(p, old), regex.findall(p, r["text"]), strict=True):
                if len(a) == 16 and a.isdigit() and luhn(a[:-1]) != int(a[-1]):
                    assert a == b  # no card number
                    continue
                assert a != b and new.setdefault(a, b) == b
                changed += 1
        if not r["n_replaced"]:
            assert r["text"] == old
    assert changed > 20 and len(set(new.values())) == len(new)
