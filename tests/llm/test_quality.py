import itertools
import math
import re
import zlib

import numpy as np
import pytest

from elevata.llm.quality import Field, fit_quality, forward_backward, op8_quality, remainder, score_quality


def test_marginals_against_enumeration():
    rng = np.random.default_rng(5)
    sizes = [1, 4, 2, 6, 1]
    first = np.append(0, np.cumsum(sizes))
    node, step = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    got, pairs = forward_backward(node, step, first)
    total = np.zeros((2, 2))
    for d, n in enumerate(sizes):
        own = node[first[d]: first[d + 1]]
        mass, good, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(own[i] for i in range(n) if y[i]) + sum(step[a, b] for a, b in itertools.pairwise(y)))
            mass += p
            good += p * np.array(y)
            for a, b in itertools.pairwise(y):
                both[a, b] += p
        assert got[first[d]: first[d + 1]] == pytest.approx(good / mass)
        total += both / mass
    assert pairs == pytest.approx(total)


def plain_features(line, before):
    """The features of one line, by loops."""
    n, count = len(line), lambda signs: sum(c in signs for c in line)
    upper, lower, digit = (sum(a <= c <= b for c in line) for a, b in ((65, 90), (97, 122), (48, 57)))
    words = [w.lower() for w in re.findall(rb"[^ \t\x0b\x0c\r]+", line)]
    some, many = max(n, 1), max(len(words), 1)
    sign, pipe, call = count(b"%*&$#@^~=_<>{}[]\\+`/"), count(b"|"), count(b"!")
    shout, odd = upper / max(upper + lower, 1), (sign + pipe) / some
    lag, old = sum(a == b for a, b in itertools.pairwise(words)) / many, (len(words) - len(set(words))) / many
    first, last = line[:1] or b"\0", line[-1:]
    return [float(x) for x in (
        math.log1p(n) / 5, math.log1p(len(words)) / 4, shout, digit / some, count(b" \t\x0b\x0c\r") / some, sum(c >= 128 for c in line) / some, count(b".,;:?") / many,
        10 * sign / some, pipe / many, call / many, lag, old, min(n / many, 40) / 8, last == b".", last == b"!", b"A" <= first <= b"Z", b"a" <= first <= b"z", n == 0, n > 0 and line == before,
        shout > 0.5, odd > 0.03, odd > 0.1, lag > 0.1, lag > 0.4, old > 0.5, old > 0.8, len(words) < 4, pipe > 1, call > 0.2 * many,
    )]


def plain_score(field, text):
    """The score of one text, by loops over its lines."""
    lines = (text or "").encode().split(b"\n")
    x = [plain_features(line, lines[i - 1] if i else None) for i, line in enumerate(lines)]
    none = [0.0] * len(x[0])
    node = []
    for i in range(len(lines)):
        z = x[i] + (x[i - 1] if i else none) + (x[i + 1] if i + 1 < len(x) else none) + [float(i == 0), float(i + 1 == len(x)), 1.0]
        node.append(sum(a * b for a, b in zip(z, field.weights.tolist(), strict=True)))
    psi = [(math.exp(-max(v, 0)), math.exp(v - max(v, 0))) for v in node]
    move = [[math.exp(v) for v in row] for row in field.step.tolist()]
    alpha, beta = [psi[0]], [(1.0, 1.0)]
    for p in psi[1:]:
        a = [sum(alpha[-1][i] * move[i][j] for i in (0, 1)) * p[j] for j in (0, 1)]
        alpha.append(tuple(v / sum(a) for v in a))
    for p in reversed(psi[1:]):
        b = [sum(move[i][j] * p[j] * beta[-1][j] for j in (0, 1)) for i in (0, 1)]
        beta.append(tuple(v / sum(b) for v in b))
    good = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(alpha, reversed(beta), strict=True)]
    raw = sum(g * (len(line) + 1) for g, line in zip(good, lines, strict=True)) / sum(len(line) + 1 for line in lines)
    return 1 / (1 + math.exp(-min(max(field.slope * raw + field.offset, -50), 50)))


def test_whole_table_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    field = fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"), train=remainder("doc_id", 3) != 1)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in op8_quality(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = plain_score(field, text)
        assert got[i]["score"] == pytest.approx(want, abs=1e-6) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.5)


def test_documents_that_repeat_an_id_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}\nline") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert isinstance(fit_quality(docs, labels, max_docs=7), Field)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "a\n\nb", None), (1, "x!! " * 9000, 1.0), (5, "\n", 1.0)], "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (77, 0)], "doc_id long, quality int")
    field = fit_quality(docs, labels)
    out = score_quality(docs, field).collect()
    assert len(out) == 5 and all(0 <= r["quality_score_"] <= 1 for r in out)
    none = fit_quality(docs, labels.limit(0))
    assert isinstance(none, Field) and {r["quality_score_"] for r in score_quality(docs, none).collect()} == {0.5}
    assert score_quality(docs.limit(0), field).count() == 0
