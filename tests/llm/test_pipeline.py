"""The pipeline against plain Python, and its stages on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_quality import plain_score

from elevata.llm.bpe import load_ranks, public_ranks
from elevata.llm.quality import fit_quality, remainder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = " \t\n\x0b\x0c\r"


def fold(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def without_lines(docs):
    keys = {i: [fold(x.strip(SPACE)) for x in t.split("\n")] for i, t in docs.items()}
    n = Counter(k for ks in keys.values() for k in set(ks) if k)
    return {i: "\n".join(x for x, k in zip(t.split("\n"), keys[i], strict=True) if n[k] < 10) for i, t in docs.items()}


def without_copies(docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall("[^\x20\x09-\x0d]+", fold(t))
        sets[i] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where, root = defaultdict(list), {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: t for i, t in docs.items() if find(i) == i}


def without_benchmark(docs, items):
    word, grams = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), set()
    for t in items:
        w = word.findall(fold(t or ""))
        k = min(10, len(w))
        grams |= {tuple(w[a: a + k]) for a in range(len(w) - k + 1)} if w else set()
    out = {}
    for i, t in docs.items():
        places = [(m.start(), m.end()) for m in word.finditer(fold(t))]
        w = [fold(t)[a:b] for a, b in places]
        hit = set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if tuple(w[a: a + k]) in grams:
                    hit.update(range(a, a + k))
        cut, left, at = "", 0, sorted(hit)
        for a in at:
            if a - 1 not in hit:
                cut += t[left: places[a][0]]
            if a + 1 not in hit:
                left = places[a][1]
        out[i] = cut + t[left:]
    return out


def test_against_plain_python(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: r["text"] or "" for r in frame.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    field = fit_quality(frame, labels, train=remainder("doc_id", 3) != 1)
    good = {i: t for i, t in docs.items() if plain_score(field, t) >= 0.5}
    lines = without_lines(good)
    single = without_copies(lines)
    clean = without_benchmark(single, [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert len(docs) > len(good) > len(single) > 50 and lines != good and clean != single
    path, pattern = public_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == clean.keys()
    for i, t in clean.items():
        ids = library.encode_ordinary(t)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert 0 < docs.count() <= kept


WORDS = "the quick brown fox jumps over the lazy dog while other animals of the forest look on and wonder"
ODD = [
    (1, WORDS, "en", "a", 5), (1, WORDS, "en", "a", 5), (1, WORDS, "de", None, None), (1, "another text with the id one", "en", "a", 1), (None, WORDS, "en", "b", 2), (None, WORDS.upper(), None, None, 3),
    (7, None, None, None, None), (7, None, None, None, None), (8, "", "en", "c", 0), (9, " \n\t", "en", "c", 3), (None, None, None, None, None), (4, "x" * 300_000, "en", "d", 300_000), (5, (WORDS + "\n") * 2000, "en", "d", 1),
    (3, WORDS, "en", "a", 9),
]


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("_key", F.lit(1)).withColumn("component_id", F.lit(2))
    got = sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()), key=repr)
    want = [(1, WORDS, "de", None), (1, "another text with the id one", "en", "a"), (7, None, None, None), (8, "", "en", "c"), (9, " \n\t", "en", "c"), (None, None, None, None), (4, "x" * 300_000, "en", "d"), (5, (WORDS + "\n") * 2000, "en", "d")]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, name, stage):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"n_lines": F.lit(1), "quality_score": F.lit(0.1), "removal_spans": F.lit("x"), "ids": F.lit("y")})
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name == "tokens":
        assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (7, 8)} == {0}
    else:
        assert out.columns == corpus_pipeline.COLUMNS and len(rows) <= len(ODD)
        if name in ("lines", "benchmark"):
            assert len(rows) == len(ODD) and all(r["n_chars"] == len(r["text"] or "") for r in rows)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == out.columns and empty.count() == 0
