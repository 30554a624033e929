import hashlib
import time
from collections import Counter

import duckdb
import pyarrow as pa

from elevata.llm.line_dedup import OP9_SQL, line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(texts, least):
    lines = [(t or "").split("\n") for t in texts]
    n = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    return [(len(ls), sum(n[key(x)] >= least for x in ls), "\n".join(x for x in ls if n[key(x)] < least)) for ls in lines]


def test_against_brute_force(spark):
    texts = ["Hot\na\nhot ", "  HOT\t\n\nb", None, "", "b\nc\nHot", "é\nÉ\n\n\n", "HOT", "x" * 50000 + "\nhot", "HOT", "HOT"]
    ids = [1, 2, 3, 4, 5, 6, None, 8, 9, 9]
    docs = spark.createDataFrame(list(zip(ids, texts, range(10), strict=True)), "doc_id long, text string, n_lines int")
    for least in (2, 4, 100):
        got = {r["n_lines"]: (r["n_lines_"], r["n_dropped"], r["text"]) for r in line_dedup(docs, min_docs=least).collect()}
        assert [got[i] for i in range(10)] == brute(texts, least)
    assert line_dedup(docs.limit(0)).count() == 0


def test_light_and_heavy_keys(spark):
    texts = [f"line {i // 3}\nonly {i}\nhot" for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup(docs, min_docs=3).collect()}
    assert [got[i] for i in range(3000)] == brute(texts, 3)


def test_repeated_rows_count_as_documents_of_their_own(spark):
    """In the operator, in its SQL, and by brute force."""
    rows = [(1, "again\nown 1")] * 4 + [(2, None), (2, "again\nAGAIN")] + [(None, "again\n\nx")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((repr(i), n, gone, kept) for (i, _), (n, gone, kept) in zip(rows, brute([t for _, t in rows], 10), strict=True))
    assert sorted((repr(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup(docs).collect()) == want
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())}))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((repr(i), n, gone, kept) for i, n, gone, kept in con.execute(OP9_SQL).fetchall()) == [(i, n, gone, sha(t)) for i, n, gone, t in want]


def test_many_dropped_lines_take_linear_time(spark):
    def seconds(n):
        text = "\n".join(f"{'hot' if i % 2 else 'own'} {i}" for i in range(n))
        docs = spark.createDataFrame([(i, text.replace("own", f"own{i}")) for i in range(12)], "doc_id long, text string")
        began = time.perf_counter()
        assert {r["n_dropped"] for r in line_dedup(docs).collect()} == {n // 2}
        return time.perf_counter() - began

    seconds(500)
    assert seconds(32_000) < 8 * seconds(8_000) + 5
