import numpy as np
import pytest

from elevata.llm import common
from elevata.llm.ctw import fit, score
from elevata.llm.decontaminate import decontaminate
from elevata.llm.ngram_join import ngram_groups


def thue_morse(n):
    """Two different words on which polynomial hashes modulo 2**64 collide."""
    a = "t"
    for _ in range(n):
        a += a.translate(str.maketrans("tk", "kt"))
    return a, a.translate(str.maketrans("tk", "kt"))


def test_span_hashes_are_equal_for_equal_bytes_only():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 20_000).astype(np.uint8)
    starts = rng.integers(0, 20_000, 6000)
    ends = np.minimum(starts + rng.integers(0, 20, 6000), 20_000)
    spans = [raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    hashes = common.span_hashes(raw, starts, ends).tolist()
    assert len(set(zip(spans, hashes, strict=True))) == len(set(spans)) == len(set(hashes))
    long = np.concatenate([raw, raw])
    twice = common.span_hashes(long, np.array([5, 20_005, 6]), np.array([3000, 23_000, 3001]))
    assert twice[0] == twice[1] != twice[2]


@pytest.mark.parametrize("width", [1, 7, 8, 9, 100, 400])
def test_token_hashes(width):
    raw = np.random.default_rng(1).integers(97, 99, 70_000).astype(np.uint8)
    raw[40_000:41_000] = raw[100:1100]
    got = common.token_hashes(raw, width).tolist()
    known = {}
    for i, h in enumerate(got):
        assert known.setdefault(raw[i: i + width].tobytes(), h) == h
    assert len(got) == 70_000 - width + 1 and len(set(got)) == len(known)
    assert not len(common.token_hashes(raw[:3], 4))


@pytest.mark.parametrize("n", [8, 10, 12])
def test_words_of_structure_stay_apart(spark, n):
    a, b = thue_morse(n)
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{b} one two three four five six seven eight nine")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_groups(docs.limit(2)).collect()} == {1: 1, 2: 2}
    items = spark.createDataFrame([("x", a), ("y", b)], "item_id string, text string")
    assert {r["doc_id"]: r["items"] for r in decontaminate(docs, items).collect()} == {1: ["x"], 2: ["y"], 3: ["y"]}
    model = fit(docs.filter("doc_id = 1"))
    assert {r["doc_id"]: r["n_known"] for r in score(docs, model).collect()} == {1: 2, 2: 1, 3: 1}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        _conf = Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
