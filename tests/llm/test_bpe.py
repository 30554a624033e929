import hashlib
import random

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from elevata.llm.bpe import Bpe, bpe_encode, decode_ids, load_ranks, public_ranks

PATH, PATTERN = public_ranks()
BPE = Bpe(load_ranks(PATH))
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aben thÉéß1!\n .", max_size=400) | st.text(max_size=200))
def test_tree_equals_library(text):
    import regex

    ids = [i for m in regex.findall(PATTERN, text) for i in BPE.piece(m.encode())]
    assert ids == REFERENCE.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()


def test_long_runs():
    rng = random.Random(1)
    for text in ("a" * 5001, "ab" * 3000, "".join(rng.choice("etaoinh") for _ in range(6000)), "é" * 2500, "=" * 4097, " " * 3001 + "x"):
        import regex

        ids = [i for m in regex.findall(PATTERN, text) for i in BPE.piece(m.encode())]
        assert ids == REFERENCE.encode_ordinary(text)
        assert BPE.decode(ids) == text.encode()


def test_rows(spark):
    rows = [(1, "Hello thé wörld", 5), (2, None, 6), (3, "", 7), (1, "Hello thé wörld", 5), (None, "a\n\n b" * 90000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe_encode(docs, PATH, PATTERN, digests=True).collect()
    assert len(out) == 5
    for r in out:
        want = REFERENCE.encode_ordinary(r["text"] or "")
        assert r["ids"] == want and r["n_tokens_"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert decode_ids(r["ids"], PATH) == (r["text"] or "").encode()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe_encode(docs.limit(0), PATH, PATTERN).count() == 0


def test_digests_decode_through_the_tree(monkeypatch):
    import pyarrow as pa

    import elevata.llm.bpe as bpe

    whole, seen = Bpe.decode, []

    def decode(self, ids):
        seen.append(len(ids))
        return whole(self, ids)

    monkeypatch.setattr(Bpe, "decode", decode)
    monkeypatch.setattr(bpe, "_kept", {})
    text = "A few words, some of them longer than others. " * 20
    (_, n_tokens, _, back), = bpe._coded(PATH, PATTERN, False, True, "t")(iter([pa.record_batch({"id": [1], "t": [text]})]))
    assert back.to_pylist() == [hashlib.sha256(text.encode()).hexdigest()]
    assert max(seen) == n_tokens.to_pylist()[0] > 32 and len(seen) > 1  # by halves
