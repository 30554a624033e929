"""Byte-level BPE as a monoid: encodings of neighbours join into one.

A piece (one match of the split pattern) is cut into halves down to single
bytes and the encodings are joined up the tree. Two neighbouring encodings
are joined by encoding again the bytes of a window around their border; the
window grows by a token on each side until the tokens outside are stable.

Why that is exact: merges go by rank, then by position. Take tokens that
each encode to themselves and of which every neighbouring pair encodes to
that pair. In the encoding of the whole, consider the first merge to cross a
border between two of them. Until then the merges within that pair were
those of the pair alone, so the pair alone would make the same merge, which
contradicts that it encodes to itself. So no merge crosses any border, and
the sequence is the encoding. Inside each half and inside the window the
pairs hold already; only the two pairs at the window's ends need a check.

Defined results: a null or empty text has no ids; bytes are those of UTF-8;
long texts are handled whole, a bounded number of matches at a time; rows
that repeat give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate, islice

from pyspark.sql import DataFrame, SparkSession

from .common import chunked, free_name, trimmed

#: Pieces, and nodes of the tree, that a task remembers in each of two
#: generations, and the longest piece and node in characters and bytes.
CACHE_PIECES, CACHE_NODES, CACHE_LENGTH, CACHE_BYTES = 300_000, 150_000, 64, 12
#: Matches of a text that are held at a time.
MATCHES = 65_536


class Bpe:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._leaves = {bytes([b]): [ranks[bytes([b])]] for b in range(256)}
        self._nodes = dict(self._leaves)

    def merge(self, data: bytes) -> list[int]:
        """Rank-ordered merging of a short run of bytes, leftmost first."""
        ranks = self.ranks
        parts = [data[i: i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stable(self, left: int, right: int) -> bool:
        """Whether the pair of tokens encodes to itself."""
        pair = left << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) > CACHE_NODES:
                self._pairs.clear()
            known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            self._pairs[pair] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of two encoded byte strings."""
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        tokens, i, j = self.tokens, 1, 1
        while True:
            # The window is itself a growing join: it is encoded afresh.
            window = self._window(b"".join([tokens[t] for t in left[-i:] + right[:j]]))
            lean = i < len(left) and not self.stable(left[-i - 1], window[0])
            rean = j < len(right) and not self.stable(window[-1], right[j])
            if not lean and not rean:
                return left[: len(left) - i] + window + right[j:]
            # A border that is not stable takes in more tokens, doubling so
            # that long unstable runs stay cheap.
            if lean:
                i = min(len(left), 2 * i)
            if rean:
                j = min(len(right), 2 * j)

    def _window(self, data: bytes) -> list[int]:
        """Direct merging with a heap, for windows of any length."""
        if len(data) <= CACHE_BYTES:
            known = self._nodes.get(data)
            return known if known is not None else self._remember(data, self.merge(data))
        return self.merge(data) if len(data) <= 48 else heap_merge(data, self.ranks)

    def _remember(self, data: bytes, ids: list[int]) -> list[int]:
        if len(self._nodes) > CACHE_NODES:
            self._nodes = dict(self._leaves)
        self._nodes[data] = ids
        return ids

    def tree(self, data: bytes) -> list[int]:
        """Encode by halves and join up the tree."""
        known = self._nodes.get(data)
        if known is not None:
            return known
        n = len(data)
        half = n // 2
        out = self.join(self.tree(data[:half]), self.tree(data[half:]))
        return self._remember(data, out) if n <= CACHE_BYTES else out

    def piece(self, data: bytes) -> list[int]:
        """One match of the pattern: a vocabulary entry is its own token."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tree(data) if data else []

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree of halves."""
        if len(ids) <= 32:
            return b"".join([self.tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def heap_merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Rank-ordered merging in n log n, on a linked list of parts."""
    import heapq

    n = len(data)
    end = list(range(1, n + 1))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            r = ranks.get(data[i: end[j]])
            if r is not None:
                heap.append((r, i, end[j])) if not ready else heapq.heappush(heap, (r, i, end[j]))

    ready = False
    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = after[i]
        if j >= n or end[j] != to:
            continue
        alive[j] = False
        end[i] = end[j]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i: end[i]]])
        i = after[i]
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def matches(text: str, pattern) -> Iterator[list[str]]:
    """All matches of a text, a bounded number at a time."""
    if len(text) < 4 * MATCHES:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while block := list(islice(found, MATCHES)):
        yield block


class _Pieces(dict):
    """Packed ids of pieces, encoded when first asked for; a bounded number
    is kept, those asked for lately."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.old = bpe, {}
        n = max(bpe.tokens) + 1
        self.shown = [str(i) for i in range(n)]

    def __missing__(self, piece: str) -> bytes:
        row = self.old.get(piece)
        if row is None:
            row = array("i", self.bpe.piece(piece.encode())).tobytes()
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = row
        return row


#: Kept between the tasks of a Python worker, by path of the ranks.
_kept: dict[str, _Pieces] = {}


def _pieces(ranks_path: str) -> _Pieces:
    if ranks_path not in _kept:
        _kept.clear()
        _kept[ranks_path] = _Pieces(Bpe(load_ranks(ranks_path)))
    return _kept[ranks_path]


def _coded(ranks_path: str, pattern: str, keep_ids: bool, digests: bool, text: str) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        split = regex.compile(pattern)
        pieces = _pieces(ranks_path)

        packed_of, shown, decode = pieces.__getitem__, pieces.shown.__getitem__, pieces.bpe.decode

        def encode(text: str):
            n, packed, sha, back = 0, [], hashlib.sha256(), hashlib.sha256()
            for block in matches(text, split):
                data = b"".join(map(packed_of, block))
                if digests and data:
                    ids = array("i", data).tolist()
                    joined = ",".join(map(shown, ids))
                    sha.update(("," + joined if n else joined).encode())
                    back.update(decode(ids))
                n += len(data) // 4
                if keep_ids:
                    packed.append(data)
            return n, b"".join(packed), sha.hexdigest(), back.hexdigest()

        for batch in chunked(batches, 4 << 20, text):
            coded = [encode(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)] + [pa.array([c[0] for c in coded], pa.int64())]
            if keep_ids:
                ends = pa.array(accumulate((c[0] for c in coded), initial=0), pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join([c[1] for c in coded]))])))
            if digests:
                columns += [pa.array([c[2] for c in coded]), pa.array([c[3] for c in coded])]
            yield columns

    return run


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep_ids: bool = True, digests: bool = False) -> DataFrame:
    """``docs`` plus ``n_tokens``, and ``ids`` and/or SHA-256 digests of the
    ids (decimal, comma-joined) and of the bytes decoded from them.

    Added names get underscores where they clash with a column of ``docs``.
    ``ranks_path`` must be readable at the same path on every executor.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    extra = [("n_tokens", T.LongType())]
    extra += [("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    extra += [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digests else []
    taken = free_name(docs, "_bpe_text")
    schema = T.StructType([*docs.schema.fields, *(T.StructField(free_name(docs, n), t) for n, t in extra)])
    code = _coded(ranks_path, pattern, keep_ids, digests, taken)
    names = schema.fieldNames()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for columns in code(batches):
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

    return docs.withColumn(taken, F.col(text_col)).mapInArrow(trimmed(run), schema)


def decode_ids(ids: list[int], ranks_path: str) -> bytes:
    """The bytes of a list of ids."""
    return Bpe(load_ranks(ranks_path)).decode(list(ids))


def public_ranks() -> tuple[str, str]:
    """Path of the ranks and the split pattern of the installed vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path, pattern = public_ranks()
    return bpe_encode(docs, path, pattern, keep_ids=False, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
