"""Context-tree weighting over bytes, for the code length of texts.

A text becomes the bytes of its words (A-Z lower-cased), each with a blank
behind it, and an end sign. Each byte is coded as eight binary decisions; a
decision's contexts are the bits before it in the byte together with the last
0, 1, ..., DEPTH bytes. Every context holds a Krichevsky-Trofimov estimate
from its counts; a context of depth d is worth one half of its estimate and
one half of the product of its children, so the prediction for a decision
mixes the estimates of all depths by the weights that training gives them.
Training is counting: the counts of all (context, byte) pairs determine the
tree, whatever the order of the documents.

Distribution: tasks count pairs of their documents and send distinct pairs
only, by the last two bytes of context. All deeper contexts of such a pair of
bytes are in one bucket, which computes its part of the tree from the leaves
up. What lies above, depths 0 and 1, has 65,535 nodes for 256 contexts and
255 for the empty one at most, and is broadcast. Scoring deals the documents
into blocks of a bounded size; a block asks the buckets for the code length of
each distinct pair that it holds, and adds up.

Defined results: a null or empty text is the end sign alone; training on no
document gives one half to every decision; null ids may be scored and are not
trained on; rows that repeat are scored once and give equal rows; an empty
table gives an empty table; columns but the id and the text are left out, and
an id named like an added column keeps its name, the added one getting an
underscore. Words are told apart by 64-bit hashes for the word counts. DEPTH
is bounded by 64-bit keys: five bytes of context, the byte, and 16 bits for the
documents of a piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma, log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, fold_ascii, give_back, mix, n_partitions, span_hashes, spans, trimmed, utf8_column, written

#: Bytes of context. A (context, byte) pair takes 8 * (DEPTH + 1) bits, and 16
#: more number the documents of a piece.
DEPTH = 5
#: Bytes of text that are sorted at a time, and of a block that is scored.
PIECE_BYTES, BLOCK_BYTES = 3 << 19, 5 << 20
#: Distinct pairs that a counting task holds before it sends them.
HELD_PAIRS = 3_000_000
#: Copies of a row that are written out at a time.
COPIES = 10_000
END = 10

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_HALF = log(0.5)


# --- texts to pairs ------------------------------------------------------

def stream(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys ``pair << 16 | document``, bytes per document, word hashes and
    the words' documents. A pair holds the last byte of context highest, and
    the byte itself lowest."""
    folded = fold_ascii(raw)
    starts, ends = spans(~_BLANK[folded], offsets)
    hashes = span_hashes(folded, starts, ends)
    n_docs = len(offsets) - 1
    doc = np.searchsorted(offsets, starts, side="right") - 1 if len(starts) else np.zeros(0, np.int64)
    n_words = np.bincount(doc, minlength=n_docs)
    size = ends - starts
    # DEPTH zero bytes, then each word and its blank, then the end sign.
    width = np.bincount(doc, weights=size + 1, minlength=n_docs).astype(np.int64) + DEPTH + 1
    base = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    if len(starts):
        before = np.cumsum(size + 1) - (size + 1)
        first = np.zeros(n_docs, np.int64)
        filled = n_words > 0
        first[filled] = before[(np.cumsum(n_words) - n_words)[filled]]
        place = base[doc] + DEPTH + before - first[doc]
        # Word bytes keep their order, so both sides are masks; no gathering.
        fill = np.ones(len(out), bool)
        fill[place + size] = False
        fill[base + width - 1] = False
        for i in range(DEPTH):
            fill[base + i] = False
        out[fill] = folded[~_BLANK[folded]]
        out[place + size] = 32
    out[base + width - 1] = END
    key = out[DEPTH:].astype(np.uint64) << np.uint64(16)
    for d in range(1, DEPTH + 1):
        key |= out[DEPTH - d: len(out) - d].astype(np.uint64) << np.uint64(16 + 8 * (DEPTH + 1 - d))
    owner = np.repeat(np.arange(n_docs, dtype=np.uint64), width)
    key |= owner[DEPTH:]
    body = np.ones(len(out), bool)
    body[(base[:, None] + np.arange(DEPTH)).ravel()] = False
    return key[body[DEPTH:]], width - DEPTH, hashes, doc


def _pieces(batches: Iterator, text: str = "text") -> Iterator:
    """Batches of a bounded size with less than 2**16 rows."""
    for batch in chunked(batches, PIECE_BYTES, text):
        for at in range(0, batch.num_rows, 60_000):
            yield batch.slice(at, 60_000)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values, sorted; by one sort, which is faster than a table."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, in as few bytes each as the largest needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    body = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, blob[0])
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, : blob[0]] = body
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _bucket(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs go by the last two bytes of context, words by their hash."""
    of = mix(keys >> np.uint64(8 * (DEPTH - 1))) if kind == 0 else keys
    return (of % np.uint64(buckets)).astype(np.int32)


def _rows(kind: int, block: int, keys: np.ndarray, counts: np.ndarray | None, buckets: int) -> Iterator:
    import pyarrow as pa

    to = _bucket(kind, keys, buckets)
    order = np.argsort(to, kind="stable")
    keys, cuts = keys[order], np.searchsorted(to[order], np.arange(buckets + 1))
    counts = counts[order] if counts is not None else None
    use = np.flatnonzero(np.diff(cuts))
    if len(use):
        slices = [slice(cuts[b], cuts[b + 1]) for b in use]
        yield pa.RecordBatch.from_arrays(
            [pa.array(use, pa.int32()), pa.array([kind] * len(use), pa.int32()), pa.array([block] * len(use), pa.int32()), pa.array([_packed(keys[s]) for s in slices], pa.binary()),
             pa.array([_packed_counts(counts[s]) if counts is not None else b"" for s in slices], pa.binary())],
            names=["bucket", "kind", "block", "keys", "counts"],
        )


def _packed_counts(c: np.ndarray) -> bytes:
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if int(c.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + c.astype(kind).tobytes()


def _unpacked_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


ASKED = "bucket int, kind int, block int, keys binary, counts binary"


# --- the tree ------------------------------------------------------------

_table: list[np.ndarray] = []


def _log_gamma(n: np.ndarray, plus: float) -> np.ndarray:
    """log gamma of whole numbers plus 1/2 or 1."""
    if not _table:
        _table.extend(np.array([lgamma(i + p) for i in range(4096)]) for p in (0.5, 1.0))
    out = _table[0 if plus == 0.5 else 1][np.minimum(n, 4095)]
    big = n >= 4096
    if big.any():
        x = n[big] + plus
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a, 0.5) + _log_gamma(b, 0.5) - 2 * lgamma(0.5) - _log_gamma(a + b, 1.0)


@dataclass
class Nodes:
    """Nodes of one depth and bit: code (context << 8 | bits so far, with a
    one before them), counts of zeros and ones, log weighted probability, and
    the weight of the node's own estimate."""

    code: np.ndarray
    a: np.ndarray
    b: np.ndarray
    lw: np.ndarray
    own: np.ndarray


def _weighted(code, a, b, children: np.ndarray | None) -> Nodes:
    estimate = log_kt(a, b)
    if children is None:
        return Nodes(code, a, b, estimate, np.ones(len(code)))
    lw = _HALF + np.logaddexp(estimate, children)
    return Nodes(code, a, b, lw, np.exp(_HALF + estimate - lw))


def build(pairs: np.ndarray, counts: np.ndarray, upto: int) -> dict[int, list[Nodes]]:
    """Nodes of depths DEPTH down to ``upto`` from sorted pairs."""
    tree: dict[int, list[Nodes]] = {}
    for depth in range(DEPTH, upto - 1, -1):
        if depth < DEPTH:  # drop the byte furthest back
            pairs = (pairs >> np.uint64(16)) << np.uint64(8) | (pairs & np.uint64(255))
            pairs, counts = _summed(pairs, counts)
        byte = (pairs & np.uint64(255)).astype(np.int64)
        tree[depth] = []
        for bit in range(8):
            code = (pairs >> np.uint64(8) << np.uint64(8)) | ((np.uint64(1) << np.uint64(bit)) | (pairs & np.uint64(255)) >> np.uint64(8 - bit))
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
            one = (byte >> (7 - bit)) & 1
            total = np.add.reduceat(counts, first) if len(first) else counts[:0]
            b = np.add.reduceat(counts * one, first) if len(first) else counts[:0]
            code = code[first]
            children = None
            if depth < DEPTH:
                below = tree[depth + 1][bit]
                up = below.code >> np.uint64(16) << np.uint64(8) | (below.code & np.uint64(255))
                children = np.bincount(np.searchsorted(code, up), weights=below.lw, minlength=len(code))
            tree[depth].append(_weighted(code, total - b, b, children))
    return tree


def upper(rows: list[tuple[int, int, int, int, float]]) -> dict[int, list[Nodes]]:
    """Depths 1 and 0 from the sums over depth 2: (last byte, bits, zeros,
    ones, log weighted probability of the children)."""
    tree: dict[int, list[Nodes]] = {1: [], 0: []}
    c, p, a, b, lw = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
    for bit in range(8):
        here = (p >= 1 << bit) & (p < 2 << bit)
        code = (c[here].astype(np.uint64) << np.uint64(8)) | p[here].astype(np.uint64)
        order = np.argsort(code)
        ones = _weighted(code[order], a[here][order].astype(np.int64), b[here][order].astype(np.int64), lw[here][order].astype(float))
        tree[1].append(ones)
        code, which = np.unique(ones.code & np.uint64(255), return_inverse=True)
        add = lambda x: np.bincount(which, weights=x, minlength=len(code))  # noqa: B023, E731
        tree[0].append(_weighted(code, add(ones.a).astype(np.int64), add(ones.b).astype(np.int64), add(ones.lw)))
    return tree


def code_lengths(tree: dict[int, list[Nodes]], pairs: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each pair's byte in its context."""
    out = np.zeros(len(pairs))
    byte = pairs & np.uint64(255)
    for bit in range(8):
        prefix = (np.uint64(1) << np.uint64(bit)) | (byte >> np.uint64(8 - bit))
        one = (byte >> np.uint64(7 - bit)) & np.uint64(1) == 1
        p = np.full(len(pairs), 0.5)
        for depth in range(DEPTH, -1, -1):
            nodes = tree[depth][bit]
            if not len(nodes.code):
                continue
            code = (pairs >> np.uint64(8 * (DEPTH - depth + 1)) << np.uint64(8)) | prefix
            at = np.searchsorted(nodes.code, code)
            at[at == len(nodes.code)] = 0
            known = nodes.code[at] == code
            a, b, own = nodes.a[at], nodes.b[at], nodes.own[at]
            kt = (np.where(one, b, a) + 0.5) / (a + b + 1.0)
            p = np.where(known, own * kt + (1 - own) * p, 0.5)
        out += np.log(p)
    return out


# --- training ------------------------------------------------------------

@dataclass
class Model:
    """The counts of a corpus, by bucket, and what is known to all tasks."""

    counts: DataFrame
    buckets: int
    top: dict[int, list[Nodes]]
    n_docs: int
    n_tokens: int
    n_words: int


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count all documents. The counts are a table in the shared folder."""
    buckets = n_partitions(docs.sparkSession)

    def count(batches: Iterator) -> Iterator:
        held = [[[], []], [[], []]]
        size = 0

        def add(kind, keys):
            keys, n = np.unique(keys, return_counts=True)
            held[kind][0].append(keys)
            held[kind][1].append(n.astype(np.int64))
            return len(keys)

        def merged(kind):
            keys, n = _summed(np.concatenate([np.zeros(0, np.uint64), *held[kind][0]]), np.concatenate([np.zeros(0, np.int64), *held[kind][1]]))
            held[kind][0], held[kind][1] = [keys], [n]
            return len(keys)

        def flush():
            for kind in (0, 1):
                merged(kind)
                yield from _rows(kind, -1, held[kind][0][0], held[kind][1][0], buckets)
                held[kind][0], held[kind][1] = [], []

        for batch in _pieces(batches):
            raw, offsets = utf8_column(batch.column("text"))
            key, _, words, _ = stream(raw, offsets)
            key.sort()
            size += add(0, key >> np.uint64(16)) + add(1, words)
            if size > HELD_PAIRS:
                size = merged(0) + merged(1)
                if size > HELD_PAIRS // 2:
                    yield from flush()
                    size = 0
        yield from flush()

    def merge(batches: Iterator) -> Iterator:
        parts: dict[tuple[int, int], list[list[np.ndarray]]] = {}
        for batch in batches:
            for b, k, x, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "keys", "counts")), strict=True):
                own = parts.setdefault((b, k), [[], []])
                own[0].append(_unpacked(x))
                own[1].append(_unpacked_counts(n))
        for (_, k), (x, n) in parts.items():
            yield from _rows(k, -1, *_summed(np.concatenate(x), np.concatenate(n)), buckets)

    slim = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = written(slim.mapInArrow(trimmed(count), ASKED).repartitionById(buckets, F.col("bucket")).mapInArrow(trimmed(merge), ASKED), "ctw-counts")
    n_docs = slim.count()

    def depth_two(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for x, n in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                for nodes in build(_unpacked(x), _unpacked_counts(n), 2)[2]:
                    # Summed by the last byte here: few rows leave a bucket.
                    code, which = np.unique(nodes.code >> np.uint64(16) << np.uint64(8) | (nodes.code & np.uint64(255)), return_inverse=True)
                    add = lambda v: np.bincount(which, weights=v, minlength=len(code))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array((code >> np.uint64(8)).astype(np.int64)), pa.array((code & np.uint64(255)).astype(np.int64)), pa.array(add(nodes.a).astype(np.int64)), pa.array(add(nodes.b).astype(np.int64)), pa.array(add(nodes.lw))], names=["c", "p", "a", "b", "lw"])

    sums = counts.filter("kind = 0").mapInArrow(trimmed(depth_two), "c long, p long, a long, b long, lw double").groupBy("c", "p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("lw"))
    top = upper([tuple(r) for r in sums.collect()])

    def tally(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = [_unpacked_counts(x) for x in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n], pa.int64()), pa.array([len(x) for x in n], pa.int64())], names=["tokens", "words"])

    tokens, words = counts.filter("kind = 1").mapInArrow(tally, "tokens long, words long").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    return Model(counts, buckets, top, n_docs, tokens + n_docs, words + (n_docs > 0))


# --- scoring -------------------------------------------------------------

def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_tokens`` and ``n_known``
    words with the end, ``base_score`` (log10, single words), ``score``
    (log10, the tree) and ``bits_per_byte``."""
    buckets, top = model.buckets, model.top
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    total = slim.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n_blocks = int(total // BLOCK_BYTES) + 1
    # Rows that repeat are one row with a count: however many there are, a
    # block holds them once. Rows that don't are told by their hashes alone.
    key = F.xxhash64("id", "text")
    again = written(slim.groupBy(key.alias("key")).count().filter(F.col("count") > 1).select("key"), "ctw-repeated")
    one = F.lit(1).cast("long").alias("copies")
    if again.isEmpty():
        slim = slim.select("id", "text", one)
    else:
        keyed = slim.withColumn("key", key)
        many = keyed.join(again, "key", "left_semi").groupBy("id", "text").agg(F.count("*").alias("copies"))
        slim = keyed.join(again, "key", "left_anti").select("id", "text", one).unionByName(many)
    slim = slim.withColumn("block", F.pmod(key, F.lit(n_blocks)).cast("int"))
    n_docs, n_tokens, n_words = model.n_docs, model.n_tokens, model.n_words

    def parts(table):
        """Sorted keys and words of a block, by piece, and distinct ones."""
        own = []
        for batch in _pieces(table.combine_chunks().to_batches()):
            key, size, words, doc = stream(*utf8_column(batch.column("text")))
            key.sort()
            own.append((key, size, words, doc, batch))
        every = lambda x: _distinct(np.concatenate([np.zeros(0, np.uint64), *map(_distinct, x)]))
        return own, every(k >> np.uint64(16) for k, *_ in own), every(w for _, _, w, *_ in own)

    def ask(table):
        import pyarrow as pa

        block = table.column("block")[0].as_py()
        _, pairs, words = parts(table)
        give_back()
        return pa.Table.from_batches([*_rows(0, block, pairs, None, buckets), *_rows(1, block, words, None, buckets)])

    def answer(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, asked = {0: [[], []], 1: [[], []]}, {0: [], 1: []}
        for batch in batches:
            for bucket, kind, block, x, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "block", "keys", "counts")), strict=True):
                if block < 0:
                    known[kind][0].append(_unpacked(x))
                    known[kind][1].append(_unpacked_counts(n))
                else:
                    asked[kind].append((bucket, block, _unpacked(x)))
        for kind in (0, 1):
            if not asked[kind]:
                continue
            keys, counts = _summed(np.concatenate([np.zeros(0, np.uint64), *known[kind][0]]), np.concatenate([np.zeros(0, np.int64), *known[kind][1]]))
            every = _distinct(np.concatenate([x for *_, x in asked[kind]]))
            if kind == 0:
                values = code_lengths({**build(keys, counts, 2), **top}, every)
            else:
                values = np.zeros(len(every))
                if len(keys):
                    at = np.searchsorted(keys, every)
                    at[at == len(keys)] = 0
                    values = np.where(keys[at] == every, counts[at], 0).astype(np.float64)
            for bucket, block, x in asked[kind]:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([values[np.searchsorted(every, x)].tobytes()], pa.binary())], names=["block", "kind", "bucket", "found"])

    schema = T.StructType([slim.schema["id"], *(T.StructField(c, T.LongType()) for c in ("copies", "n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "bits_per_byte"))])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def add_up(table, found):
        import pyarrow as pa

        if not table.num_rows:
            return pa.Table.from_batches([], schema=arrow)
        own, pairs, words = parts(table)
        values = [np.zeros(len(pairs)), np.zeros(len(words))]
        buckets_of = [_bucket(0, pairs, buckets), _bucket(1, words, buckets)]
        for kind, bucket, blob in zip(*(found.column(c).to_pylist() for c in ("kind", "bucket", "found")), strict=True):
            values[kind][buckets_of[kind] == bucket] = np.frombuffer(blob, np.float64)
        least = np.log10((values[1] + 0.1) / (n_tokens + 0.1 * (n_words + 1)))
        end = log((n_docs + 0.1) / (n_tokens + 0.1 * (n_words + 1))) / log(10)
        out = []
        for key, size, word, doc, batch in own:
            n = batch.num_rows
            pair = key >> np.uint64(16)
            new = np.append(True, pair[1:] != pair[:-1])
            value = values[0][np.searchsorted(pairs, pair[new])][np.cumsum(new) - 1]
            nats = np.bincount((key & np.uint64(0xFFFF)).astype(np.int64), weights=value, minlength=n)
            at = np.searchsorted(words, word)
            known = np.bincount(doc, weights=values[1][at] > 0, minlength=n) + (n_docs > 0)
            base = np.bincount(doc, weights=least[at], minlength=n) + end
            out.append(pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("copies"), pa.array(np.bincount(doc, minlength=n) + 1, pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), pa.array(nats / log(10)), pa.array(-nats / log(2) / size)],
                schema=arrow,
            ))
        del own, pairs, words, values, buckets_of
        give_back()
        return pa.Table.from_batches(out, schema=arrow)

    asked = slim.groupBy("block").applyInArrow(ask, ASKED)
    found = asked.union(model.counts).repartitionById(buckets, F.col("bucket")).mapInArrow(trimmed(answer), "block int, kind int, bucket int, found binary")
    scored = slim.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(add_up, schema)
    last = F.col("copies") - 1
    scored = scored.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(last / COPIES))))
    scored = scored.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES, F.least(last, F.col("part") * COPIES + COPIES - 1))))
    added = [F.col(c).alias(c + "_" if c == id_col.lower() else c) for c in schema.fieldNames()[2:]]
    return scored.select(F.col("id").alias(id_col), *added)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is 0 modulo 10 (a null id: true)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(True))


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs.filter(~held_out()))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(int(model.n_tokens)).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
