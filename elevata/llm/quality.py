"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad. A line's potentials come from features of
the line and of its two neighbours, and from the labels of neighbouring
lines. Training lines take the label of their document at first; then lines
of bad documents that the model finds good by themselves are freed, and the
field is fitted again. A document's quality is the length-weighted mean of
the forward-backward marginals of its lines, brought to a probability by a
logistic fit on the training documents.

The field is fitted on a bounded sample of labelled rows (``MAX_DOCS``, those
with the smallest hash of the id, documents of up to ``MAX_LINES`` lines); all
rows are scored, over whole texts.

Defined results: a null or empty text is one empty line and gets a score; a
null label is no label; a document with several labels counts once for each;
documents that share an id all count, within the bound;
without any label of one of the two kinds every score is 0.5; rows that
repeat give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, fold_ascii, free_name, mix, span_hashes, spans, trimmed, utf8_column

#: The bounded training sample.
MAX_DOCS, MAX_LINES = 6000, 200
#: Bytes of text that are scored at a time.
BLOCK_BYTES = 2 << 20


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _class(bytes(range(65, 91)))
_LOWER = _class(bytes(range(97, 123)))
_DIGIT = _class(bytes(range(48, 58)))
_BLANK = _class(b" \t\x0b\x0c\r")
_WIDE = _class(bytes(range(128, 256)))
_STOPS = _class(b".,;:?")
_SIGNS = _class(b"%*&$#@^~=_<>{}[]\\+`/")
_PIPE = _class(b"|")
_CALL = _class(b"!")
_CLASSES = (_UPPER, _LOWER, _DIGIT, _BLANK, _WIDE, _STOPS, _SIGNS, _PIPE, _CALL)


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, the first line of each document (and the
    number of lines last), and the lines' lengths in bytes."""
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    # A line starts at each document and after each break.
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    owner = np.searchsorted(breaks, offsets[:-1]) + np.arange(n_docs)
    first = np.append(owner, len(starts))
    ends = np.empty(len(starts), np.int64)
    is_last = np.zeros(len(starts), bool)
    is_last[first[1:] - 1] = True
    ends[is_last] = offsets[1:]
    ends[~is_last] = breaks
    length = ends - starts

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return (total[ends] - total[starts]).astype(np.float64)

    upper, lower, digit, blank, wide, stop, sign, pipe, call = (count(c[raw]) for c in _CLASSES)
    word_at, word_to = spans(~_BLANK[raw] & (raw != 10), offsets)
    hashes = span_hashes(fold_ascii(raw), word_at, word_to)
    line = np.searchsorted(starts, word_at, side="right") - 1
    n_words = np.bincount(line, minlength=len(starts)).astype(np.float64)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[again], minlength=len(starts))
    # Words of a line that the same line has before.
    key = mix(hashes + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = np.zeros(len(key), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    seen = np.bincount(line[order[same]], minlength=len(starts))
    whole = span_hashes(raw, starts, ends)
    twin = np.zeros(len(starts))
    twin[1:] = (whole[1:] == whole[:-1]) & (length[1:] > 0)
    twin[first[:-1]] = 0

    some, words = np.maximum(length, 1), np.maximum(n_words, 1)
    letters = np.maximum(upper + lower, 1)
    full = length > 0
    if len(raw):
        last_byte = np.where(full, raw[np.maximum(ends, 1) - 1], 0)
        first_byte = np.where(full, raw[np.minimum(starts, len(raw) - 1)], 0)
    else:
        last_byte = first_byte = np.zeros(len(starts), np.uint8)
    shout, odd, lag, old = upper / letters, (sign + pipe) / some, repeats / words, seen / words
    table = [
        np.log1p(length) / 5, np.log1p(n_words) / 4, shout, digit / some, blank / some, wide / some, stop / words,
        10 * sign / some, pipe / words, call / words, lag, old, np.minimum(length / words, 40) / 8,
        last_byte == 46, last_byte == 33, _UPPER[first_byte], _LOWER[first_byte], ~full, twin,
        shout > 0.5, odd > 0.03, odd > 0.1, lag > 0.1, lag > 0.4, old > 0.5, old > 0.8, n_words < 4, pipe > 1, call > 0.2 * words,
    ]
    return np.stack([np.asarray(x, np.float64) for x in table], axis=1), first, length


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of its neighbours, ends, and a constant."""
    n = len(x)
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[head], after[tail] = 0, 0
    return np.concatenate([x, before, after, head[:, None], tail[:, None], np.ones((n, 1))], axis=1)


def forward_backward(node: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" per line, and expected label pairs over all.

    ``node``: log potential of good over bad; ``step``: 2 x 2 log potentials.
    All documents advance together, the longest first.
    """
    n_lines = np.diff(first)
    by = np.argsort(-n_lines, kind="stable")
    begin, count = first[:-1][by], n_lines[by]
    longest = int(count[0]) if len(count) else 0
    live = np.searchsorted(-count, -np.arange(longest), side="left")
    move = np.exp(step - step.max())
    top = np.minimum(np.maximum(node, 0), 700)
    psi = np.exp(np.stack([-top, np.clip(node, -700, 700) - top], axis=1))
    alpha = np.empty((len(node), 2))
    beta = np.empty((len(node), 2))
    state = None
    for t in range(longest):
        at = begin[: live[t]] + t
        state = psi[at] if t == 0 else (state[: live[t]] @ move) * psi[at]
        state /= state.sum(axis=1, keepdims=True)
        alpha[at] = state
    state = np.ones((0, 2))
    for t in range(longest - 1, -1, -1):
        at = begin[: live[t]] + t
        if len(state):
            nxt = begin[: len(state)] + t + 1
            state = (psi[nxt] * state) @ move.T
            state /= state.sum(axis=1, keepdims=True)
        if len(state) < live[t]:
            state = np.concatenate([state, np.ones((live[t] - len(state), 2))])
        beta[at] = state
    both = alpha * beta
    marginal = both[:, 1] / both.sum(axis=1)
    inner = np.ones(len(node), bool)
    inner[first[:-1]] = False
    here = np.flatnonzero(inner)
    pairs = alpha[here - 1][:, :, None] * move[None] * (psi[here] * beta[here])[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return marginal, pairs.sum(axis=0)


@dataclass
class Field:
    """A fitted field with the logistic on top."""

    weights: np.ndarray
    step: np.ndarray
    slope: float
    offset: float

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return forward_backward(with_neighbours(x, first) @ self.weights, self.step, first)[0]

    def raw_scores(self, x: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        good = self.marginals(x, first)
        weight = length + 1.0
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def scores(self, x: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw_scores(x, first, length) + self.offset, -50, 50)))


def _fit_field(z: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the line labels, by Adam on the exact gradient."""
    w, step = np.zeros(z.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    here = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[here - 1], y[here]), 1)
    n = len(y)
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, steps + 1):
        p, pairs = forward_backward(z @ w, step, first)
        g = np.concatenate([z.T @ (y - p) / n - decay * w, ((seen - pairs) / n - decay * step).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        change = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, step = w + change[:-4], step + change[-4:].reshape(2, 2)
    return w, step


def fit_lines(x: np.ndarray, first: np.ndarray, length: np.ndarray, quality: np.ndarray, steps: int = 120) -> Field:
    """Fit on lines ``x`` of documents with labels ``quality``."""
    quality = quality.astype(np.int64)
    if len(quality) == 0 or quality.min() == quality.max():
        return Field(np.zeros(3 * x.shape[1] + 3), np.zeros((2, 2)), 0.0, 0.0)
    z = with_neighbours(x, first)
    doc = np.repeat(np.arange(len(quality)), np.diff(first))
    y = quality[doc]
    w, step = _fit_field(z, first, y, steps, 1e-4)
    # Lines of bad documents that look good by themselves are freed; the
    # worst line of each stays bad.
    alone = z @ w
    worst = np.minimum.reduceat(alone, first[:-1])
    y = np.where((y == 0) & (alone > 1) & (alone > worst[doc]), 1, y)
    w, step = _fit_field(z, first, y, steps, 1e-4)
    field = Field(w, step, 1.0, 0.0)
    s = field.raw_scores(x, first, length)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method for two weights
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -50, 50)))
        g = np.array([((quality - p) * s).sum() - 1e-2 * a, (quality - p).sum()])
        r = p * (1 - p) + 1e-9
        h = np.array([[(r * s * s).sum() + 1e-2, (r * s).sum()], [(r * s).sum(), r.sum() + 1e-6]])
        change = np.linalg.solve(h, g)
        a, b = a + change[0], b + change[1]
        if np.abs(change).max() < 1e-9:
            break
    return Field(w, step, float(a), float(b))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train: Column | None = None, max_docs: int = MAX_DOCS) -> Field:
    """Fit on at most ``max_docs`` labelled rows for which ``train`` holds."""
    rows = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("q")).filter(F.col("i").isNotNull() & F.col("q").isin(0, 1))
    if train is not None:
        rows = rows.withColumnRenamed("i", id_col).filter(train).withColumnRenamed(id_col, "i")
    sample = rows.orderBy(F.xxhash64("i"), "i", "q").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def lines(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunked(batches, BLOCK_BYTES, "t"):
            raw, offsets = utf8_column(batch.column("t"))
            x, first, length = line_features(raw, offsets)
            n = np.diff(first)
            use = np.flatnonzero(n <= MAX_LINES)
            yield pa.RecordBatch.from_arrays(
                [batch.column("i").take(pa.array(use)), batch.column("q").take(pa.array(use)),
                 pa.array([x[first[d]: first[d + 1]].astype(np.float32).tobytes() for d in use], pa.binary()),
                 pa.array([length[first[d]: first[d + 1]].tobytes() for d in use], pa.binary())],
                names=["i", "q", "x", "n"],
            )

    found = texts.join(F.broadcast(sample), "i").select("i", "q", "t").mapInArrow(trimmed(lines), T.StructType([texts.schema["i"], T.StructField("q", T.IntegerType()), T.StructField("x", T.BinaryType()), T.StructField("n", T.BinaryType())]))
    # Of documents that repeat a sampled id, too, no more than the bound come back.
    found = found.orderBy(F.xxhash64("i"), "i", "q", F.xxhash64("x", "n")).limit(max_docs)
    got = sorted(((r["i"], r["q"], bytes(r["x"]), bytes(r["n"])) for r in found.collect()))
    length = [np.frombuffer(r[3], np.int64) for r in got]
    first = np.append(0, np.cumsum([len(x) for x in length])).astype(np.int64)
    width = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1]
    x = np.frombuffer(b"".join(r[2] for r in got), np.float32).astype(np.float64).reshape(-1, width)
    return fit_lines(x, first, np.concatenate([np.zeros(0, np.int64), *length]), np.array([r[1] for r in got], np.int64))


def score_quality(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``quality_score`` (0 to 1, higher is better); the name
    gets underscores where it clashes."""
    name = free_name(docs, "quality_score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    names = schema.fieldNames()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunked(batches, BLOCK_BYTES, text_col):
            x, first, length = line_features(*utf8_column(batch.column(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(field.scores(x, first, length))], names=names)

    return docs.mapInArrow(trimmed(run), schema)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by`` (a null id: null)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(by))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    field = fit_quality(docs, labels, train=remainder("doc_id", 3) != 1)
    scored = score_quality(docs, field)
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
