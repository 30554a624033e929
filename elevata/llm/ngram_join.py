"""N-gram Jaccard join by token-combination prefixes.

Documents are sets of distinct word shingles; documents with equal sets are
one class. All tokens (shingles) are counted over all classes and ordered by
(count, hash). Two sets with Jaccard similarity of at least s share at least
s * n tokens (n: the size of either), so tokens that occur once bound what a
class can link with, and classes below s * n shared tokens link with nothing.

For the rest, the first n - ceil(s * n) + l tokens of two linked sets share at
least l tokens. Tokens in at least FREQUENT classes are frequent and dealt
into g groups; with l = g + 1 two linked prefixes share a rare token, or two
frequent ones of one group. So rare tokens are indexed one by one, frequent
ones by the pairs within a group. g grows with the set size, so that pairs
stay in proportion to it; it must be the same for both sets, so each set is
indexed for its size band and the next one (linked sizes differ by a band at
most).

Classes that share an index entry are connected into candidate groups, which
are dealt out in chunks of a bounded number of tokens. A chunk's pairs are
verified by exact overlaps. Groups of several chunks are first linked within
chunks and to a few classes of the group; then every pair of classes that are
not connected yet is verified, chunk against chunk.

Defined results: fewer words than ``k`` make one shingle of all; a text
without words (null, empty, blank) has none and links with nothing; rows that
repeat are linked with each other (equal sets); rows with one id are one
document; null ids are linked and ignored as representatives; an empty table
gives an empty table; columns but the id and the text are left out, and an id
named like an added column gets no clash, as the added name has underscores
then. Words, shingles and sets are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, fold_ascii, mix, n_partitions, span_hashes, spans, trimmed, utf8_column, window_hashes, written
from .components import components

#: A token in at least so many classes is frequent.
FREQUENT = 16
#: Tokens in a chunk of a candidate group, on average; and classes of a large
#: group against which all its chunks are linked first.
CHUNK_TOKENS, PIVOTS = 150_000, 8
#: Bytes of text whose shingles are taken at a time; rows of a batch of sets.
BLOCK_BYTES, BATCH_ROWS = 4 << 20, 4096

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and bounds."""
    folded = fold_ascii(raw)
    starts, ends = spans(~_BLANK[folded], offsets)
    words = span_hashes(folded, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    n_docs, n_words = len(offsets) - 1, np.diff(bounds)
    every = window_hashes(words, k)
    doc = np.repeat(np.arange(n_docs), n_words)
    inside = np.arange(len(every)) + k <= bounds[doc[: len(every)] + 1]
    token, owner = every[inside], doc[: len(every)][inside]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        token = np.concatenate([token, [window_hashes(words[bounds[d]: bounds[d + 1]], int(n_words[d]))[0] for d in short]])
        owner = np.concatenate([owner, short])
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    return token, np.searchsorted(owner, np.arange(n_docs + 1))


def set_classes(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each document's set (0: no shingles)."""
    total = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(mix(token ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    n = np.diff(bounds)
    out = mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64))
    out[n == 0] = 0
    return out


def _longs(x: np.ndarray):
    import pyarrow as pa

    return pa.array(x.view(np.int64), pa.int64())


def _blob(x: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, in six bytes where they fit."""
    if not len(x):
        return b""
    steps = np.diff(x, prepend=x[:1])
    width = 6 if not len(steps) or int(steps.max()) < 1 << 48 else 8
    return bytes([width]) + x[:1].tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unblob(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    width = b[0]
    body = np.frombuffer(b, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(body), 8), np.uint8)
    steps[:, :width] = body
    steps = steps.view("<u8").ravel().copy()
    steps[0] = np.frombuffer(b, np.uint64, 1, 1)[0]
    return np.cumsum(steps, dtype=np.uint64)


def _documents(docs: DataFrame, k: int) -> DataFrame:
    """Each row's class and the size of its set."""
    schema = T.StructType([docs.schema["id"], T.StructField("cls", T.LongType()), T.StructField("n_shingles", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunked(batches, BLOCK_BYTES):
            token, bounds = shingle_sets(*utf8_column(batch.column("text")), k)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _longs(set_classes(token, bounds)), pa.array(np.diff(bounds), pa.int64())], names=schema.fieldNames())

    return docs.select("id", "text").mapInArrow(trimmed(run), schema)


def _dealt_tokens(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """All tokens of all classes by ranges of the token hash, packed."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        edges = np.array([i * (1 << 64) // buckets for i in range(1, buckets)], np.uint64)
        for batch in chunked(batches, BLOCK_BYTES):
            token, bounds = shingle_sets(*utf8_column(batch.column("text")), k)
            n = np.diff(bounds)
            cls, first = np.unique(set_classes(token, bounds), return_index=True)
            cls, first = cls[n[first] > 0], first[n[first] > 0]
            at = np.concatenate([np.zeros(0, np.int64), *(np.arange(bounds[d], bounds[d + 1]) for d in first)]).astype(np.int64)
            own = np.repeat(np.arange(len(first)), n[first]).astype(np.uint32)
            order = np.argsort(token[at])
            token, own = token[at][order], own[order]
            if len(first) <= 0xFFFF:
                own = own.astype(np.uint16)
            cuts = np.concatenate([[0], np.searchsorted(token, edges), [len(token)]])
            use = np.flatnonzero(np.diff(cuts))
            # The blob of classes names those of this bucket only.
            tokens, owners, names = [], [], []
            for b in use:
                some, local = np.unique(own[cuts[b]: cuts[b + 1]], return_inverse=True)
                tokens.append(_blob(token[cuts[b]: cuts[b + 1]]))
                owners.append(local.astype(own.dtype).tobytes())
                names.append(cls[some].tobytes())
                if 8 * len(some) + own.itemsize * len(local) > 8 * len(local):  # shorter without numbers
                    owners[-1], names[-1] = b"", cls[own[cuts[b]: cuts[b + 1]]].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array(tokens, pa.binary()), pa.array(owners, pa.binary()), pa.array(names, pa.binary())], names=["bucket", "tokens", "owners", "names"])

    return docs.select("text").mapInArrow(trimmed(run), "bucket int, tokens binary, owners binary, names binary")


def _shared_tokens(dealt: DataFrame, buckets: int) -> DataFrame:
    """Tokens in at least two classes, with counts, dealt out by class."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        token, cls = [], []
        for batch in batches:
            for t, o, m in zip(*(batch.column(c).to_pylist() for c in ("tokens", "owners", "names")), strict=True):
                token.append(_unblob(t))
                cls.append(np.frombuffer(m, np.uint64))
                if o:
                    cls[-1] = cls[-1][np.frombuffer(o, np.uint16 if len(o) == 2 * len(token[-1]) else np.uint32)]
        if not token:
            return
        token, cls = np.concatenate(token), np.concatenate(cls)
        order = np.argsort(token)
        sorted_token = token[order]
        twice = np.zeros(len(order), bool)
        twice[1:] = sorted_token[1:] == sorted_token[:-1]
        twice[:-1] |= twice[1:].copy()
        order = order[twice]
        token, cls = token[order], cls[order]
        order = np.lexsort((cls, token))
        token, cls = token[order], cls[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls = token[new], cls[new]
        start = np.ones(len(token), bool)
        start[1:] = token[1:] != token[:-1]
        counts = np.diff(np.append(np.flatnonzero(start), len(token)))
        count = np.repeat(counts, counts).astype(np.uint32)
        keep = count > 1
        token, cls, count = token[keep], cls[keep], count[keep]
        to = cls % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        token, cls, count, to = token[order], cls[order], count[order], to[order]
        cuts = np.searchsorted(to, np.arange(buckets + 1).astype(np.uint64))
        use = np.flatnonzero(np.diff(cuts))
        each = lambda x: pa.array([x[cuts[b]: cuts[b + 1]].tobytes() for b in use], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), each(token), each(cls), each(count)], names=["bucket", "tokens", "classes", "counts"])

    return dealt.mapInArrow(trimmed(run), "bucket int, tokens binary, classes binary, counts binary")


def _dealt_sizes(rows: DataFrame, buckets: int) -> DataFrame:
    """Classes and set sizes, dealt out by class like shared tokens."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cls, first = np.unique(batch.column("cls").to_numpy().view(np.uint64), return_index=True)
            size = batch.column("n_shingles").to_numpy()[first].astype(np.uint64)
            cls, size = cls[size > 0], size[size > 0]
            to = cls % np.uint64(buckets)
            each = [(b, to == b) for b in np.unique(to)]
            yield pa.RecordBatch.from_arrays([pa.array([int(b) for b, _ in each], pa.int32()), pa.array([size[m].tobytes() for _, m in each], pa.binary()), pa.array([cls[m].tobytes() for _, m in each], pa.binary()), pa.array([b""] * len(each), pa.binary())], names=["bucket", "tokens", "classes", "counts"])

    return rows.select("cls", "n_shingles").mapInArrow(trimmed(run), "bucket int, tokens binary, classes binary, counts binary")


def _candidates(shared: DataFrame, percent: int) -> DataFrame:
    """Classes of which enough tokens are shared: those tokens by (count, hash)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts: list[list[np.ndarray]] = [[], [], []]
        known: list[list[np.ndarray]] = [[], []]
        for batch in batches:
            for t, c, n in zip(*(batch.column(c).to_pylist() for c in ("tokens", "classes", "counts")), strict=True):
                for part, x, kind in zip(parts if n else known, (t, c, n), (np.uint64, np.uint64, np.uint32), strict=False):
                    part.append(np.frombuffer(x, kind))
        if not parts[0]:
            return
        token, cls, count = (np.concatenate(p) for p in parts)
        size, named = (np.concatenate(p) for p in known)
        named, first = np.unique(named, return_index=True)
        size = size[first].astype(np.int64)
        order = np.lexsort((token, count, cls))
        token, cls, count = token[order], cls[order], count[order]
        cuts = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        ends = np.append(cuts[1:], len(cls))
        n = size[np.searchsorted(named, cls[cuts])]
        enough = 100 * (ends - cuts) >= percent * n
        cuts, ends, n = cuts[enough], ends[enough], n[enough]
        rare = np.concatenate([[0], np.cumsum(count < FREQUENT)])
        blobs = [token[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
        for at in range(0, len(cuts), BATCH_ROWS):
            part = slice(at, at + BATCH_ROWS)
            yield pa.RecordBatch.from_arrays(
                [_longs(cls[cuts[part]]), pa.array(n[part], pa.int64()), pa.array(blobs[part], pa.binary()), pa.array(rare[ends[part]] - rare[cuts[part]], pa.int64())],
                names=["cls", "n", "tokens", "n_rare"],
            )

    return shared.mapInArrow(trimmed(run), "cls long, n long, tokens binary, n_rare long")


def signatures(n: int, tokens: np.ndarray, n_rare: int, percent: int) -> np.ndarray:
    """Index entries of a set of size ``n``: ``tokens`` are those that occur
    elsewhere, by (count, hash), the first ``n_rare`` of them rare."""
    alone = n - len(tokens)
    least = -(-percent * n // 100)
    first = n - least + 1 - alone
    if first <= n_rare:  # the shortest prefix has rare tokens only
        return mix(tokens[: max(0, first)])
    ratio = 100 / percent
    band = int(np.floor(np.log(n) / np.log(ratio)))
    out = [tokens[:0]]
    reach = 0
    for tag in (band, band + 1):
        groups = max(1, int(np.ceil(0.25 * (1 - percent / 100) * ratio ** (tag + 1))))
        prefix = min(len(tokens), first + groups)
        reach = max(reach, min(prefix, n_rare))
        frequent = tokens[n_rare: prefix]
        group = frequent % np.uint64(groups)
        order = np.lexsort((frequent, group))
        frequent, group = frequent[order], group[order]
        for step in range(1, len(frequent)):
            same = group[step:] == group[:-step]
            if not same.any():
                break
            x, y = frequent[:-step][same], frequent[step:][same]
            out.append(mix(mix(x + np.uint64(tag)) + y))
    return np.concatenate([mix(tokens[:reach]), *out])


def _index(candidates: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunked(batches, BLOCK_BYTES, "tokens"):
            each = [signatures(n, np.frombuffer(t, np.uint64), r, percent) for n, t, r in zip(*(batch.column(x).to_pylist() for x in ("n", "tokens", "n_rare")), strict=True)]
            cls = np.repeat(batch.column("cls").to_numpy(), [len(s) for s in each])
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate(each)), pa.array(cls, pa.int64())], names=["sig", "cls"])

    return candidates.select("cls", "n", "tokens", "n_rare").mapInArrow(trimmed(run), "sig long, cls long")


def linked(tokens: list[np.ndarray], n: np.ndarray, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different ``comp``.

    Overlaps of a set with all others come from its tokens' posting lists.
    Sets that the links so far connect are not linked again.
    """
    m = len(tokens)
    owner = np.repeat(np.arange(m), [len(t) for t in tokens])
    _, token = np.unique(np.concatenate(tokens), return_inverse=True)
    order = np.argsort(token, kind="stable")
    posting = owner[order]
    at = np.searchsorted(token[order], np.arange(int(token.max()) + 2 if len(token) else 1))
    first = np.searchsorted(owner, np.arange(m + 1))
    label = np.unique(comp, return_inverse=True)[1]
    out = []
    for u in range(m):
        if (label == label[u]).all():
            break
        own = token[first[u]: first[u + 1]]
        begin, count = at[own], at[own + 1] - at[own]
        rows = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        overlap = np.bincount(posting[rows], minlength=m)
        near = np.flatnonzero((100 * overlap >= percent * (n + n[u] - overlap)) & (overlap > 0) & (label != label[u]))
        for v in near:
            if label[v] != label[u]:
                out.append((u, int(v)))
                label[label == label[v]] = label[u]
    return out


def _verify(rows: DataFrame, percent: int) -> DataFrame:
    """Verified edges between the classes of each chunk."""
    def run(table):
        import pyarrow as pa

        cls = table.column("cls").to_numpy()
        _, once = np.unique(cls, return_index=True)
        tokens = table.column("tokens").to_pylist()
        found = linked([np.frombuffer(tokens[i], np.uint64) for i in once], table.column("n").to_numpy()[once], table.column("comp").to_numpy()[once], percent)
        cls = cls[once]
        return pa.table({"a": pa.array([cls[u] for u, _ in found], pa.int64()), "b": pa.array([cls[v] for _, v in found], pa.int64())})

    return rows.select("chunk", "cls", "n", "comp", "tokens").groupBy("chunk").applyInArrow(run, "a long, b long")


def jaccard_edges(docs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links that connect all linked classes (not every link).

    ``rows``: class and set size of each document.
    """
    parts = n_partitions(docs.sparkSession)
    dealt = _dealt_tokens(docs, k, parts).repartitionById(parts, F.col("bucket"))
    shared = _shared_tokens(dealt, parts).union(_dealt_sizes(rows, parts)).repartitionById(parts, F.col("bucket"))
    candidates = written(_candidates(shared, percent), "jaccard-candidates")
    index = written(_index(candidates, percent), "jaccard-index")
    pivots = index.groupBy("sig").agg(F.min("cls").alias("pivot"), F.max("cls").alias("top")).filter(F.col("pivot") != F.col("top")).select("sig", "pivot")
    stars = index.join(pivots, "sig").select(F.col("cls").alias("a"), F.col("pivot").alias("b"))
    groups = components(stars)

    rows = candidates.join(groups.withColumnsRenamed({"node": "cls", "comp": "grp"}), "cls").select("cls", "n", "tokens", "grp")
    rows = written(rows.withColumn("size", F.octet_length("tokens") / 8), "jaccard-rows")
    sizes = written(rows.groupBy("grp").agg(F.ceil(F.sum("size") / CHUNK_TOKENS).cast("long").alias("chunks")), "jaccard-sizes")
    rows = rows.join(sizes, "grp")
    part = F.pmod(F.xxhash64("cls"), F.col("chunks"))
    single = rows.withColumn("chunk", F.xxhash64("grp", part)).withColumn("comp", F.col("cls"))
    # In groups of several chunks, a few classes go to every chunk too.
    large = rows.filter(F.col("chunks") > 1)
    few = large.groupBy("grp").agg(F.min("chunks").alias("chunks"), F.min_by("cls", F.xxhash64("cls")).alias("p0"), *(F.min_by("cls", F.xxhash64("cls", F.lit(i))).alias(f"p{i}") for i in range(1, PIVOTS)))
    few = few.select("grp", "chunks", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS))))).alias("cls"))
    few = few.join(rows.select("cls", "n", "tokens", "size"), "cls")
    few = few.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    few = few.withColumn("chunk", F.xxhash64("grp", "part")).withColumn("comp", F.col("cls"))
    columns = ["chunk", "cls", "n", "comp", "tokens"]
    edges = written(_verify(single.select(columns).union(few.select(columns)), percent), "jaccard-edges")
    if large.isEmpty():
        return edges

    # What isn't connected yet, in large groups: all classes outside the
    # largest part against all others.
    now = components(edges)
    large = written(large.join(now.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "jaccard-large")
    weight = large.groupBy("grp", "comp").agg(F.sum("size").alias("w"))
    main = weight.groupBy("grp").agg(F.max_by("comp", "w").alias("main"), F.sum("w").alias("all"), F.max("w").alias("most"))
    main = main.select("grp", "main", F.ceil(F.col("most") / CHUNK_TOKENS).cast("long").alias("n_main"), F.ceil((F.col("all") - F.col("most")) / CHUNK_TOKENS).cast("long").alias("n_out"))
    large = large.join(written(main.filter("n_out > 0"), "jaccard-main"), "grp")
    is_main = F.col("comp") == F.col("main")
    own = F.when(is_main, F.pmod(F.xxhash64("cls"), F.col("n_main"))).otherwise(F.pmod(F.xxhash64("cls"), F.col("n_out")) + F.col("n_main"))
    large = large.withColumn("own", own)
    # A main chunk meets each outer chunk; an outer chunk meets all chunks.
    other = F.when(is_main, F.sequence(F.col("n_main"), F.col("n_main") + F.col("n_out") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n_main") + F.col("n_out") - 1))
    large = large.withColumn("other", F.explode(other))
    large = large.withColumn("chunk", F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other"), F.lit("x")))
    return edges.union(_verify(large.select(columns), percent))


def ngram_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n_shingles``, ``component_id``
    (smallest id reachable by links of similarity >= ``percent`` / 100)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size_name, component_name = (name + "_" if name.lower() == id_col.lower() else name for name in ("n_shingles", "component_id"))
    rows = written(_documents(docs, k), "jaccard-documents")
    labels = components(jaccard_edges(docs, rows, k, percent))
    rows = rows.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    label = F.when(F.col("n_shingles") == 0, F.xxhash64("id", F.lit("empty"))).otherwise(F.coalesce("comp", "cls"))
    rows = written(rows.select("id", "n_shingles", label.alias("label")), "jaccard-labels")
    # Written, so that the join's sides are plain exchanges, which Spark can
    # split where many documents have one label.
    least = written(rows.groupBy("label").agg(F.min("id").alias("component_id")), "jaccard-least")
    return rows.join(least, "label").select(F.col("id").alias(id_col), F.col("n_shingles").alias(size_name), F.col("component_id").alias(component_name))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
