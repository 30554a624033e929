"""Removal of long repeated byte strings by sorted suffixes.

A byte goes if it is covered by a string of ``length`` bytes that also starts
anywhere else, in the same document or another.

Not every suffix is sorted: one entry of eight bytes for each byte of text
would already be twice the disk that a run may take. Each window of ``length``
bytes chooses the position of its smallest hash of LEAD bytes (the first,
where several are equal); equal windows choose alike. So the suffixes to
compare start at the chosen positions, the anchors (one in some 150 bytes),
and the windows of an anchor are a run of starts. An anchor's region is what
its windows cover.

1. Regions that occur twice (equal leading token and region hash, 128 bits
   together) are removed whole; anchors whose leading token, the LEAD bytes at
   the anchor, occurs once have no repeated window.
2. For leading tokens with several different regions, one copy of each region
   is cut from its document. Sampled splitters range-partition them by leading
   token, in the order of its bytes, and by a tie-break behind it, so that a
   token which very many regions share is spread over as many buckets as it
   needs.
3. Each bucket sorts the windows of a leading token by multikey quicksort:
   ties are sorted by the next eight bytes only, down to equal windows.
4. Only the first and the last leading token of a bucket can go on in a
   neighbouring bucket. Where one does, its windows are compared across the
   boundaries: every bucket sends each distinct window's hash once to the
   bucket of its hash range, and gets back those that occur elsewhere too.

Defined results: a null text is empty; texts shorter than ``length`` keep all;
rows that repeat are documents of their own, so all they repeat goes; null ids
are allowed; an empty table gives an empty table. What is kept is bytes: a cut
may fall inside a character. Within a bucket windows are compared byte by
byte, across boundaries by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, eights, free_name, mix, n_partitions, token_hashes, trimmed, utf8_column, written

#: Bytes of a leading token; of regions in a bucket, on average.
LEAD, BUCKET_BYTES = 100, 4 << 20
#: Bytes of text that are looked through at a time.
PIECE_BYTES = 3 << 20


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by block-wise scans."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, lead: int = LEAD) -> dict[str, np.ndarray]:
    """Anchors of all documents: document, first window start, number of
    windows, place of the anchor in the region, leading token and region hash.
    Starts count from the document."""
    names = ("doc", "lo", "n", "at", "h", "reg")
    lead = min(lead, length)
    n = len(raw) - length + 1
    if n <= 0:
        return {k: np.zeros(0, np.uint64 if k in ("h", "reg") else np.int64) for k in names}
    token = token_hashes(raw, lead)
    low = np.uint64((1 << 24) - 1)
    # The place in the low bits makes the first of equal hashes the smallest.
    at = np.arange(len(token))
    chosen = (window_minima((token & ~low) | at.astype(np.uint64), length - lead + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    fits = np.arange(n) + length <= offsets[doc + 1]
    begin = fits.copy()
    begin[1:] &= ~fits[:-1] | (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(begin)
    stop = np.append(lo[1:], n)
    bad = np.flatnonzero(~fits)
    after = np.append(bad, n)[np.searchsorted(bad, lo)]
    hi = np.minimum(stop, after)
    own = chosen[lo] - lo
    # The region's tokens one behind the other, the last one up to its end.
    last = hi - 1 + length - lead
    region = mix((hi - lo).astype(np.uint64) << np.uint64(32) | own.astype(np.uint64))
    for step in range(0, int((last - lo).max(initial=0)) + lead, lead):
        region = np.where(lo + step < last + lead, mix(region + token[np.minimum(lo + step, last)]), region)
    return {"doc": doc[lo], "lo": lo - offsets[doc[lo]], "n": hi - lo, "at": own, "h": token[chosen[lo]], "reg": region}


def _pieces(raw: np.ndarray, offsets: np.ndarray, length: int):
    """Texts as they are; a very long one in overlapping parts."""
    if len(offsets) > 2 or len(raw) <= 2 * PIECE_BYTES:
        yield 0, raw, offsets
        return
    for at in range(0, len(raw), PIECE_BYTES):
        part = raw[at: at + PIECE_BYTES + length - 1]
        yield at, part, np.array([0, len(part)])


def _signed(x: np.ndarray):
    import pyarrow as pa

    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _all_anchors(docs: DataFrame, length: int) -> DataFrame:
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("h", "reg")), docs.schema["id"], T.StructField("th", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("at", T.IntegerType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunked(batches, PIECE_BYTES):
            raw, offsets = utf8_column(batch.column("text"))
            for at, part, bounds in _pieces(raw, offsets, length):
                a = anchors(part, bounds, length)
                doc = pa.array(a["doc"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [_signed(a["h"]), _signed(a["reg"]), batch.column("id").take(doc), batch.column("th").take(doc), pa.array(a["lo"] + at, pa.int64()), pa.array(a["n"], pa.int32()), pa.array(a["at"], pa.int32())],
                    names=schema.fieldNames(),
                )

    return docs.mapInArrow(trimmed(run), schema)


def repeated_windows(raw: np.ndarray, starts: np.ndarray, length: int, group: np.ndarray) -> np.ndarray:
    """Which windows equal another one of their ``group``: multikey quicksort.

    Each round takes the next eight bytes of the windows that are still tied.
    Ties in which all have the same bytes go on as they are; the others are
    sorted by these bytes, and windows that are alone then are left behind.
    """
    out = np.zeros(len(starts), bool)
    eight = eights(raw)
    live = np.argsort(group, kind="stable")
    tie = group[live]
    for depth in range(-8, length, 8):
        if depth >= 0:
            # The last round goes back, so that it ends with the window.
            token = eight[starts[live] + min(depth, max(0, length - 8))]
            if length < 8:
                token = token & np.uint64((1 << 8 * length) - 1)
            token = token.byteswap()
            head = np.append(True, tie[1:] != tie[:-1])
            number = np.cumsum(head) - 1
            unlike = np.zeros(int(number[-1]) + 1, bool)
            unlike[number[token != token[np.flatnonzero(head)[number]]]] = True
            some = np.flatnonzero(unlike[number])
            order = np.lexsort((token[some], number[some]))
            live[some], token[some] = live[some[order]], token[some[order]]
            new = np.append(True, (number[1:] != number[:-1]) | (token[1:] != token[:-1]))
        else:
            new = np.append(True, tie[1:] != tie[:-1]) if len(tie) else np.zeros(0, bool)
        tie = np.cumsum(new)
        alone = new & np.append(new[1:], True) if len(new) else new
        live, tie = live[~alone], tie[~alone]
        if not len(live):
            return out
    out[live] = True
    return out


def _runs(flags: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end of runs of true flags; row i has n[i] flags."""
    row = np.repeat(np.arange(len(n)), n)
    head = np.cumsum(n) - n
    begin, end = flags.copy(), flags.copy()
    begin[1:] &= ~flags[:-1] | (row[1:] != row[:-1])
    end[:-1] &= ~flags[1:] | (row[1:] != row[:-1])
    b, e = np.flatnonzero(begin), np.flatnonzero(end)
    return row[b], b - head[row[b]], e - head[row[b]] + 1


class _Regions:
    """Region rows of Arrow batches, with all their windows."""

    def __init__(self, table):
        self.table = table
        self.raw, offsets = utf8_column(table.column("raw"))
        self.n = table.column("n").to_numpy().astype(np.int64)
        self.back = np.arange(self.n.sum()) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.starts = np.repeat(offsets[:-1], self.n) + self.back

    def groups(self) -> np.ndarray:
        """Equal windows have one leading token and stand alike to it."""
        h = self.table.column("h").to_numpy().view(np.uint64)
        at = self.table.column("at").to_numpy().astype(np.int64)
        off = (np.repeat(at, self.n) - self.back).astype(np.uint64)
        return mix(np.repeat(h, self.n) + off)

    def spans(self, flags: np.ndarray, length: int):
        """Spans of repeated windows in regions that occur once."""
        import pyarrow as pa

        once = np.repeat(self.table.column("occ").to_numpy() == 1, self.n)
        row, a, b = _runs(flags & once, self.n)
        lo = self.table.column("lo").to_numpy()[row]
        take = pa.array(row, pa.int64())
        columns = [self.table.column(c).take(take) for c in ("id", "th")] + [pa.array(lo + a, pa.int64()), pa.array(lo + b - 1 + length, pa.int64())]
        return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]


SPAN, REGION = ["id", "th", "start", "end"], ["h", "id", "th", "lo", "n", "at", "occ", "raw"]


def _compare(regions: DataFrame, length: int, schema: T.StructType) -> DataFrame:
    """Spans from regions in buckets, sorted by leading token; and the regions
    of each bucket's first and last token, with its number in ``block``."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        arrow = None

        def found(table):
            r = _Regions(table)
            columns = r.spans(repeated_windows(r.raw, r.starts, length, r.groups()), length)
            n = len(columns[0])
            held = [pa.nulls(n, arrow.field(c).type) for c in REGION if c not in SPAN]
            return row_of(dict(zip(SPAN, columns, strict=True)) | dict(zip([c for c in REGION if c not in SPAN], held, strict=True)), n)

        def edge(table):
            table = table.combine_chunks()
            own = {c: table.column(c).combine_chunks() if table.num_rows else pa.nulls(0, arrow.field(c).type) for c in REGION}
            return row_of(own | {"start": pa.nulls(table.num_rows, pa.int64()), "end": pa.nulls(table.num_rows, pa.int64())}, table.num_rows, block)

        def row_of(columns, n, number=None):
            columns["block"] = pa.array([number] * n, pa.int32())
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in arrow], schema=arrow)

        held, size, first = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if arrow is None:
                arrow = to_arrow(schema, batch)
            h = batch.column("h").to_numpy()
            if first is None:
                first = h[0]
            new = np.flatnonzero(h[1:] != h[:-1]) + 1
            last = int(new[-1]) if len(new) else 0  # where the last token begins
            if size > PIECE_BYTES and held and (last or held[-1].column("h")[-1].as_py() != h[0]):
                table = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
                yield found(table)
                yield edge(table.filter(pa.array(table.column("h").to_numpy() == first)))
                held, size, batch = [], 0, batch.slice(last)
            held.append(batch)
            size += batch.nbytes
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield found(table)
            h = table.column("h").to_numpy()
            yield edge(table.filter(pa.array((h == first) | (h == h[-1]))))

    def to_arrow(schema, batch):
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(schema)

    return regions.mapInArrow(trimmed(run), schema)


def _across(regions: DataFrame, length: int, schema: T.StructType, parts: int) -> DataFrame:
    """Spans of regions whose leading token lies in several buckets; only
    window hashes meet, each once a bucket."""
    def hashed(table):
        r = _Regions(table)
        return r, mix(token_hashes(r.raw, length)[r.starts] ^ r.groups())

    def send(table):
        import pyarrow as pa

        _, h = hashed(table)
        key, count = np.unique(h, return_counts=True)
        edges = np.array([i * (1 << 64) // parts for i in range(1, parts)], np.uint64)
        cuts = np.concatenate([[0], np.searchsorted(key, edges), [len(key)]])
        use = np.flatnonzero(np.diff(cuts))
        block = table.column("block")[0].as_py()
        each = lambda x: pa.array([x[cuts[b]: cuts[b + 1]].tobytes() for b in use], pa.binary())
        return pa.table({"bucket": pa.array(use, pa.int32()), "block": pa.array([block] * len(use), pa.int32()), "keys": each(key), "many": each(count > 1)})

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keys, many, block = [], [], []
        for batch in batches:
            for k, m, b in zip(*(batch.column(c).to_pylist() for c in ("keys", "many", "block")), strict=True):
                keys.append(np.frombuffer(k, np.uint64))
                many.append(np.frombuffer(m, bool))
                block.append(np.full(len(keys[-1]), b, np.int32))
        if not keys:
            return
        key, many, block = np.concatenate(keys), np.concatenate(many), np.concatenate(block)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        again = many | (count[which] > 1)
        key, block = key[again], block[again]
        order = np.argsort(block, kind="stable")
        key, block = key[order], block[order]
        names, first, size = np.unique(block, return_index=True, return_counts=True)
        ends = first + size  # none, where no hash occurs again
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([key[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], names=["block", "keys"])

    def back(own, found):
        import pyarrow as pa

        if not own.num_rows:
            return pa.Table.from_batches([], schema=empty)
        r, h = hashed(own)
        known = np.sort(np.frombuffer(b"".join(found.column("keys").to_pylist()), np.uint64))
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        flags = known[at] == h if len(known) else np.zeros(len(h), bool)
        return pa.Table.from_arrays(r.spans(flags, length), names=SPAN)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema)
    sent = regions.groupBy("block").applyInArrow(send, "bucket int, block int, keys binary, many binary")
    met = sent.repartitionById(parts, F.col("bucket")).mapInArrow(trimmed(meet), "block int, keys binary")
    return regions.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(back, schema)


def _region_schema(docs: DataFrame) -> T.StructType:
    long, whole = T.LongType(), T.IntegerType()
    return T.StructType([
        T.StructField("h", long), docs.schema["id"], T.StructField("th", long), T.StructField("lo", long), T.StructField("n", whole),
        T.StructField("at", whole), T.StructField("occ", long), T.StructField("raw", T.BinaryType()),
    ])


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted regions of each document."""
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("h", "lo", "n", "at", "occ")).alias("w"))
    lists = lists.select(F.col("id").alias("id2"), F.col("th").alias("th2"), "w")
    joined = docs.join(lists, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))).select("id", "th", "text", "w")
    schema = _region_schema(docs)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunked(batches, PIECE_BYTES):
            raw, offsets = utf8_column(batch.column("text"))
            data, w = raw.tobytes(), batch.column("w")
            doc = np.repeat(np.arange(batch.num_rows), np.diff(w.offsets.to_numpy()))
            flat = w.flatten()
            h, lo, n, at, occ = (flat.field(i) for i in range(5))
            a = offsets[doc] + lo.to_numpy()
            b = a + n.to_numpy() - 1 + length
            take = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([h, batch.column("id").take(take), batch.column("th").take(take), lo, n, at, occ, pa.array([data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())], names=schema.fieldNames())

    return joined.mapInArrow(trimmed(run), schema)


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``n_bytes``, ``removed_spans`` ([start, end) in bytes,
    maximal) and ``kept`` (bytes). Names get underscores where they clash."""
    parts = n_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    every = written(_all_anchors(slim, length), "suffix-anchors")
    # Written, so that the joins' sides are plain exchanges, which Spark can
    # split where one token has many anchors.
    twice = written(every.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "suffix-tokens")
    some = written(every.join(twice, "h", "left_semi"), "suffix-shared")
    copy = [F.first(c).alias(c) for c in ("id", "th", "lo", "n", "at")]
    regions = written(some.groupBy("h", "reg").agg(F.count("*").alias("occ"), *copy), "suffix-regions")
    whole = some.join(regions.filter("occ > 1").select("h", "reg"), ["h", "reg"], "left_semi").select("id", "th", F.col("lo").alias("start"), (F.col("lo") + F.col("n") - 1 + length).alias("end"))
    mixed = written(regions.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1").select("h"), "suffix-mixed")
    wanted = regions.join(mixed, "h").select("h", "id", "th", "lo", "n", "at", "occ")
    cut = written(_cut(slim, wanted, length), "suffix-cut")

    span = T.StructType([slim.schema["id"], T.StructField("th", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    size = cut.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = max(parts, int(size // BUCKET_BYTES) + 1)
    token = F.substring("raw", F.col("at") + 1, F.lit(min(LEAD, length)))
    dealt = cut.repartitionByRange(buckets, token, F.col("h"), F.xxhash64("th", "lo")).sortWithinPartitions(token, "h")
    every = T.StructType([*_region_schema(slim).fields, *span.fields[2:], T.StructField("block", T.IntegerType())])
    compared = written(_compare(dealt, length, every), "suffix-compared")
    spans = whole.union(compared.filter("block IS NULL").select(*SPAN))
    edges = compared.filter("block IS NOT NULL")
    split = edges.groupBy("h").agg(F.min("block").alias("least"), F.max("block").alias("most")).filter("least < most").select("h")
    split = written(edges.join(written(split, "suffix-split"), "h", "left_semi").select(*REGION, "block"), "suffix-edges")
    if not split.isEmpty():
        spans = spans.union(_across(split, length, span, parts))
    return _without(docs, written(spans, "suffix-spans"), id_col, text_col)


def _without(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    tid, th, tspans = (free_name(docs, f"_sd_{x}") for x in ("id", "hash", "spans"))
    names = [free_name(docs, c) for c in ("n_bytes", "removed_spans", "kept")]
    lists = spans.groupBy(F.col("id").alias(tid), F.col("th").alias(th)).agg(F.collect_set(F.struct("start", "end")).alias(tspans))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(lists, F.col(id_col).eqNullSafe(F.col(tid)) & (F.xxhash64(text) == F.col(th)), "left").drop(tid, th)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.ArrayType(T.LongType()))), T.StructField(names[2], T.BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in chunked(batches, PIECE_BYTES, text_col):
            raw, offsets = utf8_column(batch.column(text_col))
            data, cuts, kept = raw.tobytes(), [], []
            for i, own in enumerate(batch.column(tspans).to_pylist()):
                a, b = int(offsets[i]), int(offsets[i + 1])
                merged: list[list[int]] = []
                for s in sorted((x["start"], x["end"]) for x in own or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                parts, at = [], a
                for s, e in merged:
                    parts.append(data[at: a + s])
                    at = a + e
                kept.append(b"".join([*parts, data[at:b]]))
                cuts.append(merged)
            columns = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(offsets), pa.int64()), pa.array(cuts, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())], names=schema.fieldNames())

    return joined.mapInArrow(trimmed(run), schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = suffix_dedup(docs)
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda s, x: s + F.get(x, F.lit(1)) - F.get(x, F.lit(0)))
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
