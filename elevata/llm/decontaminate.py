"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents. Its words become symbols of the test
phrases' alphabet; any other word, and each document's end, is a separator
that is smaller than every symbol and unlike every other separator. The
index holds the Burrows-Wheeler transform in a wavelet tree, and suffix
positions sampled at a fixed step and at each start after a separator. Test
phrases (windows of consecutive words) are searched backwards, occurrences
are located by walking to a sampled position, and the words that they cover
are merged into removal spans.

A benchmark of up to PHRASE_BYTES is broadcast. A larger one is written into
the shared folder in blocks of about that size, and one stage searches all of
them: a task holds the indexes of a few shards, each built once, and reads
block after block. Then a shard's own words are its alphabet. Words are told
apart by hashes of 64 bits.

Defined results: a null or empty text has no words; an item with fewer words
than the window, but not none, is one window, one without words is none; rows
of the benchmark with one id are one item; an item without an id is listed as
an empty string; rows that repeat give equal rows; an empty benchmark hits
nothing; an empty table gives an empty table. Texts are indexed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, fold_ascii, free_name, new_path, span_hashes, spans, trimmed, utf8_column

#: Bytes of text in a shard, and of benchmark text that is searched at once.
SHARD_BYTES, PHRASE_BYTES = 3 << 20, 8 << 20
#: Every so many positions of a shard have a sampled suffix position.
SAMPLE_STEP = 8
#: Shards whose indexes a task holds while it reads the blocks of a large
#: benchmark.
SHARDS = 8

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = True
_WORD[0x61:0x7B] = True
_WORD[0x80:] = True


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((self.n // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """A wavelet tree, its levels as single bit vectors (zeros first)."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.height = max(1, int(size - 1).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for b in range(self.height - 1, -1, -1):
            bit = (symbols >> b) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - np.count_nonzero(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``i`` entries."""
        start = np.zeros_like(i)
        for level, zeros, b in zip(self.levels, self.zeros, range(self.height - 1, -1, -1), strict=True):
            one = (symbol >> b) & 1 == 1
            r0, r1 = level.rank(start), level.rank(i)
            start = np.where(one, zeros + r0, start - r0)
            i = np.where(one, zeros + r1, i - r1)
        return i - start

    def get_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry ``i`` and how often it occurs before."""
        at, start = i, np.zeros_like(i)
        symbol = np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one = level.get(at)
            symbol = (symbol << 1) | one
            r0, r1 = level.rank(start), level.rank(at)
            start = np.where(one, zeros + r0, start - r0)
            at = np.where(one, zeros + r1, at - r1)
        return symbol, at - start


def suffix_array(symbols: np.ndarray, size: int) -> np.ndarray:
    """Order of all suffixes, by prefix doubling over groups still tied.

    Symbol 0 is a separator: each one differs from all others, so that no
    comparison goes beyond it. The last symbol must be 0.
    """
    n = len(symbols)
    is_sep = symbols == 0
    n_sep = int(np.count_nonzero(is_sep))
    counts = np.bincount(symbols, minlength=size)
    first = np.zeros(size, np.int64)
    np.cumsum(counts[:-1], out=first[1:])
    rank = first[symbols]
    rank[is_sep] = np.arange(n_sep)
    order = np.argsort(rank, kind="stable")
    group = rank[order]
    tied = np.zeros(n, bool)
    tied[1:] = group[1:] == group[:-1]
    tied[:-1] |= tied[1:].copy()
    slots = np.flatnonzero(tied)
    step = 1
    while len(slots):
        at = order[slots]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[at + step].astype(np.uint64)
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.maximum.accumulate(np.where(new, slots, 0))
        rank[at] = begin
        alone = new.copy()
        alone[:-1] &= new[1:]
        slots = slots[~alone]
        step *= 2
    return order


class FMIndex:
    """Backward search and location over one shard of symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        order = suffix_array(symbols, size)
        self.size = size
        counts = np.bincount(symbols, minlength=size)
        self.first = np.zeros(size + 1, np.int64)
        np.cumsum(counts, out=self.first[1:])
        self.tree = Wavelet(symbols[order - 1].astype(np.int32), size)
        sampled = order % SAMPLE_STEP == 0
        sampled |= symbols[order - 1] == 0
        self.marks = Bits(sampled)
        self.sampled = order[sampled].astype(np.int32)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the phrases (rows of symbols, left-aligned)."""
        n = len(phrases)
        lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        last = phrases[live, lengths - 1]
        lo[:], hi[:] = self.first[last], self.first[last + 1]
        step = 2
        while True:
            live = live[(lo[live] < hi[live]) & (lengths[live] >= step)]
            if not len(live):
                return lo, hi
            symbol = phrases[live, lengths[live] - step].astype(np.int64)
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo[live], hi[live]]))
            lo[live] = self.first[symbol] + both[: len(live)]
            hi[live] = self.first[symbol] + both[len(live):]
            step += 1

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at the given rows."""
        out = np.zeros(len(rows), np.int64)
        live, steps = np.arange(len(rows)), 0
        rows = rows.copy()
        while len(live):
            here = rows[live]
            known = self.marks.get(here)
            found = live[known]
            out[found] = self.sampled[self.marks.rank(here[known])] + steps
            live = live[~known]
            symbol, before = self.tree.get_and_rank(rows[live])
            rows[live] = self.first[symbol] + before
            steps += 1
        return out


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of all texts."""
    folded = fold_ascii(raw)
    starts, ends = spans(_WORD[folded], offsets)
    return starts, ends, span_hashes(folded, starts, ends)


class Phrases:
    """The windows of the test items, over an alphabet of word hashes."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import pyarrow as pa

        raw, offsets = utf8_column(pa.array([t for _, t in items], pa.large_string()))
        starts, _, hashes = words_of(raw, offsets)
        self.words = np.unique(hashes)
        self.size = len(self.words) + 1
        symbols = np.searchsorted(self.words, hashes) + 1
        bounds = np.searchsorted(starts, offsets)
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        rows, lengths, owners = [], [], []
        for k, (item, _) in enumerate(items):
            own = symbols[bounds[k]: bounds[k + 1]]
            if len(own) == 0:
                continue
            wide = min(window, len(own))
            view = np.lib.stride_tricks.sliding_window_view(own, wide)
            block = np.zeros((len(view), window), np.int32)
            block[:, :wide] = view
            rows.append(block)
            lengths.append(np.full(len(view), wide))
            owners.append(np.full(len(view), number[item]))
        if not rows:
            self.rows = np.zeros((0, window), np.int32)
            self.lengths = self.owner = np.zeros(0, np.int64)
            self.owner_at = np.zeros(1, np.int64)
            return
        every = np.concatenate(rows)
        self.rows, which = np.unique(every, axis=0, return_inverse=True)
        which = which.ravel()
        self.lengths = (self.rows > 0).sum(axis=1)
        pairs = np.unique(np.stack([which, np.concatenate(owners)]), axis=1)
        self.owner = pairs[1]
        self.owner_at = np.searchsorted(pairs[0], np.arange(len(self.rows) + 1))


def symbols_of(alphabet: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Symbols of words; 0 for words outside the sorted alphabet."""
    if not len(alphabet):
        return np.zeros(len(hashes), np.int32)
    at = np.searchsorted(alphabet, hashes)
    at[at == len(alphabet)] = 0
    return np.where(alphabet[at] == hashes, at + 1, 0).astype(np.int32)


class Shard:
    """The index of a run of documents over an alphabet of word hashes.

    ``bounds``: where the documents' words start and end.
    """

    def __init__(self, alphabet: np.ndarray, hashes: np.ndarray, bounds: np.ndarray):
        self.alphabet, self.bounds, self.index = alphabet, bounds, None
        if not len(alphabet) or not len(hashes):
            return
        n_docs = len(bounds) - 1
        symbols = symbols_of(alphabet, hashes)
        # A separator after each document, then one for each run of separators.
        ends = np.zeros(len(hashes) + n_docs, np.int32)
        place = np.arange(len(hashes)) + np.repeat(np.arange(n_docs), np.diff(bounds))
        ends[place] = symbols
        word = np.full(len(ends), -1, np.int64)
        word[place] = np.arange(len(hashes))
        keep = ends > 0
        keep[0] |= True
        keep[1:] |= ends[:-1] > 0
        ends, word = ends[keep], word[keep]
        if ends[-1] != 0:
            ends, word = np.append(ends, 0), np.append(word, -1)
        self.word = word
        self.index = FMIndex(ends, len(alphabet) + 1)

    def search(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each occurrence: its window's row, first word, and document."""
        none = np.zeros(0, np.int64)
        if self.index is None or not len(phrases.rows):
            return none, none, none
        # The phrases' symbols in this alphabet; those with other words occur
        # nowhere here.
        here = np.append(0, symbols_of(self.alphabet, phrases.words))[phrases.rows]
        able = np.flatnonzero(((here > 0) | (phrases.rows == 0)).all(axis=1))
        if not len(able):
            return none, none, none
        lo, hi = self.index.search(here[able], phrases.lengths[able])
        n = np.maximum(hi - lo, 0)
        which = np.repeat(able, n)
        if not len(which):
            return none, none, none
        row = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        at = self.word[self.index.locate(row)]
        return which, at, np.searchsorted(self.bounds, at, side="right") - 1


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any of the runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


class _Found:
    """What occurs in the documents of a batch."""

    def __init__(self, batch, text: str):
        self.batch = batch
        raw, self.offsets = utf8_column(batch.column(text))
        self.starts, self.ends, self.hashes = words_of(raw, self.offsets)
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.items: list[list[str]] = [[] for _ in range(batch.num_rows)]
        self.spans: list[list[list[int]]] = [[] for _ in range(batch.num_rows)]

    def add(self, phrases: Phrases, which: np.ndarray, at: np.ndarray, doc: np.ndarray) -> None:
        if not len(which):
            return
        starts, ends, bounds, offsets = self.starts, self.ends, self.bounds, self.offsets
        n_own = phrases.owner_at[which + 1] - phrases.owner_at[which]
        own = phrases.owner[np.repeat(phrases.owner_at[which] - (np.cumsum(n_own) - n_own), n_own) + np.arange(n_own.sum())]
        pairs = np.unique(np.stack([np.repeat(doc, n_own), own]), axis=1)
        hit = covered(len(starts), at, phrases.lengths[which])
        edge = np.zeros(len(starts) + 1, bool)
        edge[1:-1] = hit[1:] != hit[:-1]
        edge[0], edge[-1] = True, True
        edge[bounds] = True
        cuts = np.flatnonzero(edge)
        runs = cuts[:-1][hit[cuts[:-1]]]
        stops = cuts[1:][hit[cuts[:-1]]]
        for d in np.unique(doc):
            mine = pairs[1, np.searchsorted(pairs[0], d): np.searchsorted(pairs[0], d, side="right")]
            self.items[d] = sorted({*self.items[d], *(phrases.ids[i] for i in mine)})
            a, b = np.searchsorted(runs, bounds[d]), np.searchsorted(runs, bounds[d + 1])
            new = [[int(x - bounds[d]), int(y - bounds[d]), int(starts[x] - offsets[d]), int(ends[y - 1] - offsets[d])] for x, y in zip(runs[a:b], stops[a:b], strict=True)]
            self.spans[d] = _merged([*self.spans[d], *new])

    def rows(self, names: list[str]):
        import pyarrow as pa

        added = [pa.array(np.diff(self.bounds), pa.int64()), pa.array(self.items, pa.list_(pa.string())), pa.array(self.spans, pa.list_(pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays([*self.batch.columns, *added], names=names)


def _search_broadcast(items: list[tuple[str, str]], window: int, text: str, names: list[str], spark: SparkSession):
    shared = spark.sparkContext.broadcast(items)

    def run(batches: Iterator) -> Iterator:
        phrases = Phrases(shared.value, window)
        for batch in chunked(batches, SHARD_BYTES, text):
            found = _Found(batch, text)
            found.add(phrases, *Shard(phrases.words, found.hashes, found.bounds).search(phrases))
            yield found.rows(names)

    return run


def _search_blocks(folder: str, n_blocks: int, window: int, text: str, names: list[str]):
    def block(files, root: str, k: int) -> list[tuple[str, str]]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        out = []
        for each in files.get_file_info(fs.FileSelector(f"{root}/block={k}", allow_not_found=True)):
            if each.path.endswith(".parquet"):
                with files.open_input_file(each.path) as source:
                    table = pq.read_table(source, columns=["i", "t"])
                out += zip(table.column("i").to_pylist(), table.column("t").to_pylist(), strict=True)
        return out

    def searched(held: list[_Found], files, root: str) -> Iterator:
        shards = [Shard(np.unique(f.hashes), f.hashes, f.bounds) for f in held]
        for k in range(n_blocks):
            if items := block(files, root, k):
                phrases = Phrases(items, window)
                for found, shard in zip(held, shards, strict=True):
                    found.add(phrases, *shard.search(phrases))
        for found in held:
            yield found.rows(names)

    def run(batches: Iterator) -> Iterator:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        held = []
        for batch in chunked(batches, SHARD_BYTES, text):
            held.append(_Found(batch, text))
            if len(held) == SHARDS:
                yield from searched(held, files, root)
                held = []
        if held:
            yield from searched(held, files, root)

    return run


def _merged(runs: list[list[int]]) -> list[list[int]]:
    """Union of [first word, end word, first byte, end byte] runs."""
    out: list[list[int]] = []
    for run in sorted(runs):
        if out and run[0] <= out[-1][1]:
            if run[1] > out[-1][1]:
                out[-1][1], out[-1][3] = run[1], run[3]
        else:
            out.append(list(run))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` plus ``n_words``, ``items`` (sorted ids of the items of which a
    window occurs) and ``removal_spans`` (merged runs of hit words, each
    [first word, end word, first byte, end byte] in the UTF-8 text).

    What is broadcast, or read by a task at once, doesn't grow with the
    benchmark. Added names get underscores where they clash.
    """
    spark = docs.sparkSession
    n_words, items_col, spans_col = (free_name(docs, c) for c in ("n_words", "items", "removal_spans"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    n_blocks = int(size // PHRASE_BYTES) + 1
    added = [T.StructField(n_words, T.LongType()), T.StructField(items_col, T.ArrayType(T.StringType())), T.StructField(spans_col, T.ArrayType(T.ArrayType(T.LongType())))]
    schema = T.StructType([*docs.schema.fields, *added])
    if n_blocks == 1:
        run = _search_broadcast([(r[0], r[1]) for r in items.collect()], window, text_col, schema.fieldNames(), spark)
    else:
        folder = new_path(spark, "benchmark-blocks")
        items.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(n_blocks)).cast("int")).write.partitionBy("block").parquet(folder)
        run = _search_blocks(folder, n_blocks, window, text_col, schema.fieldNames())
    return docs.mapInArrow(trimmed(run), schema)


def remove_spans(found: DataFrame, text_col: str = "text", spans_col: str = "removal_spans") -> DataFrame:
    """``found`` with the removal spans cut out of the texts."""
    raw, cuts = F.col(text_col).cast("binary"), F.col(spans_col)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda s: F.get(s, F.lit(3))))
    ends = F.concat(F.transform(cuts, lambda s: F.get(s, F.lit(2))), F.array(F.octet_length(text_col).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    return found.withColumn(text_col, F.when(F.size(cuts) > 0, F.array_join(kept, "")).otherwise(F.col(text_col)))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("removal_spans", F.lit(0).cast("long"), lambda s, x: s + F.get(x, F.lit(1)) - F.get(x, F.lit(0)))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
