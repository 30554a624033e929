"""Shared plumbing: the shared folder, written intermediates, token hashing."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: White space of the word contracts: space and TAB..CR.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A temporary one is set only where the session names none and runs in one
    process, as in tests; on a cluster the setting must be there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="elevata-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone by then
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage so that a lost executor costs only a re-read.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def free_name(df: DataFrame, want: str) -> str:
    """``want``, with underscores until it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


def n_partitions(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker's freed memory goes back to the system:
    Python workers live on between tasks and stages."""
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


# --- numpy views of texts ------------------------------------------------

def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of an Arrow string array (null: empty)."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, off, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0]: offsets[-1]]
    return raw, offsets - offsets[0]


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, byte for byte."""
    return _FOLD[raw]


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes; runs end at document bounds."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = mask[inner]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    end[inner - 1] = mask[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Longer spans are hashed by BLAKE2; places whose tokens are hashed at a time.
_LONG, _PLACES = 1024, 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    x = x ^ (x >> np.uint64(29))
    x = x * _MULT
    return x ^ (x >> np.uint64(32))


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers (zeros behind the end)."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand.

    Eight bytes are mixed in at a time, so no texts are known that collide by
    their structure, as there are for polynomials modulo 2**64.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * _MULT + _STEP)
    eight = eights(raw)
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = starts[live], size[live]
    while len(live):
        chunk = eight[at] & _KEPT[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ chunk) + _STEP
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG):
        own = raw[starts[i]: ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little")
    return out


def token_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of the ``width`` bytes from each place that has them: those
    of two halves are joined, from eight bytes on."""
    n = len(raw) - width + 1
    out = np.empty(max(0, n), np.uint64)
    eight = eights(raw)
    low = _KEPT[min(width, 8)]
    for at in range(0, n, _PLACES):
        to = min(n, at + _PLACES)
        have = min(width, 8)
        h = mix((eight[at: to + width - have] & low) + _STEP)
        while have < width:
            further = min(have, width - have)
            a, b = h[: len(h) - further], h[further:]
            h = a * _MULT
            h += b
            h ^= h >> np.uint64(32)
            h *= _STEP
            h ^= h >> np.uint64(29)
            have += further
        out[at:to] = h
    return out


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[i: i + n]
    return mix(out)


def chunked(batches: Iterator, most_bytes: int = 8 << 20, text: str = "text") -> Iterator:
    """Arrow batches cut to whole rows of about ``most_bytes`` of text."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        column = batch.column(text) if isinstance(text, str) else batch.column(text)
        _, offsets = utf8_column(column)
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to
