"""WARC archives with an index written first and read by byte ranges.

Each task writes records (one gzip member each) to archives of its own in the
shared folder and returns their index rows: archive, offset, length, URL and
digest. The index is a Parquet table; only rows of tasks that succeeded are in
it, so files of failed or repeated attempts are never read. Reading takes any
selection of index rows, sorts them by archive and offset, joins neighbouring
ranges into single reads and checks every payload against its digest.

Records with equal payloads of at least ``least_bytes`` are written once: the
one with the largest id is a response, the others revisit it.

Defined results: a null payload is empty; rows that share the largest id of
equal payloads are responses all of them; a null id is smaller than any other
and where all ids of a group are null, all are responses; a null URL is
written as an empty one; columns other than id, url and payload are not
archived, whatever their names; an empty table gives no archive and no row.
Archives are reached by ``pyarrow.fs`` from the URI of the shared folder, which
all executors must be able to open.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_partitions, new_path, written

#: A new archive is begun beyond so many bytes; ranges that are no further
#: apart than GAP are read as one, up to READ_BYTES.
ARCHIVE_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 64 << 10, 8 << 20
#: Bytes of archives that a task reads, on average.
TASK_BYTES = 64 << 20
#: A digest with at least one in so many of all rows is heavy: no more than
#: this many can be, so they are broadcast.
HEAVY_SHARE = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "id string, archive string, offset long, length long, url string, digest string, record_type string, payload_bytes long"


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``pages`` (id, url, payload) plus digest and the id that it revisits.

    Digests that occur once need no partner, heavy ones are broadcast, and
    rows of neither are dealt out evenly by a salted key.
    """
    pages = pages.select("id", "url", F.coalesce("payload", F.lit("")).alias("payload"))
    pages = pages.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    keys = pages.filter(F.octet_length("payload") >= least_bytes).select("id", "digest")
    repeated = written(keys.groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).filter("n > 1"), "warc-repeated")
    heavy_at = keys.count() // HEAVY_SHARE + 2
    heavy = repeated.filter(F.col("n") >= heavy_at).select("digest", F.col("last").alias("heavy_last"), F.lit(True).alias("heavy"))
    light = repeated.filter(F.col("n") < heavy_at).select(F.col("digest").alias("key"), "last")
    small = F.octet_length("payload") < least_bytes
    out = pages.join(F.broadcast(heavy), "digest", "left")
    out = out.withColumn("key", F.when(small | F.col("heavy").isNotNull(), F.concat("digest", F.lit("-"), F.xxhash64("id").cast("string"))).otherwise(F.col("digest")))
    out = out.join(light, "key", "left")
    last = F.when(~small, F.coalesce("heavy_last", "last"))
    return out.select("id", "url", "payload", "digest", F.when(last.isNotNull() & ~F.col("id").eqNullSafe(last), last).alias("revisits"))


def record(page_id: str, url: str, payload: bytes, revisits: str | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    one_line = lambda s: s.replace("\r", "%0D").replace("\n", "%0A")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if revisits is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisits is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{revisits}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of a record, checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError("a payload differs from its digest")
    own = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">") if name in fields else None
    return {"id": own("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": own("WARC-Refers-To"), "digest": digest, "payload_bytes": length, "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (see `with_revisits`) below the URI ``folder``; the
    index, as a table written in the shared folder."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        out, at, rows, name = None, 0, [], ""

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["id", "archive", "offset", "length", "url", "digest", "record_type", "payload_bytes"])

        try:
            for batch in batches:
                for page, url, payload, digest, revisits in zip(*(batch.column(c) for c in ("id", "url", "payload", "digest", "revisits")), strict=True):
                    if out is None:
                        files.create_dir(root, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, at = files.open_output_stream(f"{root}/{name}", compression=None), 0
                    page, url, revisits, body = page.as_py(), url.as_py() or "", revisits.as_py(), (payload.as_py() or "").encode()
                    member = zlib.compressobj(1, wbits=31)
                    packed = member.compress(record("" if page is None else page, url, body, revisits, date)) + member.flush()
                    out.write(packed)
                    rows.append((page, name, at, len(packed), url, digest.as_py(), "response" if revisits is None else "revisit", len(body)))
                    at += len(packed)
                    if at >= ARCHIVE_BYTES:  # rows go out once their archive is closed
                        out.close()
                        out = None
                        yield batch_of(rows)
                        rows = []
            if out is not None:
                out.close()
                out = None
                yield batch_of(rows)
        finally:
            if out is not None:
                out.close()

    pages = pages.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.col("revisits").cast("string").alias("revisits"))
    return written(pages.mapInArrow(run, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str, keep_payload: bool = True) -> DataFrame:
    """The records of the selected ``index`` rows, by coalesced range reads."""
    schema = "id string, url string, record_type string, refers_to string, digest string, payload_bytes long" + ", payload string" * keep_payload
    names = ["id", "url", "record_type", "refers_to", "digest", "payload_bytes"] + ["payload"] * keep_payload

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        types = [pa.string()] * 5 + [pa.int64()] + [pa.string()] * keep_payload

        def read(group):
            archive, start = group[0][0], group[0][1]
            with files.open_input_file(f"{root}/{archive}") as source:
                raw = source.read_at(max(o + n for _, o, n in group) - start, start)
            found = [parse(zlib.decompress(raw[o - start: o - start + n], wbits=31)) for _, o, n in group]
            columns = [[(f["payload"].decode() if f["payload"] is not None else None) if c == "payload" else f[c] for f in found] for c in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        group = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if group and (row[0] != group[-1][0] or row[1] - group[-1][1] - group[-1][2] > GAP_BYTES or row[1] + row[2] - group[0][1] > READ_BYTES):
                    yield read(group)
                    group = []
                group.append(row)
        if group:
            yield read(group)

    # The index is tiny beside what it points at, so partitions are counted by
    # the bytes to be read, not by those of the index.
    size = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(n_partitions(index.sparkSession), int(size // TASK_BYTES) + 1)
    spread = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    folder = new_path(spark, "warc")
    index = write_archives(with_revisits(pages), folder)
    back = read_archives(index, folder, keep_payload=False)
    return back.select(
        F.expr("try_cast(id as bigint)").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        F.expr("try_cast(refers_to as bigint)").alias("refers_to"),
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS b, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, b AS payload_bytes, d AS payload_digest,
       CASE WHEN b >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 1000 AND page_id <> last THEN last END AS refers_to
FROM q
"""
