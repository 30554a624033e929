"""Corpus-wide removal of repeated lines, in DataFrame functions only.

Normalised lines are exploded and hashed, documents are counted once per
hash, lines at or over the threshold go, and each document is put together
again by line position.

Defined results: a null or empty text is one empty line; keys shorter than
``min_chars`` code points never go (an empty key never does); a document
counts once per key, however often it repeats the line; rows that repeat as
a whole count as documents of their own and get equal results; null ids are
allowed; an empty table gives an empty table. All input columns are kept,
``text`` replaced.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, free_name, written

#: A key with at least one in so many of all (document, key) pairs is heavy.
#: No more than this many keys can be, whatever the size of the corpus.
HEAVY_SHARE = 1000


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its frequent lines, plus ``n_lines`` and ``n_dropped``.

    The names of the two added columns get underscores where they clash.
    """
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    columns = docs.columns
    tid, th, tgone, tdone = (free_name(docs, f"_ld_{x}") for x in ("id", "hash", "gone", "done"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n", -1)

    # The keys of a document's lines, in order and null where a line always
    # stays: worked out once, written, and read for counts and for positions.
    def key_of(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= max(1, min_chars), F.md5(key))

    keyed = written(docs.select(F.col(id_col).alias(tid), F.xxhash64(text).alias(th), F.transform(lines, key_of).alias("keys")), "line-keys")

    each = keyed.select(F.explode(F.array_distinct("keys")).alias("key")).filter(F.col("key").isNotNull())
    frequent = written(each.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs), "line-counts")
    # Heavy keys (a bounded number) are matched as literals, so that no key
    # with a large share of the rows meets in one task; the rest are joined.
    total = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    heavy_at = max(min_docs, total // HEAVY_SHARE + 1)
    heavy = [r[0] for r in frequent.filter(F.col("n") >= heavy_at).select("key").collect()]
    rest = frequent.filter(F.col("n") < heavy_at).select("key")

    at = keyed.select(tid, th, F.posexplode("keys").alias("pos", "key")).filter(F.col("key").isNotNull())
    is_heavy = F.col("key").isin(heavy) if heavy else F.lit(False)
    light = at.filter(~is_heavy).join(rest, "key", "left_semi")
    gone = at.filter(is_heavy).select(tid, th, "pos").union(light.select(tid, th, "pos"))
    gone = gone.groupBy(tid, th).agg(F.sort_array(F.collect_set("pos")).alias(tgone))
    gone = gone.withColumnsRenamed({tid: tid + "g", th: th + "g"})

    # Runs of kept lines between neighbouring dropped positions.
    joined = docs.withColumn(th, F.xxhash64(text)).join(gone, F.col(id_col).eqNullSafe(F.col(tid + "g")) & (F.col(th) == F.col(th + "g")), "left")
    # Lines and bounds are arguments of lambdas, so that no rule of the
    # optimiser can have them worked out again for each run.
    def assembled(ls: Column, bounds: Column) -> Column:
        run = lambda i: F.slice(ls, F.get(bounds, i) + 2, F.get(bounds, i + 1) - F.get(bounds, i) - 1)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), run)), "\n")

    def result(ls: Column) -> Column:
        bounds = F.concat(F.array(F.lit(-1)), F.col(tgone), F.array(F.size(ls)))
        kept = F.when(F.col(tgone).isNull(), text).otherwise(_let(bounds, lambda bs: assembled(ls, bs)))
        return F.struct(F.size(ls).cast("long").alias("n"), kept.alias("kept"))

    joined = joined.withColumn(tdone, _let(lines, result)).withColumn(n_dropped, F.coalesce(F.size(tgone), F.lit(0)).cast("long"))
    return joined.withColumns({n_lines: F.col(f"{tdone}.n"), text_col: F.col(f"{tdone}.kept")}).select(*columns, n_lines, n_dropped)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT r, doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line
  FROM (SELECT *, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
        FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents))
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
