"""Training-data pipeline over ``documents``: five filtering and coding stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All stages but the last return the columns of ``documents``; where a
stage changes a text, ``n_chars`` follows.

Defined results, in every stage: null ids, texts, languages and sources are
allowed; a null text is empty (and comes back empty where a stage rewrites
texts); texts are handled whole; further columns of the input are left out,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elevata.llm.bpe import bpe_encode, public_ranks
from elevata.llm.common import written
from elevata.llm.decontaminate import decontaminate, remove_spans
from elevata.llm.line_dedup import line_dedup
from elevata.llm.ngram_join import ngram_groups
from elevata.llm.quality import fit_quality, remainder, score_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field rejects (score under 0.5) go. Rows that
    repeat get one score, so all of them stay or go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = docs.select(*COLUMNS)
    field = fit_quality(docs, labels, train=remainder("doc_id", 3) != 1)
    return score_quality(docs, field).filter(F.col("quality_score") >= 0.5).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go. Rows that repeat count as
    documents of their own; a document that loses all its lines stays, empty."""
    return _counted(line_dedup(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: that with the
    smallest id (null ids last). Rows that share id and text are one document,
    and the smallest of their other columns stay; rows that share an id only
    are documents of their own. Texts without words are linked with nothing."""
    key = F.struct(
        F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.col("text").isNull().alias("bare"),
    )
    keyed = docs.select(*COLUMNS).withColumn("_key", key)
    groups = ngram_groups(keyed, id_col="_key")
    kept = groups.filter(F.col("_key") == F.col("component_id")).select("_key").distinct()
    one = keyed.join(kept, "_key").groupBy("_key").agg(F.first("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return one.select(F.when(~F.col("_key.none"), F.col("_key.id")).alias("doc_id"), "text", "rest.*").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts. Rows that repeat
    give equal rows."""
    found = decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _counted(remove_spans(found))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with digests of the ids and of what they decode to.
    Rows that repeat give equal rows; an empty text has no ids."""
    path, pattern = public_ranks()
    return bpe_encode(docs.select("doc_id", "text"), path, pattern, keep_ids=True, digests=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]

#: The quality stage is a fitted field, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
