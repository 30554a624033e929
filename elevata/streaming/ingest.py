"""Continuous ingestion: an extension, the product itself has no streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.report import facade_report


def arriving_elements(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Element rows as their Parquet files arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def reports_by_batch(elements: DataFrame, facades: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The report of each micro-batch's facades, to a sink that must accept a
    batch twice (its number tells)."""
    def batch(rows: DataFrame, number: int) -> None:
        touched = rows.select("facade_id").distinct()
        sink(facade_report(facades.join(touched, "facade_id", "left_semi"), rows), number)

    return elements.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(elements: DataFrame) -> DataFrame:
    """Carpentry area by facade, kept up to date."""
    return elements.groupBy("facade_id").agg(F.sum(F.col("w_cm") * F.col("h_cm")).alias("carpentry_cm2"), F.count("*").alias("n"))


def counted_events(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type and time window, late ones accepted for a while."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
