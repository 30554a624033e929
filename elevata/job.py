"""A folder of elevations from pixels to a workbook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.analysis import Analysis, analyse
from .operators.detect import detected_regions, image_levels
from .operators.geometry import facade_geometry
from .shared import written
from .sinks.documents import write_pages, write_workbooks
from .sources.formats import decoded_images, world_files

TOKENS = "image_id string, token_id long, text string, confidence double, x long, y long, w long, h long"


def folder_regions(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions of decoded images, numbered through, and the images that failed
    (image_id, error). Facades of photographs lose their socle's pixels."""
    stems = images.select("origin", "stem")
    found = detected_regions(images).join(stems.withColumnRenamed("origin", "image_id"), "image_id").drop("image_id").withColumnRenamed("stem", "image_id")
    found = written(found, "job-regions")
    failed = found.filter("error IS NOT NULL").select("image_id", "error")
    geometry = written(facade_geometry(images).withColumnRenamed("image_id", "origin").join(stems, "origin").select(F.col("stem").alias("image_id"), "facade_px", F.col("socle_px").alias("socle")), "job-geometry")
    rows = found.filter("error IS NULL").join(geometry, "image_id", "left")
    photo = (F.col("kind") == "facade") & (F.col("origin") == "photo") & F.col("facade_px").isNotNull()
    number = F.xxhash64("image_id").bitwiseAND(F.lit((1 << 47) - 1)) * 65536 + F.col("region_id")
    rows = rows.select("image_id", number.alias("region_id"), "kind", "label", *"xywh", F.when(photo, F.col("facade_px")).otherwise(F.col("area_px")).alias("area_px"), F.when(photo, F.col("socle")).otherwise(0).alias("socle_px"))
    return rows, failed


def analyse_folder(spark: SparkSession, folder: str, tokens: DataFrame | None = None, out: str | None = None, dpi: DataFrame | None = None) -> tuple[Analysis, DataFrame]:
    """The analysis of all images below ``folder``, and those that failed.

    Images go by their path below the folder, without suffix and lower-cased.
    World files beside them give scales. ``tokens``: texts that were read, as
    in `operators.analysis`; ``dpi``: image_id, dpi. With ``out`` (a URI that
    all executors can write to), workbooks, pictures and pages are written.
    """
    images = decoded_images(spark, folder)
    regions, failed = folder_regions(images)
    scales = world_files(spark, folder).select(F.col("stem").alias("image_id"), F.col("px_per_m").alias("manual_px_per_m"))
    known = image_levels(images).join(scales, "image_id", "left")
    known = known.join(dpi, "image_id", "left") if dpi is not None else known.withColumn("dpi", F.lit(None).cast("double"))
    done = analyse(written(known, "job-images"), tokens if tokens is not None else spark.createDataFrame([], TOKENS), regions)
    if out is not None:
        write_workbooks(done.facades, done.elements, f"{out}/workbooks").count()
        write_pages(images, f"{out}/pages").count()
    return done, failed
