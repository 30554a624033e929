"""Rules that annotations must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box

#: Tolerance in pixels of an element beyond its facade.
PARENT_SLACK = 20
#: Ranges of annotated sizes by kind (m2, m).
ANNOTATED_AREAS = {"facade": (1.0, 5000.0), "window": (0.15, 15.0), "door": (0.5, 6.5)}
ANNOTATED_WIDTHS = {"window": (0.2, 8.0), "door": (0.5, 5.0)}
ANNOTATED_HEIGHTS = {"window": (0.2, 5.0), "door": (1.4, 5.0)}


def _outside(size: str, table: dict[str, tuple[float, float]]) -> Column:
    rule = F.lit(False)
    for kind, (low, high) in table.items():
        rule = rule | ((F.col("kind") == kind) & ~F.col(size).between(low, high))
    return rule


def scale_reference_errors(references: DataFrame, images: DataFrame) -> DataFrame:
    """One row for each broken rule of a scale reference: file_id, ref_id,
    rule. ``references``: file_id, ref_id, type (linear or linear_from_ocr),
    ref_m, ref_px, value_m, x, y, w, h (null without a box)."""
    box = Box.of()
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    rules = {
        "not_positive": ((F.col("type") == "linear") & ~(positive("ref_m") & positive("ref_px"))) | ((F.col("type") == "linear_from_ocr") & ~positive("value_m")),
        "outside_image": box.x.isNotNull() & ~((box.x >= 0) & (box.y >= 0) & (box.w > 0) & (box.h > 0) & (box.right <= F.col("width")) & (box.bottom <= F.col("height"))),
    }
    rows = references.join(images.select("file_id", "width", "height"), "file_id")
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    return rows.select("file_id", "ref_id", F.explode(broken).alias("rule"))


def annotation_errors(items: DataFrame, images: DataFrame, strict: bool = False) -> DataFrame:
    """One row for each broken rule: file_id, item_id, rule.

    ``items``: file_id, item_id, kind, label, parent, x, y, w, h, area_m2,
    width_m, height_m; ``images``: file_id, width, height, n_scale_refs
    (linear ones). Sizes are held against the ranges of the item's kind; a
    parent must be known where the file has facades. Strict, a file with items
    must have a scale reference.
    """
    box = Box.of()
    parents = items.filter("kind = 'facade'").groupBy("file_id", "label").agg(F.min_by(F.struct(*"xywh"), "item_id").alias("pb"))
    parents = parents.select(F.col("file_id").alias("pf"), F.col("label").alias("pl"), "pb")
    has = items.groupBy("file_id").agg(F.max(F.col("kind") == "facade").alias("has_facades"))
    rows = items.join(images, "file_id").join(has, "file_id").join(parents, (F.col("file_id") == F.col("pf")) & (F.col("parent") == F.col("pl")), "left")
    p = Box.of(struct=F.col("pb"))
    child = F.col("kind") != "facade"
    far = (box.x < p.x - PARENT_SLACK) | (box.y < p.y - PARENT_SLACK) | (box.right > p.right + PARENT_SLACK) | (box.bottom > p.bottom + PARENT_SLACK)
    rules = {
        "empty_label": F.coalesce(F.trim("label"), F.lit("")) == "",
        "empty_box": (box.w <= 0) | (box.h <= 0),
        "outside_image": (box.x < 0) | (box.y < 0) | (box.right > F.col("width")) | (box.bottom > F.col("height")),
        "unknown_parent": child & (F.coalesce("parent", F.lit("")) != "") & F.col("pb").isNull() & F.col("has_facades"),
        "outside_parent": child & far,
        "area_out_of_range": _outside("area_m2", ANNOTATED_AREAS),
        "width_out_of_range": _outside("width_m", ANNOTATED_WIDTHS),
        "height_out_of_range": _outside("height_m", ANNOTATED_HEIGHTS),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    out = rows.select("file_id", "item_id", F.explode(broken).alias("rule"))
    if strict:
        out = out.unionByName(images.filter("n_scale_refs = 0").join(items.select("file_id").distinct(), "file_id", "left_semi").select("file_id", F.lit(-1).cast("long").alias("item_id"), F.lit("no_scale_reference").alias("rule")))
    return out


def reference_verdicts(checks: DataFrame) -> DataFrame:
    """VALID, WARNING or INVALID for each reference shape.

    ``checks``: id, x, y, w, h, width, height, area_px, same_size,
    n_bright (openings that look like bright wall).
    """
    box = Box.of()
    invalid = (box.x < 0) | (box.y < 0) | (box.right > F.col("width")) | (box.bottom > F.col("height")) | (F.col("area_px") < 1000)
    return checks.select("id", F.when(invalid, "INVALID").when(~F.col("same_size") | (F.col("n_bright") > 0), "WARNING").otherwise("VALID").alias("verdict"))


def validation_summary(errors: DataFrame, images: DataFrame) -> DataFrame:
    """One row: files that were checked, that broke a rule, and that passed."""
    failed = errors.select("file_id").distinct().withColumn("bad", F.lit(1))
    rows = images.select("file_id").distinct().join(failed, "file_id", "left")
    return rows.agg(F.count("*").alias("n_files"), F.count("bad").alias("n_failed"), (F.count("*") - F.count("bad")).alias("n_passed"))
