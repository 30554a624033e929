"""Readers and parsers of annotations, world files, manifests, predictions."""

from __future__ import annotations

import re
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import config
from ..functions.text import let

IMAGE_GLOB = "*.{png,jpg,jpeg,bmp,tiff,tif,PNG,JPG,JPEG,BMP,TIFF,TIF}"


def file_stem(path: Column, folder: str) -> Column:
    """Path of a file below ``folder``, without its last suffix and
    lower-cased, so that equal names in two folders stay apart."""
    root = urlparse(folder).path.rstrip("/") + "/"
    below = F.element_at(F.split(path, re.escape(root), 2), -1)
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_replace(F.when(F.contains(path, F.lit(root)), below).otherwise(name), r"\.[^./]*$", ""))


def image_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, stem, length, content of the images of a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return rows.select("path", file_stem(F.col("path"), folder).alias("stem"), "length", "content")


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded rows (BGR bytes); those that cannot be decoded have ``error``."""
    rows = spark.read.format("image").option("pathGlobFilter", IMAGE_GLOB).option("recursiveFileLookup", "true").load(folder).select("image.*")
    return rows.withColumn("stem", file_stem(F.col("origin"), folder)).withColumn("error", F.when(F.col("height") < 0, "cannot be decoded"))


def worldfile_scale(text: Column) -> Column:
    """Struct of px_per_m and axis_difference from a world file's text: the
    first and fourth line are metres a pixel; null where it has fewer than
    six lines or no size."""
    lines = F.split(F.replace(F.btrim(text, F.lit(" \n\r\t")), F.lit(","), F.lit(".")), r"\r?\n")
    size = lambda ls, i: F.abs(F.trim(F.get(ls, F.lit(i))).try_cast("double"))

    def read(ls: Column) -> Column:
        return F.struct(F.coalesce(size(ls, 0), F.lit(0.0)).alias("a"), F.coalesce(size(ls, 3), F.lit(0.0)).alias("e"), F.size(ls).alias("n"))

    def scale(s: Column) -> Column:
        metres = F.when((s["a"] > 0) & (s["e"] > 0), (s["a"] + s["e"]) / 2).otherwise(F.greatest(s["a"], s["e"]))
        fine = (s["n"] >= 6) & (metres > 0)
        return F.when(fine, F.struct(F.when(metres > 0, 1 / metres).alias("px_per_m"), F.when(metres > 0, F.abs(s["a"] - s["e"]) / F.greatest(s["a"], s["e"])).alias("axis_difference")))

    return let(let(lines, read), scale)


def world_files(spark: SparkSession, folder: str) -> DataFrame:
    """stem, px_per_m, axis_difference: the first valid world file of each
    image, ``.pgw`` before ``.pngw`` before ``.jgw`` before ``.wld``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pgw,pngw,jgw,wld}").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    order = F.array_position(F.array(*map(F.lit, ("pgw", "pngw", "jgw", "wld"))), suffix)
    rows = rows.select(file_stem(F.col("path"), folder).alias("stem"), order.alias("order"), worldfile_scale(F.col("content").cast("string")).alias("s")).filter("s IS NOT NULL")
    return rows.groupBy("stem").agg(F.min_by("s", "order").alias("s")).select("stem", "s.*")


#: Schema of ground-truth files; areas go by two names in either dialect.
TRUTH = "image_file string, sample_id string, " + ", ".join(
    f"{kind} array<struct<name:string,label:string,type:string,parent_facade:string,bbox:array<int>,area_m2:double,total_area_m2:double,area:double>>" for kind in ("facades", "windows", "doors", "socles")
)


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """stem, kind, ord, label, x, y, w, h, area_m2 of all boxes."""
    rows = spark.read.schema(TRUTH).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder).withColumn("stem", file_stem(F.url_decode(F.col("_metadata.file_path")), folder))
    kinds = [(k[:-1], F.col(k)) for k in ("facades", "windows", "doors", "socles")]
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.array().cast("array<struct<name:string,label:string,type:string,parent_facade:string,bbox:array<int>,area_m2:double,total_area_m2:double,area:double>>")).alias("items")) for k, c in kinds))
    rows = rows.select("stem", F.explode(every).alias("k")).select("stem", "k.kind", F.posexplode("k.items").alias("ord", "i"))
    box = [F.get("i.bbox", F.lit(j)).alias(c) for j, c in enumerate("xywh")]
    return rows.filter(F.size("i.bbox") == 4).select("stem", "kind", "ord", F.coalesce("i.label", "i.name").alias("label"), *box, F.coalesce("i.total_area_m2", "i.area_m2", "i.area", F.lit(0.0)).alias("area_m2"))


VOC = "filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def voc_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of Pascal VOC files: stem, width, height, ord, name, x, y, w, h;
    objects without a name or a box are left out."""
    rows = spark.read.format("xml").option("rowTag", "annotation").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").schema(VOC).load(folder)
    rows = rows.withColumn("stem", file_stem(F.url_decode(F.col("_metadata.file_path")), folder)).select("stem", "size.width", "size.height", F.posexplode("object").alias("ord", "o"))
    b = F.col("o.bndbox")
    rows = rows.filter((F.coalesce(F.trim("o.name"), F.lit("")) != "") & b["xmin"].isNotNull())
    return rows.select("stem", "width", "height", "ord", F.trim("o.name").alias("name"), b["xmin"].alias("x"), b["ymin"].alias("y"), F.greatest(b["xmax"] - b["xmin"], F.lit(0.0)).alias("w"), F.greatest(b["ymax"] - b["ymin"], F.lit(0.0)).alias("h"))


def label_json(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of centre-based label files, as top-left boxes."""
    schema = "annotations array<struct<label:string,coordinates:struct<x:double,y:double,width:double,height:double>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(folder)
    rows = rows.withColumn("stem", file_stem(F.url_decode(F.col("_metadata.file_path")), folder)).select("stem", F.posexplode("annotations").alias("ord", "a"))
    c = F.col("a.coordinates")
    return rows.select("stem", "ord", F.col("a.label").alias("name"), (c["x"] - c["width"] / 2).alias("x"), (c["y"] - c["height"] / 2).alias("y"), c["width"].alias("w"), c["height"].alias("h"))


def yolo_labels(spark: SparkSession, folder: str, classes: dict[int, int] | None = None) -> DataFrame:
    """Lines of label files: stem, class_id, rest of the line. ``classes``
    maps ids to ours; others are dropped."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder).withColumn("stem", file_stem(F.url_decode(F.col("_metadata.file_path")), folder))
    parts = F.split(F.trim("value"), r"\s+", 2)
    rows = rows.filter(F.size(F.split(F.trim("value"), r"\s+")) >= 5).select("stem", F.get(parts, F.lit(0)).try_cast("int").alias("class_id"), F.get(parts, F.lit(1)).alias("rest")).filter("class_id IS NOT NULL")
    if classes is None:
        return rows
    table = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair)) if classes else F.lit(None)
    return rows.withColumn("class_id", F.element_at(table, F.col("class_id")) if classes else F.lit(None)).filter("class_id IS NOT NULL")


def class_map(names: list[str]) -> dict[int, int]:
    """Ids of a ``classes.txt`` to ours; a class that we need must be in it."""
    ours = ["facade", "window", "door", "socle"]
    found = {i: ours.index(n.strip().lower()) for i, n in enumerate(names) if n.strip().lower() in ours}
    if missing := [n for i, n in enumerate(ours) if i not in found.values()]:
        raise ValueError(f"classes without: {', '.join(missing)}")
    return found


def class_id(name: Column) -> Column:
    """Our id of a class name in either language; an error where unknown."""
    table = F.create_map(*(F.lit(x) for pair in config.CLASS_IDS.items() for x in pair))
    key = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(table, key), F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(key, F.lit("null")))).cast("int"))


def best_annotations(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Boxes of each image from its first source that has any; ``sources``:
    (name, frame with ``stem``), the best first."""
    rows = None
    for i, (name, frame) in enumerate(sources):
        own = frame.withColumns({"source": F.lit(name), "_order": F.lit(i)})
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    least = F.min("_order").over(Window.partitionBy("stem"))
    return rows.withColumn("_least", least).filter("_order = _least").drop("_order", "_least")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios of a manifest; a byte-order mark is skipped."""
    case = "struct<id:string,owner:string,scene_class:string,raw_path:string,world_file_path:string,reference_json_path:string,expected:struct<scene_type:string,facades:int,windows:int,doors:int,socles:int,min_windows:int,min_doors:int>,focus:array<string>>"
    text = F.regexp_replace("value", "^﻿", "")
    rows = spark.read.option("wholetext", "true").text(path).select(F.from_json(text, f"struct<scenarios:array<{case}>>").alias("m"), F.from_json(text, f"array<{case}>").alias("l"))
    return rows.select(F.explode(F.coalesce("m.scenarios", "l")).alias("c")).select("c.*")


#: What other names of predicted classes mean.
PREDICTED = {"facade": "facade", "fatada": "facade", "wall": "facade", "window": "window", "fereastra": "window", "door": "door", "usa": "door", "ușa": "door", "socle": "socle", "soclu": "socle"}


def predictions_to_regions(predictions: DataFrame) -> DataFrame:
    """Regions with numbered labels from predicted boxes; unknown classes go
    by their id, empty boxes are skipped.

    ``predictions``: image_id, pred_id, class_name, class_id, x0, y0, x1, y1.
    """
    table = F.create_map(*(F.lit(x) for pair in PREDICTED.items() for x in pair))
    by_id = F.element_at(F.array(F.lit("facade"), F.lit("window"), F.lit("door")), (F.col("class_id") % 3 + 1).cast("int"))
    rows = predictions.withColumn("kind", F.coalesce(F.try_element_at(table, F.lower("class_name")), by_id)).filter("x1 > x0 AND y1 > y0")
    stem = F.when(F.col("kind") == "facade", "FATADA_").when(F.col("kind") == "window", "F_").when(F.col("kind") == "door", "U_").otherwise("SOCLU_")
    rank = F.row_number().over(Window.partitionBy("image_id", "kind").orderBy("pred_id"))
    return rows.select("image_id", "pred_id", "kind", F.concat(stem, rank.cast("string")).alias("label"), F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))


def manual_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows entered by hand: facade, kind, label, area_m2, missing as 0."""
    schema = T.StructType([T.StructField("facade", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("label", T.StringType()), T.StructField("area_m2", T.DoubleType())])
    return spark.createDataFrame([(r.get("facade"), r.get("kind"), r.get("label"), float(r.get("area_m2") or 0)) for r in rows], schema)


#: Schema of a reference shape: boxes and contours, or areas of openings.
REFERENCE = (
    "reference_id string, scene string, image_size array<double>, targets struct<facade_bbox:array<double>,socle_bbox:array<double>,facade_contour:array<array<double>>,socle_contour:array<array<double>>,"
    "window_boxes:array<array<double>>,door_boxes:array<array<double>>,facade_net_area_m2:double,socle_area_m2:double,openings:array<struct<id:string,type:string,target_area_m2:double,notes:string>>>"
)


def reference_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Reference shapes of a folder: stem, reference_id, scene, width, height
    and the targets; a byte-order mark is skipped, missing fields are null."""
    rows = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder).withColumn("stem", file_stem(F.url_decode(F.col("_metadata.file_path")), folder))
    rows = rows.withColumn("r", F.from_json(F.regexp_replace("value", "^\ufeff", ""), REFERENCE)).filter("r.targets IS NOT NULL")
    return rows.select("stem", "r.reference_id", "r.scene", F.get("r.image_size", F.lit(0)).alias("width"), F.get("r.image_size", F.lit(1)).alias("height"), "r.targets.*")


BOXES = "array<struct<x:double,y:double,w:double,h:double>>"


def baseline_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of the cases of an earlier regression report: case_id, kind, ord,
    x, y, w, h. The cases stand below ``cases`` or are the whole file."""
    case = f"struct<id:string,facades:{BOXES},windows:{BOXES},doors:{BOXES},socles:{BOXES}>"
    text = F.regexp_replace("value", "^\ufeff", "")
    rows = spark.read.option("wholetext", "true").text(path).select(F.from_json(text, f"struct<cases:array<{case}>>").alias("m"), F.from_json(text, f"array<{case}>").alias("l"))
    rows = rows.select(F.explode(F.coalesce("m.cases", "l")).alias("c"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(f"c.{k}s"), F.array().cast(BOXES)).alias("boxes")) for k in ("facade", "window", "door", "socle")))
    return rows.select(F.col("c.id").alias("case_id"), F.explode(kinds).alias("k")).select("case_id", "k.kind", F.posexplode("k.boxes").alias("ord", "b")).select("case_id", "kind", "ord", "b.*")
