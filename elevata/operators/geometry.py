"""Facade and socle geometry, clips, attachments and scaled reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions.boxes import Box, iou, overlap_x
from . import kernels as K


def scaled_report(facades: DataFrame, elements: DataFrame) -> DataFrame:
    """Lengths of each facade in metres from pixels.

    ``facades``: facade_id, px_per_m, w, h, socle_w (null where none);
    ``elements``: facade_id, kind, width_m, height_m (null where not known),
    w, h. Corners count where 0.2 to 200 m, socles where 0.2 to 500 m, and
    elements whose width is plausible for their kind.
    """
    scale = facades.select("facade_id", "px_per_m")
    rows = elements.join(scale, "facade_id", "left")
    low, high = (F.when(F.col("kind") == "window", config.WIDTH_BOUNDS["window"][i]).otherwise(config.WIDTH_BOUNDS["door"][i]) for i in (0, 1))
    width = F.when(F.col("width_m") > 0, F.col("width_m")).otherwise(F.col("w") / F.col("px_per_m"))
    height = F.when(F.col("height_m") > 0, F.col("height_m")).otherwise(F.col("h") / F.col("px_per_m"))
    # Whole micrometres, so that sums do not depend on their order.
    micro = lambda c: F.floor(c * 1e6 + 0.5).cast("long")
    rows = rows.withColumns({"mw": F.when(width.between(low, high), micro(width)), "mh": F.when(height > 0, micro(height))})
    mw, mh, window = F.col("mw"), F.col("mh"), F.col("kind") == "window"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = rows.groupBy("facade_id").agg(
        total(F.when(window, mw)).alias("sill"), total(mw).alias("drip"), total(F.when(window, 2 * (mw + mh))).alias("window_perimeter"), total(F.when(~window, 2 * mh + mw)).alias("door_perimeter"),
    )
    names = ["sill", "drip", "window_perimeter", "door_perimeter"]
    out = facades.join(sums, "facade_id", "left").na.fill(0, names)
    corner, socle = 2 * F.col("h") / F.col("px_per_m"), F.coalesce("socle_w", "w") / F.col("px_per_m")
    kept = lambda c, most: F.coalesce(F.when(c.between(0.2, most), F.floor(c * 1000 + 0.5) / 1000.0), F.lit(0.0))
    return out.select("facade_id", kept(corner, 200).alias("corner_m"), kept(socle, 500).alias("socle_drip_m"), *((F.floor((F.col(n) + 500) / 1000) / 1000.0).alias(f"{n}_m") for n in names))


def values_near_points(points: DataFrame, values: DataFrame, distance: float, most: float) -> DataFrame:
    """The best value near each point: nearest, areas preferred (their
    distance counts 0.8)."""
    v = values.select("image_id", F.col("token_id").alias("value_id"), "value", "unit", F.col("cx").alias("vx"), F.col("cy").alias("vy")).filter(F.col("value").between(0.01, most))
    dx, dy = F.col("px") - F.col("vx"), F.col("py") - F.col("vy")
    rows = points.join(v, "image_id").withColumn("d", F.sqrt((dx * dx + dy * dy).cast("double"))).filter(F.col("d") <= distance)
    score = F.col("d") * F.when(F.col("unit") == "m²", 0.8).otherwise(1.0)
    return rows.groupBy("point_id").agg(F.min_by("value", F.struct(score.alias("s"), "value_id")).alias("value"))


def nearest_parent(regions: DataFrame, facades: DataFrame) -> DataFrame:
    """The first facade that holds a region's centre, else the one whose own
    centre is nearest, else the parent that the region has."""
    f = facades.select("image_id", "facade_id", *(F.col(c).alias("f" + c) for c in "xywh"))
    box, own = Box.of("f"), Box.of()
    inside = box.holds(own.ix, own.iy)
    dx, dy = own.ix - box.ix, own.iy - box.iy
    far = F.when(inside, F.lit(0.0)).otherwise((dx * dx + dy * dy).cast("double"))
    rank = F.struct((~inside).alias("out"), far.alias("far"), "facade_id")
    best = regions.join(f, "image_id").groupBy("region_id").agg(F.min(rank).alias("b"), F.first("parent").alias("parent"))
    chosen = F.when(F.col("b.out") & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("b.facade_id"))
    return best.select("region_id", chosen.alias("facade_id"))


def without_overlaps(regions: DataFrame, others: DataFrame, most: float) -> DataFrame:
    """Regions that overlap none of the others of their image by more."""
    o = others.select(F.col("image_id").alias("oi"), *(F.col(c).alias("o" + c) for c in "xywh"))
    return regions.join(o, (F.col("image_id") == F.col("oi")) & (iou(Box.of(), Box.of("o")) > most), "left_anti")


def clipped_openings(openings: DataFrame) -> DataFrame:
    """Openings cut where they reach too low: doors of flat scenes at the
    socle line (``socle_y`` at their centre, null where none) if 60 % stay,
    openings of composite scenes at the facade's bottom if 30 % and 40 px
    stay."""
    o = Box.of()
    flat, stepped = F.col("scene") == "flat_long_facade", F.col("scene") == "composite_stepped_facade"
    at_socle, at_bottom = F.col("socle_y") - F.col("y"), F.col("fy") + F.col("fh") - F.col("y")
    cut = (
        F.when(flat & (F.col("kind") == "door") & (o.bottom > F.col("socle_y") + 1) & (at_socle >= F.bround(F.col("h") * 0.60)), at_socle)
        .when(stepped & (o.bottom > F.col("fy") + F.col("fh")) & (at_bottom >= F.bround(F.col("h") * 0.30)) & (at_bottom >= 40), at_bottom)
        .otherwise(F.col("h"))
    )
    return openings.withColumn("h", cut.cast("long")).withColumn("area_px", F.col("w") * F.col("h"))


def detection_rows(facades: DataFrame, elements: DataFrame) -> DataFrame:
    """Facades, openings, socles (the lowest tenth where none is known) and
    perimeters as rows of one table: kind, owner_id, x, y, w, h, length_px."""
    none = F.lit(None).cast("long")
    box = [F.col(c).cast("long").alias(c) for c in "xywh"]
    f = facades.select(F.lit("facade").alias("kind"), F.col("facade_id").alias("owner_id"), *box, none.alias("length_px"))
    low = F.greatest(F.floor(F.col("h") * 0.10), F.lit(1))
    socle = facades.select(F.lit("socle").alias("kind"), F.col("facade_id").alias("owner_id"), F.col("x").cast("long").alias("x"), (F.col("y") + F.col("h") - low).cast("long").alias("y"), F.col("w").cast("long").alias("w"), low.cast("long").alias("h"), F.col("w").cast("long").alias("length_px"))
    o = elements.select("kind", F.col("element_id").alias("owner_id"), *box, F.when(F.col("kind") == "window", 2 * (F.col("w") + F.col("h"))).otherwise(2 * F.col("h") + F.col("w")).cast("long").alias("length_px"))
    return f.unionByName(socle).unionByName(o)


def valid_sketches(shapes: DataFrame) -> DataFrame:
    """Drawn shapes that count (rectangles of 8 px at least, polygons of
    three points and 500 px2), numbered by kind; of facades only the last one
    of an image stays."""
    rectangle = (F.col("shape") == "rectangle") & (F.col("w") >= 8) & (F.col("h") >= 8)
    polygon = (F.col("shape") == "polygon") & (F.col("n_points") >= 3) & (F.col("area_px") >= 500)
    rows = shapes.filter(rectangle | polygon)
    last = F.row_number().over(Window.partitionBy("image_id", "kind").orderBy(F.desc("shape_id")))
    rows = rows.withColumn("last", last).filter((F.col("kind") != "facade") | (F.col("last") == 1))
    rank = F.row_number().over(Window.partitionBy("image_id", "kind").orderBy("shape_id"))
    stem = F.when(F.col("kind") == "facade", "FATADA_MANUAL_").when(F.col("kind") == "window", "F_").when(F.col("kind") == "door", "U_").otherwise("ZL_")
    return rows.select("image_id", "shape_id", "kind", F.concat(stem, rank.cast("string")).alias("label"))


def merged_sources(sketch: DataFrame, detected: DataFrame) -> DataFrame:
    """Sketched regions alone where an image has a sketched facade; else the
    detected ones and the sketched openings."""
    drawn = sketch.filter("kind = 'facade'").select("image_id").distinct()
    return sketch.unionByName(detected.join(drawn, "image_id", "left_anti"))


def row_band(windows: DataFrame) -> DataFrame:
    """Common top, bottom and height of the windows of a facade (three at
    least) that stand in one row."""
    bottom, p = F.col("y") + F.col("h"), lambda c, q: F.percentile(c, F.lit(q))
    s = windows.groupBy("facade_id").agg(
        F.count("*").alias("n"), F.bround(F.median("y")).cast("long").alias("top"), F.bround(F.median(bottom)).cast("long").alias("bottom"), F.bround(F.median("h")).cast("long").alias("height"),
        (p(F.col("y"), 0.75) - p(F.col("y"), 0.25)).alias("ti"), (p(bottom, 0.75) - p(bottom, 0.25)).alias("bi"),
    )
    spread = F.greatest(F.lit(18.0), F.col("height") * 0.35)
    return s.filter((F.col("n") >= 3) & (F.col("bottom") > F.col("top")) & (F.col("ti") <= spread) & (F.col("bi") <= spread * 1.10)).select("facade_id", "top", "bottom", "height")


def attached(base: Box, other: Box) -> Column:
    """Whether a volume is attached to the top of a base body."""
    wide, tall = other.w / base.w, other.h / base.h
    above = other.y < base.y - F.greatest(F.lit(16), F.bround(base.h * 0.04))
    touch = other.bottom >= base.y - F.greatest(F.lit(20), F.bround(base.h * 0.14))
    return wide.between(0.10, 0.78) & tall.between(0.16, 0.98) & (overlap_x(base, other) >= F.least(base.w, other.w) * 0.45) & above & touch


def united(regions: DataFrame, most_iou: float = 0.35) -> DataFrame:
    """Overlapping facades of an image as unions, numbered from the top."""
    item = F.struct(F.col("y").cast("long").alias("y"), *(F.col(c).cast("long").alias(c) for c in "xwh"), F.col("region_id").cast("long").alias("id"))
    rows = regions.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("rs"))
    none = F.array().cast("array<struct<y:bigint,x:bigint,w:bigint,h:bigint,id:bigint>>")

    def clash(a: Column, b: Column) -> Column:
        p, q = Box.of(struct=a), Box.of(struct=b)
        holds = lambda s, t: (s.x <= t.x) & (s.y <= t.y) & (s.right >= t.right) & (s.bottom >= t.bottom)
        return (iou(p, q) > most_iou) | holds(p, q) | holds(q, p)

    def join(a: Column, b: Column) -> Column:
        p, q = Box.of(struct=a), Box.of(struct=b)
        x, y = F.least(p.x, q.x), F.least(p.y, q.y)
        return F.struct(y.alias("y"), x.alias("x"), (F.greatest(p.right, q.right) - x).alias("w"), (F.greatest(p.bottom, q.bottom) - y).alias("h"), F.least(a["id"], b["id"]).alias("id"))

    def add(kept: Column, r: Column) -> Column:
        whole = F.aggregate(F.filter(kept, lambda k: clash(k, r)), r, join)
        return F.concat(F.filter(kept, lambda k: ~clash(k, r)), F.array(whole))

    done = rows.select("image_id", F.posexplode(F.array_sort(F.aggregate("rs", none, add))).alias("i", "r"))
    return done.select("image_id", F.concat(F.lit("FATADA_AUTO_"), (F.col("i") + 1).cast("string")).alias("label"), "r.x", "r.y", "r.w", "r.h")


def geometry_warnings(cases: DataFrame) -> DataFrame:
    """One row for each doubt about a case's geometry.

    ``cases``: case_id, image_w, scene, x, y, w, left_offset, right_offset,
    facade_to_line, and IoUs by class (null where there is no reference).
    """
    c, edge = F.col, F.greatest(F.lit(4), F.bround(F.col("image_w") * 0.005))
    rules = {
        "side_at_border": (c("x") <= edge) | (c("x") + c("w") >= c("image_w") - edge), "top_at_border": c("y") <= edge,
        "socle_outside": (c("left_offset") > 5) | (c("right_offset") > 5), "below_socle": c("facade_to_line") > 18,
        "gable_cut": (c("scene") == "gable_facade") & (c("w") < F.floor(c("image_w") * 0.45)),
    } | {f"{k}_iou_low": c(f"{k}_iou") < least for k, least in config.IOU_FLOORS.items()}
    found = F.filter(F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items())), lambda n: n.isNotNull())
    return cases.select("case_id", F.explode(found).alias("warning"))


def scaled_box(box: Box, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    """A box moved between image sizes; a pixel wide and tall at least."""
    whole = lambda c: F.bround(c).cast("long")
    return F.struct(whole(box.x * to_w / from_w).alias("x"), whole(box.y * to_h / from_h).alias("y"), F.greatest(whole(box.w * to_w / from_w), F.lit(1)).alias("w"), F.greatest(whole(box.h * to_h / from_h), F.lit(1)).alias("h"))


def wide_enough(facade: Box, box: Box) -> Column:
    """Width gate of photographed windows."""
    share = box.w / facade.w
    return (share >= 0.020) & ((share >= 0.035) | (box.h / facade.h >= 0.16))


def fitted_lines(points: DataFrame, percent: float = 35.0) -> DataFrame:
    """A straight line through the upper points of each contour (y up to the
    percentile), by least squares: slope, intercept, number of points."""
    cut = points.groupBy("contour_id").agg(F.percentile("y", F.lit(percent / 100)).alias("cut"))
    upper = points.join(cut, "contour_id").filter(F.col("y") <= F.col("cut"))
    return upper.groupBy("contour_id").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")).filter("n >= 6 AND slope IS NOT NULL")


def inferred_facades(openings: DataFrame, margin: int = 40) -> DataFrame:
    """Facades inferred from rows of openings: a wide gap along x (over
    max(220, 3 widths)) splits a row; boxes with margins, 120 x 90 at least.

    ``openings``: image_id, row, region_id, x, y, w, h.
    """
    order = Window.partitionBy("image_id", "row").orderBy("x", "region_id")
    reach = F.max(F.col("x") + F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("x") - reach > F.greatest(F.lit(220), 3 * F.col("w"))), 1).otherwise(0)
    parts = openings.withColumn("b", begins).withColumn("part", F.sum("b").over(order).cast("int"))
    x, y = F.min("x") - margin, F.min("y") - margin
    boxes = parts.groupBy("image_id", "row", "part").agg(F.greatest(x, F.lit(0)).cast("long").alias("x"), F.greatest(y, F.lit(0)).cast("long").alias("y"), (F.max(F.col("x") + F.col("w")) + margin).alias("r"), (F.max(F.col("y") + F.col("h")) + margin).alias("b"))
    return boxes.select("image_id", "row", "part", "x", "y", F.greatest(F.col("r") - F.col("x"), F.lit(120)).cast("long").alias("w"), F.greatest(F.col("b") - F.col("y"), F.lit(90)).cast("long").alias("h"))


# --- inside one Python stage, per facade ---------------------------------

def socle_cut(image: np.ndarray, mask: np.ndarray) -> int | None:
    """Row where a socle begins: the strongest level edge in the lower part
    of a grey facade, if it stands out and leaves a plausible band."""
    height = len(mask)
    _, gy = K.gradients(image)
    strength = np.where(mask, np.abs(gy), 0).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
    a, b = int(height * 0.58), int(height * 0.96)
    if b - a < 3:
        return None
    zone = strength[a:b]
    peak = a + int(zone.argmax())
    band = (height - peak) / height
    if zone.max() < 1.22 * max(float(np.median(strength[strength > 0])) if (strength > 0).any() else 0.0, 1.0) or not 0.04 <= band <= 0.30:
        return None
    return peak


def edge_line(profile: np.ndarray, most_slope: float = 0.12) -> np.ndarray:
    """A profile's straight line, by least squares on the columns within the
    interquartile range, its slope limited."""
    at = np.flatnonzero(profile >= 0)
    if len(at) < 2:
        return profile.astype(float)
    y = profile[at].astype(float)
    low, high = np.percentile(y, [25, 75])
    near = (y >= low - 14) & (y <= high + 14)
    slope, level = np.polyfit(at[near], y[near], 1) if near.sum() >= 2 and np.ptp(at[near]) > 0 else (0.0, float(np.median(y)))
    slope = float(np.clip(slope, -most_slope, most_slope))
    middle = float(at[near].mean()) if near.any() else 0.0
    level = float(y[near].mean()) if near.any() else float(np.median(y))
    return level + slope * (np.arange(len(profile)) - middle)


def band_between(mask: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """The part of a mask from a top profile down to its last row."""
    rows = np.arange(len(mask))[:, None]
    return mask & (rows >= np.rint(np.maximum(tops, 0))[None, :])


def gable_peak(profile: np.ndarray) -> float:
    """How much higher the middle of a top profile is than its ends."""
    y = profile[profile >= 0].astype(float)
    if len(y) < 8:
        return 0.0
    n = max(4, int(len(y) * 0.18))
    a = int(len(y) * 0.35)
    return float(np.median(np.concatenate([y[:n], y[-n:]])) - np.median(y[a: max(a + 4, int(len(y) * 0.65))]))


def profile_statistics(mask: np.ndarray) -> dict[str, float]:
    """What scene classes are decided on, from a facade's mask."""
    top, _ = K.profiles(mask)
    y = top[top >= 0]
    if not len(y):
        return {"n_columns": 0, "top_iqr": 0.0, "top_span": 0.0, "gable_peak": 0.0}
    q = np.percentile(y, [5, 25, 75, 95])
    return {"n_columns": len(y), "top_iqr": float(q[2] - q[1]), "top_span": float(q[3] - q[0]), "gable_peak": gable_peak(top)}


SOCLES = "image_id string, facade_px long, socle_px long, socle_y long, n_columns long, top_iqr double, top_span double, gable_peak double"


def facade_geometry(images: DataFrame) -> DataFrame:
    """Profile statistics, area and socle of each image's main facade; images
    without one give no row."""
    from .detect import photo_facade

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for name, height, width, channels, data in zip(batch["origin"], batch["height"], batch["width"], batch["nChannels"], batch["data"], strict=True):
                if height <= 0 or channels != 3:
                    continue
                bgr = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                found = photo_facade(bgr)
                if found is None:
                    continue
                x, y, w, h, _ = found
                g = K.gray(bgr)
                mask = K.filled((g < K.border_percentile(g, 65.0) - 10)[y: y + h, x: x + w])
                cut = socle_cut(g[y: y + h, x: x + w], mask)
                socle = band_between(mask, np.full(w, cut)) if cut is not None else np.zeros_like(mask)
                if socle.sum() > 0.5 * mask.sum():
                    cut, socle = None, np.zeros_like(mask)
                s = profile_statistics(mask)
                rows.append((name, int(mask.sum() - socle.sum()), int(socle.sum()), -1 if cut is None else y + cut, s["n_columns"], s["top_iqr"], s["top_span"], s["gable_peak"]))
            yield pd.DataFrame(rows, columns=["image_id", "facade_px", "socle_px", "socle_y", "n_columns", "top_iqr", "top_span", "gable_peak"])

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, SOCLES)
