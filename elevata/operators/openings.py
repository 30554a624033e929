"""Refinement of openings: fragments, rows, doors, scenes, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions.boxes import Box, gap_x, gap_y, overlap_x, overlap_y
from ..functions.text import let


def merged_fragments(regions: DataFrame) -> DataFrame:
    """Neighbouring fragments of a facade become one box, until nothing
    changes. ``regions``: facade_id, region_id, x, y, w, h, fy, fw, fh.

    Each step joins the first pair, in the order of x and y, that stands side
    by side and whose union is shaped and placed like a window. A joined box
    keeps the id of its first part. There are fewer steps than a facade has
    boxes, and a step looks at pairs until one fits.
    """
    item = F.struct(*(F.col(c).cast("long").alias(c) for c in "xywh"), F.col("region_id").cast("long").alias("region_id"), F.lit(1).cast("long").alias("parts"))
    rows = regions.groupBy("facade_id").agg(F.array_sort(F.collect_list(item)).alias("bs"), *(F.first(c).cast("long").alias(c) for c in ("fy", "fw", "fh")))
    fy, fw, fh = F.col("fy"), F.greatest(F.col("fw"), F.lit(1)), F.greatest(F.col("fh"), F.lit(1))

    def join(a: Column, b: Column) -> Column:
        p, q = Box.of(struct=a), Box.of(struct=b)
        x, y = F.least(p.x, q.x), F.least(p.y, q.y)
        return F.struct(x.alias("x"), y.alias("y"), (F.greatest(p.right, q.right) - x).alias("w"), (F.greatest(p.bottom, q.bottom) - y).alias("h"), a["region_id"].alias("region_id"), (a["parts"] + b["parts"]).alias("parts"))

    def fits(a: Column, b: Column) -> Column:
        p, q = Box.of(struct=a), Box.of(struct=b)
        x, y = F.least(p.x, q.x), F.least(p.y, q.y)
        w, h = F.greatest(p.right, q.right) - x, F.greatest(p.bottom, q.bottom) - y
        beside = (gap_x(p, q) <= F.greatest(F.lit(16), F.floor(F.col("fw") * 0.02))) & (overlap_y(p, q) >= F.least(p.h, q.h) * 0.45)
        return beside & (w / fw).between(0.06, 0.20) & (h / fh).between(0.16, 0.55) & ((y + h * 0.5 - fy) / fh).between(0.22, 0.70) & (w / F.greatest(h, F.lit(1))).between(0.55, 2.20)

    def step(bs: Column) -> Column:
        def first_partner(a: Column, i: Column) -> Column:
            return F.get(F.filter(bs, lambda b, j: (j > i) & fits(a, b)), F.lit(0))

        pairs = F.filter(F.transform(bs, lambda a, i: F.struct(a.alias("a"), first_partner(a, i).alias("b"))), lambda p: p["b"].isNotNull())

        def joined(p: Column) -> Column:
            rest = F.filter(bs, lambda x: (x["region_id"] != p["a"]["region_id"]) & (x["region_id"] != p["b"]["region_id"]))
            return F.when(p.isNull(), bs).otherwise(F.array_sort(F.concat(rest, F.array(join(p["a"], p["b"])))))

        return let(F.get(pairs, F.lit(0)), joined)

    done = F.aggregate(F.sequence(F.lit(1), F.size("bs")), F.col("bs"), lambda bs, _: step(bs))
    return rows.select("facade_id", F.explode(done).alias("b")).select("facade_id", "b.region_id", "b.x", "b.y", "b.w", "b.h", "b.parts")


def median_rows(regions: DataFrame) -> DataFrame:
    """Row numbers of regions sorted by y: one further than max(14, 5 %) from
    the median of the row so far begins the next. ``regions``: facade_id,
    region_id, y, fh."""
    item = F.struct(F.col("y").cast("long").alias("y"), F.col("region_id").cast("long").alias("region_id"))
    rows = regions.groupBy("facade_id").agg(F.array_sort(F.collect_list(item)).alias("rs"), F.first("fh").alias("fh"))
    start = F.struct(F.array().cast("array<bigint>").alias("row"), F.lit(0).alias("n"), F.array().cast("array<struct<region_id:bigint,row:int>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        n = F.size(s["row"])
        middle = (F.get(s["row"], F.floor((n - 1) / 2).cast("int")) + F.get(s["row"], F.floor(n / 2).cast("int"))) / 2.0
        same = (n > 0) & (F.abs(r["y"] - middle) <= F.greatest(F.lit(14.0), F.col("fh") * 0.05))
        row = F.when(same, s["n"]).otherwise(s["n"] + 1)
        return F.struct(F.when(same, F.concat(s["row"], F.array(r["y"]))).otherwise(F.array(r["y"])).alias("row"), row.alias("n"), F.concat(s["out"], F.array(F.struct(r["region_id"].alias("region_id"), row.alias("row")))).alias("out"))

    done = rows.select(F.explode(F.aggregate("rs", start, step)["out"]).alias("o"))
    return done.select("o.region_id", "o.row")


def _score(value: Column, centre: float, width: float) -> Column:
    """1 at the centre, 0 from ``width`` away."""
    return F.greatest(1.0 - F.abs(value - centre) / width, F.lit(0.0))


def door_score(facade: Box, box: Box, area: Column, parts: Column) -> Column:
    """How plausible an opening is as a door of a facade: gates on its
    ratios, then a weighted sum; -1 where a gate fails."""
    width, height, bottom = box.w / facade.w, box.h / facade.h, (box.bottom - facade.y) / facade.h
    centre, aspect, share = (box.cx - facade.x) / facade.w, box.w / box.h, area / (facade.w * facade.h)
    gates = (
        width.between(0.030, 0.32) & height.between(0.30, 0.92) & aspect.between(0.18, 0.72)
        & centre.between(0.18, 0.82) & bottom.between(0.58, 1.02) & share.between(0.008, 0.26)
    )
    ramp = lambda v, low, wide: F.least(F.greatest((v - low) / wide, F.lit(0.0)), F.lit(1.0))
    # The bonus is for doors that several fragments make up.
    total = (
        _score(centre, 0.5, 0.32) * 0.34 + ramp(bottom, 0.58, 0.25) * 0.28 + ramp(height, 0.22, 0.40) * 0.18
        + _score(width, 0.13, 0.14) * 0.12 + _score(aspect, 0.42, 0.38) * 0.08 + F.when(parts > 1, 0.08).otherwise(0.0)
    )
    sized = (facade.w > 0) & (facade.h > 0) & (box.w > 0) & (box.h > 0)
    return F.when(sized & gates, total).otherwise(-1.0)


def _facade(facades: DataFrame) -> DataFrame:
    return facades.select("facade_id", *(F.col(c).alias("f" + c) for c in "xywh"))


def promoted_doors(facades: DataFrame, windows: DataFrame) -> DataFrame:
    """The window, or the pair of stacked windows, of each image that is
    promoted to its door, if one stands out.

    ``windows``: facade_id, region_id, x, y, w, h. Few candidates have a low
    bar; many need a high score and a margin over the second.
    """
    f, centre = Box.of("f"), Box.of()
    inside = windows.join(_facade(facades), "facade_id").filter(f.holds(centre.cx, centre.cy))
    single = inside.withColumn("score", door_score(f, Box.of(), F.col("w") * F.col("h"), F.lit(1))).withColumn("second_id", F.lit(-1).cast("long"))
    other = inside.select("facade_id", F.col("region_id").alias("second_id"), *(F.col(c).alias("o" + c) for c in "xywh"))
    a, b = Box.of(), Box.of("o")
    stacked = (F.abs(a.cx - b.cx) <= F.greatest(F.lit(42), F.floor(F.col("fw") * 0.12))) & (overlap_x(a, b) >= F.least(a.w, b.w) * 0.30) & (gap_y(a, b) <= F.greatest(F.lit(44), F.floor(F.col("fh") * 0.22)))
    pairs = inside.join(other, "facade_id").filter((F.col("region_id") < F.col("second_id")) & stacked)
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    pairs = pairs.withColumns({"nx": x, "ny": y, "nw": F.greatest(a.right, b.right) - x, "nh": F.greatest(a.bottom, b.bottom) - y, "both": a.area + b.area})
    pairs = pairs.withColumn("score", door_score(f, Box.of("n"), F.col("both"), F.lit(2)))
    columns = ["facade_id", "region_id", "second_id", "score"]
    every = single.select(*columns, *"xywh").unionByName(pairs.select(*columns, *(F.col("n" + c).alias(c) for c in "xywh"))).filter("score >= 0")
    # The two best of each facade, without sorting the rest.
    key = F.struct((-F.col("score")).alias("o"), "region_id", "second_id", *"xywh")
    top = every.groupBy("facade_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(key)).alias("ks"))
    best, second = F.get("ks", F.lit(0)), F.get("ks", F.lit(1))
    least = F.when(F.col("n") == 1, 0.42).when(F.col("n") == 2, 0.50).otherwise(0.55)
    clear = (F.col("n") <= 2) | (-best["o"] >= -second["o"] + 0.06)
    # With two candidates no margin is asked, but the second must not be better.
    return top.filter((-best["o"] >= least) & clear).select("facade_id", (-best["o"]).alias("score"), *(best[c].alias(c) for c in ("region_id", "second_id", "x", "y", "w", "h")))


def fitted_door(facade: Box, door: Box, left: Box, right: Box) -> Column:
    """A door fitted into the gap between two windows: struct x, y, w, h, or
    null where the gap is too small. A wide gap pulls the door's centre, a
    tight one is filled."""
    whole = lambda c: F.bround(c).cast("long")

    def fit(gap: Column) -> Column:
        wide = gap > F.greatest(F.floor(facade.w * 0.12), F.floor(door.w * 2.4))
        middle = (left.right + right.x) * 0.5
        loose = F.least(F.greatest(door.w, whole(door.w * 1.10)), F.greatest(whole(facade.w * 0.085), door.w + 18))
        tight = F.least(gap, F.greatest(door.w, whole(gap * 0.98)))
        target = F.greatest(door.w, F.least(F.when(wide, loose).otherwise(tight), whole(facade.w * 0.12)))
        centre = F.when(wide, middle * 0.55 + door.cx * 0.45).otherwise(middle)
        at = lambda w: F.greatest(facade.x, F.least(whole(centre - w * 0.5), facade.x + facade.w - w))
        return let(target.cast("long"), lambda w: F.struct(at(w).cast("long").alias("x"), door.y.cast("long").alias("y"), w.alias("w"), door.h.cast("long").alias("h")))

    gap = right.x - left.right
    return F.when(gap >= F.greatest(F.lit(28), F.floor(facade.w * 0.035)), let(gap.cast("long"), fit))


def central_cluster(facades: DataFrame, openings: DataFrame) -> DataFrame:
    """Facades with a door near the centre between two balanced windows.

    ``openings``: facade_id, region_id, kind, x, y, w, h.
    """
    f, o = Box.of("f"), Box.of()
    wide = _facade(facades).filter("fw >= 160 AND fh >= 90").filter(F.col("fw") / F.col("fh") >= config.FLAT_MIN_ASPECT)
    slack = F.greatest(F.lit(8.0), F.col("fw") * 0.025)
    rows = openings.join(wide, "facade_id").filter(f.holds(o.cx, o.cy, slack))
    off = F.abs(o.cx - f.cx)
    top, bottom = (o.y - f.y) / f.h, (o.bottom - f.y) / f.h
    doors = rows.filter(F.col("kind") == "door").filter((off <= f.w * 0.17) & o.w.between(f.w * 0.020, f.w * 0.18) & o.h.between(f.h * 0.18, f.h * 0.82) & top.between(0.18, 0.78) & bottom.between(0.55, 0.98))
    door = doors.groupBy("facade_id").agg(F.min_by(F.struct(*"xywh"), F.struct((off - o.h * 0.03).alias("s"), "region_id")).alias("door"))
    d = Box.of(struct=F.col("door"))
    near = rows.filter(F.col("kind") == "window").join(door, "facade_id")
    gap, shared, down = gap_x(o, d), overlap_y(o, d), F.abs(o.cy - d.cy)
    near = near.filter(
        (o.w <= f.w * 0.24) & (o.h <= f.h * 0.52) & (gap <= F.greatest(F.lit(44), F.bround(f.w * 0.14)))
        & ((shared >= F.least(o.h, d.h) * 0.12) | (down <= F.greatest(F.lit(42), F.bround(f.h * 0.18)))) & o.cy.between(f.y + f.h * 0.16, f.y + f.h * 0.78)
    )
    left, right = (o.right <= d.x) & (o.cx < f.cx), (o.x >= d.right) & (o.cx > f.cx)
    nearest = lambda side: F.min(F.when(side, F.struct(gap.alias("gap"), down.alias("down"), "region_id", "y")))
    pairs = near.groupBy("facade_id", "fw", "fh").agg(nearest(left).alias("l"), nearest(right).alias("r"), F.count("*").alias("n")).filter("l IS NOT NULL AND r IS NOT NULL")
    even = (F.abs(F.col("l.gap") - F.col("r.gap")) <= F.greatest(F.lit(36), F.bround(F.col("fw") * 0.08))) & (F.abs(F.col("l.y") - F.col("r.y")) <= F.greatest(F.lit(36), F.bround(F.col("fh") * 0.15)))
    return pairs.filter(even).select("facade_id")


def scene_class(s: DataFrame) -> Column:
    """Class of a facade's scene from its statistics, by ordered rules.

    Columns: merged, w, h, n_columns, n_openings, top_iqr, top_span,
    gable_peak, top_spread, centre_spread, central.
    """
    c = F.col
    h, aspect = c("h"), c("w") / F.greatest(c("h"), F.lit(1))
    few, wide = c("n_openings") <= config.SPARSE_MAX_OPENINGS, aspect >= config.FLAT_MIN_ASPECT
    gable = (aspect <= config.GABLE_MAX_ASPECT) & (c("top_span") >= h * config.GABLE_TOP_SPAN) & ((c("top_iqr") >= h * config.GABLE_TOP_IQR) | (c("gable_peak") >= h * config.GABLE_PEAK))
    spread = (c("top_spread") >= h * config.COMPOSITE_TOP_SPREAD) | (c("centre_spread") >= h * config.COMPOSITE_CENTRE_SPREAD)
    some = c("n_openings") <= config.BORDERLINE_MAX_OPENINGS
    return (
        F.when(c("merged"), "composite_stepped_facade")
        .when((c("w") < 60) | (h < 60), "unknown")
        .when(c("n_columns") < F.greatest(F.lit(18), F.floor(c("w") * 0.12)), F.when(few, "sparse_openings_flat").otherwise("unknown"))
        .when(gable, "gable_facade")
        .when((c("n_openings") >= config.COMPOSITE_MIN_OPENINGS) & wide & spread, "composite_stepped_facade")
        .when(c("central"), "flat_long_facade")
        .when(wide & few, "sparse_openings_flat")
        .when((c("top_span") >= h * config.BORDERLINE_TOP_SPAN) & some, "sparse_openings_flat")
        .when(wide & (c("top_iqr") <= h * config.FLAT_TOP_IQR), "flat_long_facade")
        .when(some, "sparse_openings_flat")
        .otherwise("flat_long_facade")
    )


def implausible(f: Box, o: Box) -> Column:
    """Final openings of photographs that cannot be windows: low fragments,
    slivers at the right edge, wide boxes near the ground."""
    bottom, ratio = (o.bottom - f.y) / F.greatest(f.h, F.lit(1)), o.w / F.greatest(o.h, F.lit(1))
    low = o.h < F.floor(f.h * 0.22)
    return (
        ((bottom > 0.78) & low) | ((o.w < F.floor(f.w * 0.045)) & low)
        | ((o.right > f.right - F.floor(f.w * 0.05)) & (o.w < F.floor(f.w * 0.07)))
        | ((bottom > 0.64) & (o.h < F.floor(f.h * 0.24)) & (o.w < F.floor(f.w * 0.07)) & (ratio < 1.45))
        | ((ratio > 1.9) & (bottom > 0.65))
    )


def invalid_window(f: Box, o: Box, image_area: Column) -> Column:
    """Geometry of window candidates that are roofs, walls or shadows; where
    no facade holds the candidate only the first two rules apply."""
    ratio = o.w / o.h
    inside = (
        (o.area > f.area * 0.35) | ((o.h < f.h * 0.15) & (o.w > f.w * 0.60) & (o.y < f.y + f.h * 0.20))
        | ((o.bottom - f.y) / F.greatest(f.h, F.lit(1)) > 0.92)
    )
    return (o.w > 0) & (o.h > 0) & ((ratio > 4.5) | (ratio < 0.22) | (o.area > image_area * 0.25) | F.coalesce(inside, F.lit(False)))


def bright_wall(mean: Column, spread: Column, n_pixels: Column) -> Column:
    """Whether a candidate's patch is evenly bright, like sky or wall; too
    small a patch says nothing. Grey levels from 0 to 255."""
    return (n_pixels * 3 >= 100) & (mean > 200) & (spread < 35)


def photo_validated(candidates: DataFrame) -> DataFrame:
    """Windows that stay: only candidates of photographs are tested, and an
    image whose candidates would all go keeps them.

    ``candidates``: image_id, region_id, photo, invalid (see
    `invalid_window`), bright (see `bright_wall`).
    """
    gone = F.col("photo") & (F.coalesce("invalid", F.lit(False)) | F.coalesce("bright", F.lit(False)))
    some = F.max(~gone).over(Window.partitionBy("image_id"))
    return candidates.withColumns({"_gone": gone, "_some": some}).filter(~F.col("_gone") | ~F.col("_some")).drop("_gone", "_some")


def markup_window(f: Box, o: Box) -> Column:
    """Whether a marked window lies and is sized plausibly in its facade."""
    return (o.cy <= f.y + f.h * 0.72) & (o.area / f.area).between(0.006, 0.30)


def scene_pruned(openings: DataFrame) -> DataFrame:
    """Openings that stay: gable scenes drop lone doors (at most one window
    near) and small windows; sparse scenes drop sidelights that stand on one
    side of a door only. All tests see the openings before any is dropped.

    ``openings``: facade_id, region_id, kind, scene, fw, fh, x, y, w, h.
    """
    other = openings.select("facade_id", F.col("region_id").alias("oid"), F.col("kind").alias("okind"), *(F.col(c).alias("o" + c) for c in "xywh"))
    a, b = Box.of(), Box.of("o")
    near = (overlap_y(a, b) >= F.least(a.h, b.h) * 0.20) & (gap_x(a, b) <= F.greatest(F.lit(90.0), F.greatest(a.w, b.w) * 1.4))
    pairs = openings.join(other, "facade_id").filter((F.col("oid") != F.col("region_id")) & (F.col("kind") != F.col("okind")) & near)
    seen = pairs.groupBy("region_id").agg(F.count("*").alias("n_near"), F.sum(F.when(b.cx < a.cx, 1).otherwise(0)).alias("n_left"))
    rows = openings.join(seen, "region_id", "left").na.fill(0, ["n_near", "n_left"])
    gable, sparse, door = F.col("scene") == "gable_facade", F.col("scene") == "sparse_openings_flat", F.col("kind") == "door"
    small = a.area < F.col("fw") * F.col("fh") * 0.004
    gone = (gable & door & (F.col("n_near") <= 1)) | (gable & ~door & small) | (sparse & ~door & (F.col("n_near") > 0) & ((F.col("n_left") == 0) | (F.col("n_left") == F.col("n_near"))) & (a.w < F.col("fw") * 0.05))
    return rows.filter(~gone).select(openings.columns)


def composite_openings(openings: DataFrame) -> DataFrame:
    """Openings of composite facades: windows that stand right above a door
    go; a door with a sidelight on one side only gets its mirror image.

    ``openings``: facade_id, region_id, kind (window, door, sidelight), x, y,
    w, h. Mirrored sidelights get the door's id, negated.
    """
    a, d = Box.of(), Box.of("d")
    doors = openings.filter("kind = 'door'").select("facade_id", F.col("region_id").alias("door_id"), *(F.col(c).alias("d" + c) for c in "xywh"))
    pairs = openings.filter("kind <> 'door'").join(doors, "facade_id")
    above = (F.col("kind") == "window") & (overlap_x(a, d) >= F.least(a.w, d.w) * 0.5) & (a.bottom <= d.y + d.h * 0.15) & (d.y - a.bottom <= d.h * 0.25)
    gone = pairs.filter(above).select("region_id").distinct()
    beside = (F.col("kind") == "sidelight") & (gap_x(a, d) <= d.w * 0.25) & (overlap_x(a, d) <= a.w * 0.2) & (overlap_y(a, d) >= d.h * 0.5)
    side = pairs.filter(beside).withColumn("left", a.cx < d.cx)
    one = side.groupBy("facade_id", "door_id", "dx", "dw").agg(F.count_if("left").alias("nl"), F.count_if(~F.col("left")).alias("nr"), F.min_by(F.struct(*"xywh"), "region_id").alias("s"))
    s = Box.of(struct=F.col("s"))
    mirrored = (2 * F.col("dx") + F.col("dw") - s.x - s.w).cast("long")
    new = one.filter((F.col("nl") > 0) != (F.col("nr") > 0)).select("facade_id", (-F.col("door_id")).alias("region_id"), F.lit("sidelight").alias("kind"), mirrored.alias("x"), *(F.col(f"s.{c}").alias(c) for c in "ywh"))
    kept = openings.join(gone, "region_id", "left_anti").select("facade_id", "region_id", "kind", *"xywh")
    return kept.unionByName(new)


def routed_regions(detected: DataFrame, predicted: DataFrame, images: DataFrame) -> DataFrame:
    """Regions by route: on images that are not marked (``marked_share`` up to
    5 %) predictions replace detected openings, and facades where none was
    detected; unless the photograph has a central door cluster (``central``)
    and the predictions have windows but no door.

    Regions: image_id, region_id, kind; images: image_id, marked_share,
    central.
    """
    n = predicted.groupBy("image_id").agg(F.count_if(F.col("kind") == "window").alias("pw"), F.count_if(F.col("kind") == "door").alias("pd"), F.count("*").alias("n"))
    f = detected.groupBy("image_id").agg(F.count_if(F.col("kind") == "facade").alias("nf"))
    route = images.join(n, "image_id", "left").join(f, "image_id", "left").na.fill(0, ["pw", "pd", "n", "nf"])
    keep = F.col("central") & (F.col("pw") > 0) & (F.col("pd") == 0)
    route = route.select("image_id", ((F.col("marked_share") <= 0.05) & (F.col("n") > 0) & ~keep).alias("use"), (F.col("nf") == 0).alias("bare"))
    opening = F.col("kind").isin("window", "door")
    own = detected.join(route, "image_id").filter(~F.col("use") | ~opening).select(*detected.columns, F.lit("detected").alias("route"))
    new = predicted.join(route, "image_id").filter(F.col("use") & (opening | ((F.col("kind") == "facade") & F.col("bare")))).select(*detected.columns, F.lit("predicted").alias("route"))
    return own.unionByName(new)


def photo_window(origin: Column) -> Column:
    """Whether a region's origin says that it is a window of a photograph."""
    low = F.lower(F.coalesce(origin, F.lit("")))
    return F.contains(low, F.lit("photo")) & F.contains(low, F.lit("window"))


def with_box(regions: DataFrame, box: Box) -> DataFrame:
    """Regions with new boxes: the area follows, an outline goes."""
    sides = {"x": box.x, "y": box.y, "w": box.w, "h": box.h}
    out = regions.withColumns({f"_{c}": v.cast("long") for c, v in sides.items()}).withColumns({c: F.col(f"_{c}") for c in sides}).drop(*(f"_{c}" for c in sides))
    out = out.withColumn("area_px", F.col("w") * F.col("h"))
    return out.withColumn("contour", F.lit(None).cast(regions.schema["contour"].dataType)) if "contour" in regions.columns else out
