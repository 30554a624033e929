"""Queries over geometry, sketches, clips and label sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import Box
from ..functions.text import measurement
from ..operators import geometry as G
from ..sources.adapter import duck, view
from .duck import iou
from .scene import INSIDE, _inside
from .text import MEASURED


def scaled_report(spark, sf):
    f = view(spark, sf, "v_facade").select("facade_id", (F.col("w") / 12.0).alias("px_per_m"), "w", "h", F.when(F.col("facade_id") % 3 == 0, F.col("w") - 20).alias("socle_w"))
    e = view(spark, sf, "v_element").select("facade_id", "kind", F.when(F.col("known"), F.col("w_cm") / 100.0).alias("width_m"), F.when(F.col("score") > 50, F.col("h_cm") / 100.0).alias("height_m"), "w", "h")
    return G.scaled_report(f, e)


def _tokens(spark, sf):
    t = view(spark, sf, "v_token").withColumn("m", measurement(F.col("text")))
    return t.select("image_id", "token_id", F.floor((2 * F.col("x") + F.col("w")) / 2).alias("cx"), F.floor((2 * F.col("y") + F.col("h")) / 2).alias("cy"), "m.*")


def nearby_value_point(spark, sf):
    p = view(spark, sf, "v_element").select(F.col("facade_id").alias("image_id"), F.col("element_id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    return G.values_near_points(p, _tokens(spark, sf), 130, 12.0)


def nearest_parent(spark, sf):
    f = view(spark, sf, "v_facade").select("image_id", "facade_id", *"xywh")
    r = view(spark, sf, "v_element").join(f.select("image_id", "facade_id"), "facade_id").select("image_id", F.col("element_id").alias("region_id"), F.when(F.col("score") % 2 == 0, F.col("facade_id")).alias("parent"), *"xywh")
    return G.nearest_parent(r, f)


def doors_off_windows(spark, sf):
    e = _inside(spark, sf).withColumnRenamed("facade_id", "image_id")
    return G.without_overlaps(e.filter("kind = 'door'"), e.filter("kind = 'window'"), 0.28).select("region_id")


def clipped_openings(spark, sf):
    scene = F.when(F.col("facade_id") % 2 == 0, "flat_long_facade").otherwise("composite_stepped_facade")
    e = _inside(spark, sf).withColumn("scene", scene).withColumn("socle_y", F.when(F.col("facade_id") % 3 > 0, F.col("fy") + F.col("fh") - 20))
    return G.clipped_openings(e).select("region_id", "h", "area_px")


def detection_results(spark, sf):
    out = G.detection_rows(view(spark, sf, "v_facade"), view(spark, sf, "v_element"))
    return out.withColumn("length_px", F.coalesce("length_px", F.lit(-1)))


def _shapes(spark, sf):
    c = F.col("score")
    kind = F.when(c % 4 == 0, "facade").when(c % 4 == 1, "window").when(c % 4 == 2, "door").otherwise("zone")
    return view(spark, sf, "v_element").select(F.col("facade_id").alias("image_id"), F.col("element_id").alias("shape_id"), kind.alias("kind"), F.when(c % 3 == 0, "polygon").otherwise("rectangle").alias("shape"), (F.col("w") - 20).alias("w"), (F.col("h") - 15).alias("h"), (c % 6).alias("n_points"), (F.col("w") * 9).alias("area_px"))


def sketch_rules(spark, sf):
    return G.valid_sketches(_shapes(spark, sf))


def sketch_or_detected(spark, sf):
    s = _shapes(spark, sf)
    pick = lambda d: d.select("image_id", "shape_id", "kind")
    return G.merged_sources(pick(s.filter("shape_id % 3 = 0")), pick(s.filter("shape_id % 3 > 0")))


def row_band(spark, sf):
    return G.row_band(view(spark, sf, "v_element").filter("kind = 'window'").withColumn("y", F.floor(F.col("y") / 20)))


def attached_volumes(spark, sf):
    f = view(spark, sf, "v_facade").select("image_id", "facade_id", *"xywh")
    o = f.select("image_id", F.col("facade_id").alias("other_id"), *(F.col(c).alias("o" + c) for c in "xywh"))
    return f.join(o, "image_id").filter((F.col("facade_id") != F.col("other_id")) & G.attached(Box.of(), Box.of("o"))).select("facade_id", "other_id")


def united_facades(spark, sf):
    return G.united(view(spark, sf, "v_facade").select("image_id", F.col("facade_id").alias("region_id"), *"xywh"))


def geometry_warnings(spark, sf):
    c = F.col("facade_id")
    f = view(spark, sf, "v_facade").select(
        c.alias("case_id"), F.lit(2000).alias("image_w"), F.when(c % 3 == 0, "gable_facade").otherwise("x").alias("scene"), *"xyw", (c % 9).alias("left_offset"), (c % 8).alias("right_offset"), (c % 25).alias("facade_to_line"),
        *(F.when(c % (i + 2) == 0, (c % 100) / 100.0).alias(f"{k}_iou") for i, k in enumerate(("facade", "socle", "window", "door"))),
    )
    return G.geometry_warnings(f)


def scaled_boxes(spark, sf):
    e = view(spark, sf, "v_element")
    return e.select("element_id", G.scaled_box(Box.of(), F.lit(2180.0), F.lit(1180.0), F.lit(640.0), F.lit(480.0)).alias("b")).select("element_id", "b.*")


def width_gate(spark, sf):
    e = _inside(spark, sf)
    return e.select("region_id", G.wide_enough(Box.of("f"), Box.of()).alias("wide"))


def socle_lines(spark, sf):
    p = view(spark, sf, "v_pixel").filter("v > 0").select(F.col("image_id").alias("contour_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return G.fitted_lines(p).select("contour_id", "n", (F.round("slope", 6) + 0.0).alias("slope"), (F.round("intercept", 6) + 0.0).alias("intercept"))


def inferred_facades(spark, sf):
    e = view(spark, sf, "v_element").select(F.col("facade_id").alias("image_id"), F.floor(F.col("y") / 250).cast("int").alias("row"), F.col("element_id").alias("region_id"), *"xywh")
    return G.inferred_facades(e)


def label_counts(spark, sf):
    """Labels by kind and source, as a table of counts."""
    e = view(spark, sf, "v_element")
    return e.groupBy("side").pivot("kind", ["window", "door"]).agg(F.count("element_id")).na.fill(0)


def largest_facade(spark, sf):
    f = view(spark, sf, "v_facade")
    return f.groupBy("image_id").agg(F.max_by("facade_id", F.struct((F.col("w") * F.col("h")).alias("a"), (-F.col("facade_id")).alias("o"))).alias("facade_id"))


def area_tokens(spark, sf):
    """Tokens by what they can be: an area, or a length of a side."""
    t = _tokens(spark, sf)
    return t.select("token_id", F.coalesce(F.col("unit") == "m²", F.lit(False)).alias("is_area"), F.coalesce((F.col("unit") == "m") & (F.col("value") > 0.1) & (F.col("value") < 50), F.lit(False)).alias("is_size"))


def truth_templates(spark, sf):
    """Images without ground truth, with an empty template each."""
    e = view(spark, sf, "v_element")
    rows = view(spark, sf, "v_facade").select("facade_id").join(e.filter("side = 'O'").select("facade_id").distinct(), "facade_id", "left_anti")
    empty = F.array().cast("array<int>")
    return rows.select("facade_id", F.to_json(F.struct(F.col("facade_id").cast("string").alias("sample_id"), empty.alias("facades"), empty.alias("windows"), empty.alias("doors"))).alias("template"))


def processed_pairs(spark, sf):
    """Raw and processed files of one drawing, by their normalised names."""
    f = view(spark, sf, "v_facade")
    raw = f.select("facade_id", F.concat(F.lit("Casa "), "facade_id", F.lit("_raw.PNG")).alias("raw"))
    done = f.filter("facade_id % 3 = 0").select(F.concat(F.lit("casa "), "facade_id", F.lit("_procesat.png")).alias("processed"))
    key = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\.[a-z]+$", ""), "_(procesat|raw)$", "")
    return raw.withColumn("k", key(F.col("raw"))).join(done.withColumn("k", key(F.col("processed"))), "k").select("facade_id", "raw", "processed")


BTW = "CASE kind WHEN 'window' THEN {0} BETWEEN 0.2 AND 8.0 ELSE {0} BETWEEN 0.5 AND 5.0 END"
QUERIES = {f.__name__: f for f in (
    scaled_report, nearby_value_point, nearest_parent, doors_off_windows, clipped_openings, detection_results, sketch_rules, sketch_or_detected, row_band, attached_volumes, united_facades,
    geometry_warnings, scaled_boxes, width_gate, socle_lines, inferred_facades, label_counts, largest_facade, area_tokens, truth_templates, processed_pairs,
)}
SHAPES = f"""{duck("v_element")}, s AS (SELECT facade_id AS image_id, element_id AS shape_id, CASE score % 4 WHEN 0 THEN 'facade' WHEN 1 THEN 'window' WHEN 2 THEN 'door' ELSE 'zone' END AS kind, score % 3 = 0 AS poly, w - 20 AS w, h - 15 AS h, score % 6 AS np, w * 9 AS a FROM v_element)"""
IOUS = ("facade", 0.72, 2), ("socle", 0.45, 3), ("window", 0.40, 4), ("door", 0.45, 5)
ORACLES = {
    "scaled_report": f"""{duck("v_facade", "v_element")}, k AS (SELECT e.facade_id, kind, CASE WHEN known AND w_cm > 0 THEN w_cm / 100.0::DOUBLE ELSE e.w / (f.w / 12.0::DOUBLE) END AS wm, CASE WHEN e.score > 50 THEN h_cm / 100.0::DOUBLE ELSE e.h / (f.w / 12.0::DOUBLE) END AS hm FROM v_element e JOIN v_facade f ON e.facade_id = f.facade_id),
        m AS (SELECT facade_id, kind, CASE WHEN {BTW.format("wm")} THEN floor(wm * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT END AS mw, floor(hm * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT AS mh FROM k),
        t AS (SELECT facade_id, sum(mw) FILTER (WHERE kind = 'window') AS sill, sum(mw) AS drip, sum(2 * (mw + mh)) FILTER (WHERE kind = 'window') AS wp, sum(2 * mh + mw) FILTER (WHERE kind = 'door') AS dp FROM m GROUP BY facade_id),
        c AS (SELECT facade_id, 2 * h / (w / 12.0::DOUBLE) AS co, CASE WHEN facade_id % 3 = 0 THEN w - 20 ELSE w END / (w / 12.0::DOUBLE) AS so FROM v_facade)
        SELECT c.facade_id, CASE WHEN co BETWEEN 0.2 AND 200 THEN floor(co * 1000 + 0.5::DOUBLE) / 1000 ELSE 0 END AS corner_m, CASE WHEN so BETWEEN 0.2 AND 500 THEN floor(so * 1000 + 0.5::DOUBLE) / 1000 ELSE 0 END AS socle_drip_m,
               {", ".join(f"((coalesce({a}, 0)::BIGINT + 500) // 1000) / 1000.0::DOUBLE AS {b}" for a, b in (("sill", "sill_m"), ("drip", "drip_m"), ("wp", "window_perimeter_m"), ("dp", "door_perimeter_m")))} FROM c LEFT JOIN t ON c.facade_id = t.facade_id""",
    "nearby_value_point": f"""{MEASURED}, p AS (SELECT element_id AS point_id, b.value, b.token_id, sqrt(((e.x - b.cx) * (e.x - b.cx) + (e.y - b.cy) * (e.y - b.cy))::DOUBLE) AS d, unit FROM v_element e JOIN m b ON e.facade_id = b.image_id WHERE b.value BETWEEN 0.01 AND 12)
        SELECT point_id, arg_min(value, (d * CASE WHEN unit = 'm²' THEN 0.8::DOUBLE ELSE 1 END, token_id)) AS value FROM p WHERE d <= 130 GROUP BY point_id""",
    "nearest_parent": f"""{duck("v_facade", "v_element")}, p AS (SELECT element_id AS region_id, CASE WHEN score % 2 = 0 THEN e.facade_id END AS parent, g.facade_id AS fid, e.x + e.w // 2 AS cx, e.y + e.h // 2 AS cy, g.x, g.y, g.w, g.h FROM v_element e JOIN v_facade f ON e.facade_id = f.facade_id JOIN v_facade g ON g.image_id = f.image_id),
        q AS (SELECT *, NOT (cx BETWEEN x AND x + w AND cy BETWEEN y AND y + h) AS o, ((cx - x - w // 2) * (cx - x - w // 2) + (cy - y - h // 2) * (cy - y - h // 2))::DOUBLE AS d FROM p), b AS (SELECT region_id, any_value(parent) AS parent, min((o, CASE WHEN o THEN d ELSE 0 END, fid)) AS b FROM q GROUP BY region_id)
        SELECT region_id, CASE WHEN b[1] AND parent IS NOT NULL THEN parent ELSE b[3] END AS facade_id FROM b""",
    "doors_off_windows": f"""{INSIDE} SELECT region_id FROM e a WHERE kind = 'door' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.facade_id = a.facade_id AND b.kind = 'window' AND {iou("a", "b")} > 0.28)""",
    "clipped_openings": f"""{INSIDE}, k AS (SELECT *, CASE WHEN facade_id % 3 > 0 THEN fy + fh - 20 END AS sy FROM e),
        c AS (SELECT region_id, w, CASE WHEN facade_id % 2 = 0 AND kind = 'door' AND y + h > sy + 1 AND sy - y >= round_even(h * 0.60::DOUBLE, 0) THEN sy - y WHEN facade_id % 2 = 1 AND y + h > fy + fh AND fy + fh - y >= round_even(h * 0.30::DOUBLE, 0) AND fy + fh - y >= 40 THEN fy + fh - y ELSE h END AS h FROM k) SELECT region_id, h, w * h AS area_px FROM c""",
    "detection_results": f"""{duck("v_facade", "v_element")} SELECT 'facade' AS kind, facade_id AS owner_id, x, y, w, h, -1 AS length_px FROM v_facade
        UNION ALL SELECT 'socle', facade_id, x, y + h - greatest(floor(h * 0.10::DOUBLE)::BIGINT, 1), w, greatest(floor(h * 0.10::DOUBLE)::BIGINT, 1), w FROM v_facade UNION ALL SELECT kind, element_id, x, y, w, h, CASE kind WHEN 'window' THEN 2 * (w + h) ELSE 2 * h + w END FROM v_element""",
    "sketch_rules": f"""{SHAPES}, v AS (SELECT *, row_number() OVER (PARTITION BY image_id, kind ORDER BY shape_id DESC) AS l FROM s WHERE (poly AND np >= 3 AND a >= 500) OR (NOT poly AND w >= 8 AND h >= 8))
        SELECT image_id, shape_id, kind, CASE kind WHEN 'facade' THEN 'FATADA_MANUAL_' WHEN 'window' THEN 'F_' WHEN 'door' THEN 'U_' ELSE 'ZL_' END || row_number() OVER (PARTITION BY image_id, kind ORDER BY shape_id) AS label FROM v WHERE kind <> 'facade' OR l = 1""",
    "sketch_or_detected": f"""{SHAPES} SELECT image_id, shape_id, kind FROM s WHERE shape_id % 3 = 0 OR image_id NOT IN (SELECT image_id FROM s WHERE shape_id % 3 = 0 AND kind = 'facade')""",
    "row_band": f"""{duck("v_element")}, e AS (SELECT facade_id, y // 20 AS y, y // 20 + h AS b, h FROM v_element WHERE kind = 'window'),
        s AS (SELECT facade_id, count(*) AS n, round_even(median(y), 0)::BIGINT AS top, round_even(median(b), 0)::BIGINT AS bottom, round_even(median(h), 0)::BIGINT AS height, quantile_cont(y, 0.75::DOUBLE) - quantile_cont(y, 0.25::DOUBLE) AS ti, quantile_cont(b, 0.75::DOUBLE) - quantile_cont(b, 0.25::DOUBLE) AS bi FROM e GROUP BY facade_id)
        SELECT facade_id, top, bottom, height FROM s WHERE n >= 3 AND bottom > top AND ti <= greatest(18.0::DOUBLE, height * 0.35::DOUBLE) AND bi <= greatest(18.0::DOUBLE, height * 0.35::DOUBLE) * 1.10::DOUBLE""",
    "attached_volumes": f"""{duck("v_facade")} SELECT a.facade_id, b.facade_id AS other_id FROM v_facade a JOIN v_facade b ON a.image_id = b.image_id AND a.facade_id <> b.facade_id
        WHERE b.w / a.w::DOUBLE BETWEEN 0.10 AND 0.78 AND b.h / a.h::DOUBLE BETWEEN 0.16 AND 0.98 AND greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) >= least(a.w, b.w) * 0.45::DOUBLE
          AND b.y < a.y - greatest(16, round_even(a.h * 0.04::DOUBLE, 0)) AND b.y + b.h >= a.y - greatest(20, round_even(a.h * 0.14::DOUBLE, 0))""",
    "geometry_warnings": f"""{duck("v_facade")}, k AS (SELECT *, facade_id AS c FROM v_facade) SELECT c AS case_id, 'side_at_border' AS warning FROM k WHERE x <= 10 OR x + w >= 1990 UNION ALL SELECT c, 'top_at_border' FROM k WHERE y <= 10
        UNION ALL SELECT c, 'socle_outside' FROM k WHERE c % 9 > 5 OR c % 8 > 5 UNION ALL SELECT c, 'below_socle' FROM k WHERE c % 25 > 18 UNION ALL SELECT c, 'gable_cut' FROM k WHERE c % 3 = 0 AND w < 900 """
        + " ".join(f"UNION ALL SELECT c, '{k}_iou_low' FROM k WHERE c % {m} = 0 AND c % 100 / 100.0::DOUBLE < {v}" for k, v, m in IOUS),
    "scaled_boxes": f"""{duck("v_element")} SELECT element_id, round_even(x * 640.0::DOUBLE / 2180.0::DOUBLE, 0)::BIGINT AS x, round_even(y * 480.0::DOUBLE / 1180.0::DOUBLE, 0)::BIGINT AS y, greatest(round_even(w * 640.0::DOUBLE / 2180.0::DOUBLE, 0)::BIGINT, 1) AS w, greatest(round_even(h * 480.0::DOUBLE / 1180.0::DOUBLE, 0)::BIGINT, 1) AS h FROM v_element""",
    "width_gate": f"{INSIDE} SELECT region_id, w / fw::DOUBLE >= 0.020 AND (w / fw::DOUBLE >= 0.035 OR h / fh::DOUBLE >= 0.16) AS wide FROM e",
    "socle_lines": f"""{duck("v_pixel")}, p AS (SELECT image_id, x::DOUBLE AS x, y::DOUBLE AS y FROM v_pixel WHERE v > 0), c AS (SELECT image_id, quantile_cont(y, 0.35::DOUBLE) AS cut FROM p GROUP BY image_id)
        SELECT image_id AS contour_id, count(*) AS n, round(regr_slope(y, x), 6) + 0.0::DOUBLE AS slope, round(regr_intercept(y, x), 6) + 0.0::DOUBLE AS intercept FROM p JOIN c USING (image_id) WHERE y <= cut GROUP BY image_id HAVING count(*) >= 6 AND regr_slope(y, x) IS NOT NULL AND NOT isnan(regr_slope(y, x))""",
    "inferred_facades": f"""{duck("v_element")}, s AS (SELECT facade_id AS image_id, y // 250 AS row, element_id, x, y, w, h, max(x + w) OVER (PARTITION BY facade_id, y // 250 ORDER BY x, element_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_element),
        p AS (SELECT *, (sum((reach IS NULL OR x - reach > greatest(220, 3 * w))::INT) OVER (PARTITION BY image_id, row ORDER BY x, element_id))::INT AS part FROM s),
        b AS (SELECT image_id, row::INT AS row, part, greatest(min(x) - 40, 0) AS x, greatest(min(y) - 40, 0) AS y, max(x + w) + 40 AS r, max(y + h) + 40 AS b FROM p GROUP BY image_id, row, part) SELECT image_id, row, part, x, y, greatest(r - x, 120) AS w, greatest(b - y, 90) AS h FROM b""",
    "label_counts": f"""{duck("v_element")} SELECT side, count(*) FILTER (WHERE kind = 'window') AS "window", count(*) FILTER (WHERE kind = 'door') AS door FROM v_element GROUP BY side""",
    "largest_facade": f"""{duck("v_facade")} SELECT image_id, arg_max(facade_id, (w * h, -facade_id)) AS facade_id FROM v_facade GROUP BY image_id""",
    "area_tokens": f"{MEASURED} SELECT token_id, coalesce(unit = 'm²', false) AS is_area, coalesce(unit = 'm' AND value > 0.1 AND value < 50, false) AS is_size FROM m",
    "truth_templates": f"""{duck("v_facade", "v_element")} SELECT facade_id, '{{"sample_id":"' || facade_id || '","facades":[],"windows":[],"doors":[]}}' AS template FROM v_facade WHERE facade_id NOT IN (SELECT facade_id FROM v_element WHERE side = 'O')""",
    "processed_pairs": f"""{duck("v_facade")} SELECT facade_id, 'Casa ' || facade_id || '_raw.PNG' AS raw, 'casa ' || facade_id || '_procesat.png' AS processed FROM v_facade WHERE facade_id % 3 = 0""",
}
