"""Queries that match regions, labels and facades."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.boxes import Box
from ..operators import correlate as C
from ..operators import matching as M
from ..sources.adapter import duck, view
from .duck import greedy, inter


def _elements(spark, sf):
    """Openings with the facade as their image."""
    return view(spark, sf, "v_element").withColumnRenamed("facade_id", "image_id")


def match_titles_areas(spark, sf):
    t = view(spark, sf, "v_token")
    centre = [F.floor((2 * F.col("x") + F.col("w")) / 2), F.floor((2 * F.col("y") + F.col("h")) / 2)]
    titles = t.filter("text = 'FATADA'").select("image_id", F.col("token_id").alias("title_id"), centre[0].alias("cx"), centre[1].alias("cy"))
    areas = t.filter("text LIKE '%m²' OR text LIKE '%mp'").select("image_id", F.col("token_id").alias("area_id"), centre[0].alias("ax"), centre[1].alias("ay"))
    out = C.match_titles(titles, areas)
    return out.select("image_id", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("title_id", "area_id")))


def match_facade_regions(spark, sf):
    f = view(spark, sf, "v_facade")
    labels = f.select("image_id", F.col("facade_id").alias("label_id"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    regions = f.select("image_id", F.col("facade_id").alias("region_id"), *"xywh")
    out = C.match_regions(labels, regions, 600)
    return out.select("image_id", "label_id", F.coalesce("region_id", F.lit(-1)).alias("region_id"))


def match_color_ocr(spark, sf):
    e = _elements(spark, sf)
    ix, iy = F.floor((2 * F.col("x") + F.col("w")) / 2), F.floor((2 * F.col("y") + F.col("h")) / 2)
    ocr = e.filter("side = 'F'").select("image_id", F.col("element_id").alias("ocr_id"), "kind", F.col("label").alias("key"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    colour = e.filter("side = 'O'").select("image_id", F.col("element_id").alias("colour_id"), "kind", F.col("label").alias("ckey"), ix.alias("px"), iy.alias("py"))
    out = C.match_elements(ocr, colour)
    return out.select("image_id", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("ocr_id", "colour_id")))


def nms_regions(spark, sf):
    e = _elements(spark, sf).select("image_id", F.col("element_id").alias("region_id"), *"xywh")
    return M.suppress(e, "image_id")


def _positions(spark, sf):
    f = view(spark, sf, "v_facade")
    e = view(spark, sf, "v_element").join(f.select("facade_id", "image_id"), "facade_id")
    e = e.select("image_id", "element_id", F.col("x").alias("px"), F.col("y").alias("py"))
    return e, f.select("image_id", "facade_id", F.col("facade_id").alias("ord"), F.col("x").alias("lx"), F.col("y").alias("ly"), *"xywh")


def assign_parents(spark, sf):
    return M.first_holding(*_positions(spark, sf), "image_id")


def regions_inside(spark, sf):
    e, f = _positions(spark, sf)
    slack = F.greatest(F.lit(8.0), F.col("fw") * 0.025)
    boxes = f.select("image_id", "facade_id", *(F.col(c).alias("f" + c) for c in "xywh"))
    return e.join(boxes, "image_id").filter(Box.of("f").holds(F.col("px"), F.col("py"), slack)).groupBy("facade_id").agg(F.count("*").alias("n_inside"))


def filter_proximity(spark, sf):
    e, f = _positions(spark, sf)
    return C.near_facades(e, f).select("element_id")


def estimate_regions(spark, sf):
    f = view(spark, sf, "v_facade").select("image_id", F.col("facade_id").alias("label_id"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    return C.estimated_regions(f, 2000, 1200)


def enrich_regions(spark, sf):
    t = view(spark, sf, "v_token")
    from ..functions.text import measurement

    t = t.withColumn("m", measurement(F.col("text"))).select("image_id", "token_id", "text", F.floor((2 * F.col("x") + F.col("w")) / 2).alias("cx"), F.floor((2 * F.col("y") + F.col("h")) / 2).alias("cy"), "m.*")
    regions = _elements(spark, sf).select("image_id", F.col("element_id").alias("region_id"), "kind", "x", "y", (F.col("w") * 4).alias("w"), (F.col("h") * 4).alias("h"))
    out = C.enriched(regions, t)
    return out.select("region_id", "n_sizes", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("area_m2", "width_m", "height_m")), F.coalesce("label", F.lit("")).alias("label"), "texts")


def row_groups_gap(spark, sf):
    """Rows of openings: a step in centre height over max(42, 12 %) begins
    the next one."""
    e = view(spark, sf, "v_element").join(view(spark, sf, "v_facade").select("facade_id", F.col("h").alias("fh")), "facade_id").withColumn("cy", Box.of().cy)
    order = Window.partitionBy("facade_id").orderBy("cy", "element_id")
    step = F.col("cy") - F.lag("cy").over(order) > F.greatest(F.lit(42.0), F.col("fh") * 0.12)
    return e.withColumn("begins", F.when(step, 1).otherwise(0)).select("element_id", (F.sum("begins").over(order) + 1).cast("int").alias("row"))


def x_clusters(spark, sf):
    e = _elements(spark, sf).withColumnRenamed("element_id", "region_id")
    return M.merge_overlapping(e, "image_id", 60).select("region_id", "cluster")


def relabel(spark, sf):
    """Openings numbered from the top left, by kind."""
    rank = F.row_number().over(Window.partitionBy("facade_id", "kind").orderBy("y", "x", "element_id"))
    return view(spark, sf, "v_element").select("element_id", F.concat(F.when(F.col("kind") == "door", "U_").otherwise("F_"), rank.cast("string")).alias("label"))


def adjacent_pairs(spark, sf):
    """Neighbours along x, with the gap between them."""
    order = Window.partitionBy("facade_id").orderBy("x", "element_id")
    e = view(spark, sf, "v_element").withColumn("right_id", F.lead("element_id").over(order)).withColumn("next_x", F.lead("x").over(order))
    return e.filter("right_id IS NOT NULL").select("element_id", "right_id", F.greatest(F.col("next_x") - F.col("x") - F.col("w"), F.lit(0)).alias("gap"))


def merge_fragments(spark, sf):
    """Window fragments side by side joined to a fixpoint. The windows are
    moved into their facade, so that the rules have work to do."""
    from ..operators.openings import merged_fragments

    f = view(spark, sf, "v_facade").select("facade_id", *(F.col(c).alias("f" + c) for c in "xywh"))
    e = view(spark, sf, "v_element").filter("kind = 'window'").join(f, "facade_id")
    moved = [(F.col("fx") + F.col("x") % F.col("fw")).alias("x"), (F.col("fy") + F.col("y") % F.col("fh")).alias("y")]
    return merged_fragments(e.select("facade_id", F.col("element_id").alias("region_id"), *moved, "w", "h", "fy", "fw", "fh"))


def row_groups_median(spark, sf):
    """Rows by distance to the running median of the last row."""
    from ..operators.openings import median_rows

    e = view(spark, sf, "v_element").join(view(spark, sf, "v_facade").select("facade_id", F.col("h").alias("fh")), "facade_id")
    return median_rows(e.select("facade_id", F.col("element_id").alias("region_id"), "y", "fh"))


POS = f"""{duck("v_facade", "v_element")}, e AS (SELECT f.image_id, element_id, e.x AS px, e.y AS py FROM v_element e JOIN v_facade f ON e.facade_id = f.facade_id)"""
OUT = "sqrt((greatest(f.x - px, px - (f.x + f.w), 0) * greatest(f.x - px, px - (f.x + f.w), 0) + greatest(f.y - py, py - (f.y + f.h), 0) * greatest(f.y - py, py - (f.y + f.h), 0))::DOUBLE)"
QUERIES = {f.__name__: f for f in (match_titles_areas, match_facade_regions, match_color_ocr, nms_regions, assign_parents, regions_inside, filter_proximity, estimate_regions, enrich_regions, row_groups_gap, x_clusters, relabel, adjacent_pairs, merge_fragments, row_groups_median)}
FAR = "sqrt(((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))::DOUBLE)"
TOKENS = "c AS (SELECT image_id, token_id, text, x + w // 2 AS cx, y + h // 2 AS cy FROM v_token)"
ORACLES = {
    "match_titles_areas": f"""{duck("v_token", recursive=True)}, {TOKENS},
        t AS (SELECT image_id, token_id AS title_id, cx, cy FROM c WHERE text = 'FATADA'), ar AS (SELECT image_id, token_id AS area_id, cx, cy FROM c WHERE text LIKE '%m²' OR text LIKE '%mp'),
        p AS (SELECT a.image_id, title_id, area_id, {FAR} AS d FROM t a JOIN ar b ON a.image_id = b.image_id WHERE {FAR} < 500), {greedy("p", "image_id", "title_id", "area_id", "d, title_id, area_id")}
        SELECT t.image_id, t.title_id, coalesce(area_id, -1) AS area_id FROM t LEFT JOIN chosen USING (image_id, title_id)
        UNION ALL SELECT image_id, -1, area_id FROM ar WHERE area_id NOT IN (SELECT area_id FROM chosen)""",
    "match_facade_regions": f"""{duck("v_facade", recursive=True)}, a AS (SELECT image_id, facade_id AS label_id, x AS cx, y AS cy FROM v_facade),
        b AS (SELECT image_id, facade_id AS region_id, x + w // 2 AS cx, y + h // 2 AS cy FROM v_facade),
        p AS (SELECT a.image_id, label_id, region_id, {FAR} AS d FROM a JOIN b ON a.image_id = b.image_id WHERE {FAR} <= 600), {greedy("p", "image_id", "label_id", "region_id", "d, label_id, region_id")}
        SELECT a.image_id, a.label_id, coalesce(region_id, -1) AS region_id FROM a LEFT JOIN chosen USING (image_id, label_id)""",
    "match_color_ocr": f"""{duck("v_element", recursive=True)}, a AS (SELECT facade_id AS image_id, element_id AS ocr_id, kind, label, x AS cx, y AS cy FROM v_element WHERE side = 'F'),
        b AS (SELECT facade_id AS image_id, element_id AS colour_id, kind, label, x + w // 2 AS cx, y + h // 2 AS cy FROM v_element WHERE side = 'O'),
        p AS (SELECT a.image_id, ocr_id, colour_id, a.kind, {FAR} AS d, {FAR} + CASE WHEN a.label <> b.label AND {FAR} > 60 THEN 120 ELSE 0 END AS cost FROM a JOIN b ON a.image_id = b.image_id AND a.kind = b.kind),
        q AS (SELECT * FROM p WHERE d <= CASE kind WHEN 'door' THEN 240 ELSE 220 END), {greedy("q", "image_id", "ocr_id", "colour_id", "cost, ocr_id, colour_id")}
        SELECT a.image_id, a.ocr_id, coalesce(colour_id, -1) AS colour_id FROM a LEFT JOIN chosen USING (image_id, ocr_id)
        UNION ALL SELECT image_id, -1, colour_id FROM b WHERE colour_id NOT IN (SELECT colour_id FROM chosen)""",
    "nms_regions": f"""{duck("v_element", recursive=True)}, seq AS (SELECT facade_id AS g, element_id AS region_id, x, y, w, h, row_number() OVER (PARTITION BY facade_id ORDER BY w * h DESC, element_id) AS k FROM v_element),
        clash AS (SELECT a.g, a.k AS earlier, b.k AS later FROM seq a JOIN seq b ON a.g = b.g AND a.k < b.k
                  WHERE {inter("a", "b")} > 0 AND ({inter("a", "b")}::DOUBLE / greatest(a.w * a.h + b.w * b.h - {inter("a", "b")}, 1) > 0.30 OR {inter("a", "b")}::DOUBLE / greatest(least(a.w * a.h, b.w * b.h), 1) >= 0.72)),
        lists AS (SELECT g, later, list(earlier) AS es FROM clash GROUP BY g, later),
        walk AS (SELECT g, k, [k] AS kept FROM seq WHERE k = 1
          UNION ALL SELECT seq.g, seq.k, CASE WHEN es IS NOT NULL AND len(list_intersect(es, kept)) > 0 THEN kept ELSE list_append(kept, seq.k) END
          FROM walk JOIN seq ON seq.g = walk.g AND seq.k = walk.k + 1 LEFT JOIN lists ON lists.g = seq.g AND lists.later = seq.k),
        ended AS (SELECT g, unnest(arg_max(kept, k)) AS k FROM walk GROUP BY g)
        SELECT g AS image_id, region_id, x, y, w, h FROM seq JOIN ended USING (g, k)""",
    "assign_parents": f"""{POS}, p AS (SELECT e.image_id, element_id, facade_id, px BETWEEN x AND x + w AND py BETWEEN y AND y + h AS inside, ((px - x) * (px - x) + (py - y) * (py - y))::DOUBLE AS far FROM e LEFT JOIN v_facade f ON e.image_id = f.image_id)
        SELECT image_id, element_id, arg_min(facade_id, (NOT inside, CASE WHEN inside THEN 0 ELSE far END, facade_id)) AS facade_id FROM p GROUP BY image_id, element_id""",
    "regions_inside": f"""{POS} SELECT facade_id, count(*) AS n_inside FROM e JOIN v_facade f ON e.image_id = f.image_id
        WHERE px BETWEEN x - greatest(8.0::DOUBLE, w * 0.025::DOUBLE) AND x + w + greatest(8.0::DOUBLE, w * 0.025::DOUBLE) AND py BETWEEN y - greatest(8.0::DOUBLE, w * 0.025::DOUBLE) AND y + h + greatest(8.0::DOUBLE, w * 0.025::DOUBLE) GROUP BY facade_id""",
    "filter_proximity": f"""{POS}, f AS (SELECT * FROM v_facade) SELECT element_id FROM e
        WHERE image_id NOT IN (SELECT image_id FROM f) OR EXISTS (SELECT 1 FROM f WHERE f.image_id = e.image_id AND {OUT} <= 80)""",
    "estimate_regions": f"""{duck("v_facade")}, p AS (SELECT a.image_id, a.facade_id AS label_id, a.x AS fx, a.y AS fy, b.x AS ox, b.y AS oy, a.facade_id <> b.facade_id AS other, abs(b.y - a.y) < 80 AS row FROM v_facade a JOIN v_facade b ON a.image_id = b.image_id),
        s AS (SELECT image_id, label_id, fx, fy, min((fx + ox) // 2) FILTER (WHERE other AND row AND ox > fx) AS r, max((fx + ox) // 2) FILTER (WHERE other AND row AND ox <= fx) AS l,
                     min((fy + oy) // 2) FILTER (WHERE other AND NOT row AND oy > fy) AS b, max((fy + oy) // 2) FILTER (WHERE other AND NOT row AND oy < fy) AS t FROM p GROUP BY image_id, label_id, fx, fy),
        k AS (SELECT image_id, label_id, greatest(0, fx - 666, coalesce(l, 0)) AS l, least(2000, fx + 666, coalesce(r, 2000)) AS r, greatest(0, fy - 200, coalesce(t, 0)) AS t, least(1200, fy + 300, coalesce(b, 1200)) AS b FROM s)
        SELECT image_id, label_id, l AS x, t AS y, greatest(1, r - l) AS w, greatest(1, b - t) AS h FROM k""",
    "row_groups_gap": f"""{duck("v_facade", "v_element")}, e AS (SELECT element_id, e.facade_id, e.y + e.h * 0.5::DOUBLE AS cy, f.h AS fh FROM v_element e JOIN v_facade f ON e.facade_id = f.facade_id),
        s AS (SELECT *, coalesce(cy - lag(cy) OVER (PARTITION BY facade_id ORDER BY cy, element_id) > greatest(42.0::DOUBLE, fh * 0.12::DOUBLE), false)::INT AS begins FROM e)
        SELECT element_id, (1 + sum(begins) OVER (PARTITION BY facade_id ORDER BY cy, element_id))::INT AS row FROM s""",
    "x_clusters": f"""{duck("v_element")}, s AS (SELECT *, max(x + w) OVER (PARTITION BY facade_id ORDER BY x, y, element_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_element)
        SELECT element_id AS region_id, (sum((reach IS NULL OR x - reach > 60)::INT) OVER (PARTITION BY facade_id ORDER BY x, y, element_id))::INT AS cluster FROM s""",
    "relabel": f"""{duck("v_element")} SELECT element_id, CASE kind WHEN 'door' THEN 'U_' ELSE 'F_' END || row_number() OVER (PARTITION BY facade_id, kind ORDER BY y, x, element_id) AS label FROM v_element""",
    "adjacent_pairs": f"""{duck("v_element")}, s AS (SELECT element_id, lead(element_id) OVER o AS right_id, greatest(lead(x) OVER o - x - w, 0) AS gap FROM v_element WINDOW o AS (PARTITION BY facade_id ORDER BY x, element_id))
        SELECT * FROM s WHERE right_id IS NOT NULL""",
}
