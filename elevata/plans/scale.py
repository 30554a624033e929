"""Queries over scales, sizes and signal quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import measurement
from ..operators import scale as S
from ..sources.adapter import duck, view
from .text import MEASURED


def _inputs(spark, sf):
    """Tokens and facades of one image each order; facades as boxes."""
    t = view(spark, sf, "v_token").withColumn("m", measurement(F.col("text")))
    t = t.filter("m.unit = 'm'").select("image_id", "token_id", F.floor((2 * F.col("x") + F.col("w")) / 2).alias("cx"), F.floor((2 * F.col("y") + F.col("h")) / 2).alias("cy"), "m.value")
    f = view(spark, sf, "v_facade").select(F.col("facade_id").alias("image_id"), "facade_id", *"xywh")
    return t, f


def _elements(spark, sf):
    e = view(spark, sf, "v_element").withColumn("area_px", F.col("w") * F.col("h"))
    return e.select(F.col("facade_id").alias("image_id"), "element_id", "kind", "w", "h", "area_px", (F.col("score") % 2 == 0).alias("read"), F.when(F.col("known"), F.col("w_cm") * F.col("h_cm") / 10000.0).alias("area_m2"))


def calibrate_linear(spark, sf):
    cues = S.linear_cues(*_inputs(spark, sf))
    manual = view(spark, sf, "v_facade").filter("facade_id % 10 = 0").select(F.col("facade_id").alias("image_id"), (F.col("w") / 10.0).alias("manual"))
    return S.linear_scale(cues, manual).select("image_id", F.round("px_per_m", 6).alias("px_per_m"))


def area_scale(spark, sf):
    return S.area_scale(_elements(spark, sf), S.linear_scale(S.linear_cues(*_inputs(spark, sf)))).select("image_id", F.round("px_per_m2", 6).alias("px_per_m2"))


def element_dims(spark, sf):
    linear = view(spark, sf, "v_facade").select(F.col("facade_id").alias("image_id"), (F.col("w") / 12.0).alias("px_per_m"))
    out = S.element_sizes(_elements(spark, sf), linear)
    return out.select("element_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("width_m", "height_m", "area_m2")))


def missing_areas(spark, sf):
    scale = view(spark, sf, "v_facade").select(F.col("facade_id").alias("image_id"), (F.col("w") * 2.0).alias("px_per_m2"))
    return S.missing_areas(_elements(spark, sf), scale).select("element_id", F.round(F.coalesce("area_m2", F.lit(0.0)), 6).alias("area_m2"))


def facade_area_from_scale(spark, sf):
    f = view(spark, sf, "v_facade")
    facades = f.select("image_id", "facade_id", (F.col("w") * F.col("h")).alias("area_px"), F.when(F.col("facade_id") % 3 == 0, F.col("total_cm2") / 10000.0).alias("area_m2"))
    scale = f.groupBy("image_id").agg((F.max("w") * 3.0).alias("px_per_m2"))
    return S.facade_areas(facades, scale).select("facade_id", F.round(F.coalesce("area_m2", F.lit(0.0)), 6).alias("area_m2"))


def scale_ratio_vote(spark, sf):
    words = F.array(*map(F.lit, ("SCARA ", "plan", "SCR ", "SC ", "sc. ", "Scale ", "")))
    ratio = F.when(F.col("score") % 4 == 0, F.concat(F.col("w"), F.lit(":1"))).when(F.col("score") % 4 == 1, F.concat(F.lit("l | "), F.col("w"))).otherwise(F.concat(F.lit("I:"), F.col("w") % 4 * 25 + 25))
    text = F.concat(F.element_at(words, (F.col("score") % 7 + 1).cast("int")), ratio)
    t = view(spark, sf, "v_element").select(F.col("facade_id").alias("image_id"), F.col("element_id").alias("token_id"), text.alias("text"), (F.col("score") / 100.0).alias("confidence"))
    return S.ratio_votes(t)


def page_geometry(spark, sf):
    f = view(spark, sf, "v_facade")
    g = S.page_geometry(F.col("w") * 2, F.col("h") * 2, F.col("w"), F.lit(12.5), F.lit(50.0))
    return f.select("facade_id", S.assumed_scale(F.lit(50.0), F.col("w").cast("double")).alias("assumed"), g.alias("g")).select("facade_id", F.round("assumed", 6).alias("assumed"), *(F.round(f"g.{c}", 6).alias(c) for c in ("dpi", "width_mm", "height_mm")))


def _metrics(spark, sf):
    f = view(spark, sf, "v_facade")
    facades = f.select(F.col("facade_id").alias("image_id"), F.when(F.col("facade_id") % 3 > 0, F.col("total_cm2") / 10000.0).otherwise(0.0).alias("area_m2"), F.when(F.col("facade_id") % 4 == 0, 1.0).otherwise(0.0).alias("socle_m2"), F.when(F.col("facade_id") % 5 == 0, "colour").otherwise("ocr").alias("origin"))
    e = _elements(spark, sf).withColumn("origin", F.when(F.col("read"), "ocr").otherwise("colour")).withColumn("width_m", F.when(F.col("w") > 60, F.col("w") / 50.0)).withColumn("height_m", F.col("h") / 50.0)
    return S.signal_metrics(facades, e)


def signal_metrics(spark, sf):
    return _metrics(spark, sf)


def warnings(spark, sf):
    return S.warnings(_metrics(spark, sf).withColumn("px_per_m", F.when(F.col("image_id") % 2 == 0, 50.0)))


E_SQL = "e AS (SELECT facade_id AS image_id, element_id, kind, w, h, w * h AS area_px, score % 2 = 0 AS read, CASE WHEN known THEN w_cm * h_cm / 10000.0::DOUBLE END AS area_m2 FROM v_element)"
BETWEEN = "CASE kind WHEN 'window' THEN {0} BETWEEN {1} WHEN 'door' THEN {0} BETWEEN {2} ELSE {0} BETWEEN {3} END"
CUES = f"""{MEASURED}, v_facade AS ({duck("v_facade").split("v_facade AS (", 1)[1]},
  n AS (SELECT t.token_id, t.image_id, arg_min(struct_pack(x := f.x, y := f.y, w := f.w, h := f.h), f.facade_id) AS f, min(sqrt((greatest(f.x - cx, cx - (f.x + f.w), 0) * greatest(f.x - cx, cx - (f.x + f.w), 0) + greatest(f.y - cy, cy - (f.y + f.h), 0) * greatest(f.y - cy, cy - (f.y + f.h), 0))::DOUBLE)) AS far,
         any_value(cx) AS cx, any_value(cy) AS cy, any_value(value) AS value FROM m t JOIN v_facade f ON t.image_id = f.facade_id WHERE unit = 'm' AND value BETWEEN 0.4 AND 30 GROUP BY t.token_id, t.image_id),
  d AS (SELECT *, least(abs(cy - f.y), abs(cy - f.y - f.h)) AS lv, least(abs(cx - f.x), abs(cx - f.x - f.w)) AS sd FROM n WHERE far <= 140),
  k AS (SELECT *, lv <= greatest(30, floor(f.h * 0.12::DOUBLE)) AS nl, sd <= greatest(30, floor(f.w * 0.12::DOUBLE)) AS ns FROM d),
  cues AS (SELECT image_id, f.w / value AS cue FROM k WHERE nl OR (NOT nl AND NOT ns AND far <= 30 AND lv <= sd) UNION ALL SELECT image_id, f.h / value FROM k WHERE ns OR (NOT nl AND NOT ns AND far <= 30 AND lv > sd)),
  fine AS (SELECT * FROM cues WHERE cue BETWEEN 5 AND 3000),
  mid AS (SELECT image_id, median(cue) AS m FROM fine GROUP BY image_id HAVING count(*) >= 2),
  lin AS (SELECT image_id, median(cue) AS px_per_m FROM fine JOIN mid USING (image_id) WHERE abs(cue - m) <= m * 0.35::DOUBLE GROUP BY image_id HAVING count(*) >= 2)"""
QUERIES = {f.__name__: f for f in (calibrate_linear, area_scale, element_dims, missing_areas, facade_area_from_scale, scale_ratio_vote, page_geometry, signal_metrics, warnings)}
METRICS = f"""{duck("v_facade", "v_element")}, {E_SQL},
  f AS (SELECT facade_id AS image_id, facade_id % 3 > 0 AND total_cm2 > 0 AS area, facade_id % 4 = 0 AS socle, facade_id % 5 = 0 AS colour FROM v_facade),
  fs AS (SELECT image_id, count(*) FILTER (WHERE NOT colour) AS facades_total, count(*) FILTER (WHERE NOT colour AND area) AS facades_with_area, count(*) FILTER (WHERE socle) AS facades_with_socle_exclusion, count(*) FILTER (WHERE colour) AS color_facades FROM f GROUP BY image_id),
  es AS (SELECT image_id, count(*) FILTER (WHERE read AND kind = 'window') AS ocr_windows, count(*) FILTER (WHERE read AND kind = 'door') AS ocr_doors, count(*) FILTER (WHERE read AND area_m2 > 0) AS ocr_elements_with_area,
                count(*) FILTER (WHERE read AND w > 60) AS elements_with_dimensions, count(*) FILTER (WHERE NOT read AND kind = 'window') AS color_windows, count(*) FILTER (WHERE NOT read AND kind = 'door') AS color_doors FROM e GROUP BY image_id),
  sm AS (SELECT image_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("facades_total", "facades_with_area", "facades_with_socle_exclusion", "color_facades", "ocr_windows", "ocr_doors", "ocr_elements_with_area", "elements_with_dimensions", "color_windows", "color_doors"))} FROM fs FULL JOIN es USING (image_id))"""
ORACLES = {
    "calibrate_linear": f"""{CUES}, man AS (SELECT facade_id AS image_id, w / 10.0::DOUBLE AS manual FROM v_facade WHERE facade_id % 10 = 0)
        SELECT image_id, round(CASE WHEN manual > 0 THEN coalesce(manual * 0.7::DOUBLE + px_per_m * 0.3::DOUBLE, manual) ELSE px_per_m END, 6) AS px_per_m FROM lin FULL JOIN man USING (image_id)""",
    "area_scale": f"""{CUES}, {E_SQL}, r AS (SELECT image_id, median(area_px / area_m2) AS m FROM e WHERE area_m2 > 0 AND area_px / area_m2 BETWEEN 10 AND 500000 GROUP BY image_id HAVING count(*) >= 2)
        SELECT image_id, round(CASE WHEN m IS NULL THEN px_per_m * px_per_m WHEN px_per_m IS NULL OR NOT m / (px_per_m * px_per_m) BETWEEN 0.25 AND 4.0 THEN m ELSE m * 0.7::DOUBLE + px_per_m * px_per_m * 0.3::DOUBLE END, 6) AS px_per_m2 FROM r FULL JOIN lin USING (image_id)""",
    "element_dims": f"""{duck("v_facade", "v_element")}, {E_SQL}, s AS (SELECT e.*, e.w / (f.w / 12.0::DOUBLE) AS wm, e.h / (f.w / 12.0::DOUBLE) AS hm FROM e JOIN v_facade f ON e.image_id = f.facade_id),
        k AS (SELECT *, {BETWEEN.format("wm", "0.2 AND 8.0", "0.5 AND 5.0", "0.05 AND 50.0")} AND {BETWEEN.format("hm", "0.2 AND 5.0", "1.4 AND 5.0", "0.05 AND 50.0")} AS fine FROM s)
        SELECT element_id, CASE WHEN fine THEN wm ELSE 0 END AS width_m, CASE WHEN fine THEN hm ELSE 0 END AS height_m,
               coalesce(area_m2, CASE WHEN fine AND {BETWEEN.format("wm * hm", "0.15 AND 15.0", "0.5 AND 6.5", "0.01 AND 5000.0")} THEN wm * hm END, 0) AS area_m2 FROM k""",
    "missing_areas": f"""{duck("v_facade", "v_element")}, {E_SQL}, k AS (SELECT e.*, area_px / (f.w * 2.0::DOUBLE) AS a FROM e JOIN v_facade f ON e.image_id = f.facade_id)
        SELECT element_id, round(coalesce(area_m2, CASE WHEN (kind <> 'door' OR read) AND {BETWEEN.format("a", "0.15 AND 15.0", "0.5 AND 6.5", "0.01 AND 5000.0")} THEN a END, 0), 6) AS area_m2 FROM k""",
    "facade_area_from_scale": f"""{duck("v_facade")}, s AS (SELECT image_id, max(w) * 3.0::DOUBLE AS p FROM v_facade GROUP BY image_id)
        SELECT facade_id, round(CASE WHEN facade_id % 3 = 0 THEN total_cm2 / 10000.0::DOUBLE WHEN w * h / p BETWEEN 2 AND 5000 THEN w * h / p ELSE 0 END, 6) AS area_m2 FROM v_facade JOIN s USING (image_id)""",
    "scale_ratio_vote": f"""{duck("v_element")},
        t AS (SELECT facade_id AS image_id, element_id, least(greatest(score / 100.0::DOUBLE, 0.05::DOUBLE), 1.0::DOUBLE) AS sure,
                     translate(upper(['SCARA ', 'plan', 'SCR ', 'SC ', 'sc. ', 'Scale ', ''][score % 7 + 1] || CASE score % 4 WHEN 0 THEN w || ':1' WHEN 1 THEN 'l | ' || w ELSE 'I:' || (w % 4 * 25 + 25) END), 'IL', '11') AS text FROM v_element),
        r AS (SELECT *, unnest(regexp_extract_all(text, '1\\s*[:/\\\\|]\\s*(\\d{{2,4}})', 1))::INT AS den, false AS back FROM t
              UNION ALL SELECT *, unnest(regexp_extract_all(text, '(\\d{{2,4}})\\s*[:/\\\\|]\\s*1', 1))::INT, true FROM t),
        k AS (SELECT *, regexp_matches(text, 'SCA?R|SC\\.') AS word FROM r WHERE den BETWEEN 10 AND 1000),
        v AS (SELECT image_id, den, round(sum(CASE WHEN back THEN sure * 0.8::DOUBLE + CASE WHEN word THEN 0.4::DOUBLE ELSE 0 END ELSE sure + CASE WHEN word THEN 0.5::DOUBLE ELSE 0 END END
                     + CASE WHEN den IN (20, 25, 50, 75, 100, 125, 200, 250) THEN 0.15::DOUBLE ELSE 0 END), 6) AS score, min((element_id, back)) AS first FROM k GROUP BY image_id, den)
        SELECT image_id, arg_max(den, (score, -first[1], NOT first[2])) AS ratio, max(score) AS score FROM v GROUP BY image_id""",
    "page_geometry": f"""{duck("v_facade")}, g AS (SELECT facade_id, w, h, w / (12.5::DOUBLE * 20.0::DOUBLE / 25.4::DOUBLE) AS dpi FROM v_facade)
        SELECT facade_id, round(CASE WHEN abs(w - 254.0::DOUBLE) <= 254.0::DOUBLE * 0.15::DOUBLE THEN w ELSE 254 END * 39.37007874::DOUBLE / 50.0::DOUBLE, 6) AS assumed, round(dpi, 6) AS dpi, round(w * 2 / dpi * 25.4::DOUBLE, 6) AS width_mm, round(h * 2 / dpi * 25.4::DOUBLE, 6) AS height_mm FROM g""",
    "signal_metrics": f"{METRICS} SELECT * FROM sm",
    "warnings": f"""{METRICS} SELECT image_id, 'no_signal' AS code, 'high' AS severity FROM sm WHERE facades_with_area = 0 AND ocr_elements_with_area = 0
        UNION ALL SELECT image_id, 'no_facade', 'high' FROM sm WHERE facades_total = 0 AND color_facades = 0
        UNION ALL SELECT image_id, 'no_scale', 'high' FROM sm WHERE facades_total > 0 AND facades_with_area = 0 AND image_id % 2 <> 0
        UNION ALL SELECT image_id, 'no_lengths', 'low' FROM sm WHERE ocr_windows + ocr_doors > 0 AND elements_with_dimensions = 0""",
}
