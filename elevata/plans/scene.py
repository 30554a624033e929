"""Queries over openings and scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boxes import Box
from ..operators import openings as O
from ..sources.adapter import duck, view


def _inside(spark, sf):
    """Openings moved into their facade, so that the rules have work to do."""
    f = view(spark, sf, "v_facade")
    e = view(spark, sf, "v_element").join(f.select("facade_id", *(F.col(c).alias("f" + c) for c in "xywh")), "facade_id")
    return e.select("facade_id", F.col("element_id").alias("region_id"), "kind", (F.col("fx") + F.col("x") % F.col("fw")).alias("x"), (F.col("fy") + F.col("y") % F.col("fh")).alias("y"), "w", "h", "fx", "fy", "fw", "fh")


def door_score(spark, sf):
    e = _inside(spark, sf)
    return e.select("region_id", F.round(O.door_score(Box.of("f"), Box.of(), F.col("w") * F.col("h"), F.col("region_id") % 2 + 1), 9).alias("score"))


def promoted_door(spark, sf):
    windows = _inside(spark, sf).select("facade_id", "region_id", *"xywh")
    return O.promoted_doors(view(spark, sf, "v_facade"), windows).withColumn("score", F.round("score", 9))


def gap_fit(spark, sf):
    e = _inside(spark, sf)
    gap = F.col("region_id") % 150
    left = Box(F.col("x") - 60 - F.floor(gap / 2), F.col("y"), F.lit(60), F.col("h"))
    right = Box(F.col("x") + F.col("w") + F.floor(gap / 3), F.col("y"), F.lit(60), F.col("h"))
    out = e.select("region_id", O.fitted_door(Box.of("f"), Box.of(), left, right).alias("d")).filter("d IS NOT NULL")
    return out.select("region_id", "d.*")


def central_cluster(spark, sf):
    return O.central_cluster(view(spark, sf, "v_facade"), _inside(spark, sf).select("facade_id", "region_id", "kind", *"xywh"))


def _scenes(spark, sf):
    f = view(spark, sf, "v_facade")
    c = F.col("facade_id")
    return f.select(
        "facade_id", (c % 11 == 0).alias("merged"), "w", "h", (F.col("w") - c % 5 * 200).alias("n_columns"), (c % 6).alias("n_openings"), (F.col("h") * (c % 13) / 60.0).alias("top_iqr"), (F.col("h") * (c % 17) / 40.0).alias("top_span"),
        (F.col("h") * (c % 7) / 50.0).alias("gable_peak"), (F.col("h") * (c % 9) / 50.0).alias("top_spread"), (F.col("h") * (c % 8) / 50.0).alias("centre_spread"), (c % 10 == 1).alias("central"),
    )


def scene_class(spark, sf):
    s = _scenes(spark, sf)
    return s.select("facade_id", O.scene_class(s).alias("scene"))


def prune_openings(spark, sf):
    s = _scenes(spark, sf)
    e = _inside(spark, sf).join(s.select("facade_id", O.scene_class(s).alias("scene")), "facade_id")
    return O.scene_pruned(e.select("facade_id", "region_id", "kind", "scene", "fw", "fh", *"xywh")).select("facade_id", "region_id", "scene")


def validator_geometry(spark, sf):
    e = _inside(spark, sf)
    f, o = Box.of("f"), Box.of()
    return e.select("region_id", O.invalid_window(f, o, F.lit(2000 * 1200)).alias("invalid"), O.implausible(f, o).alias("implausible"), O.markup_window(f, o).alias("markup"))


def composite_openings(spark, sf):
    e = _inside(spark, sf).withColumn("kind", F.when((F.col("kind") == "window") & (F.col("region_id") % 3 == 0), "sidelight").otherwise(F.col("kind")))
    return O.composite_openings(e.select("facade_id", "region_id", "kind", *"xywh"))


def routed_regions(spark, sf):
    e = view(spark, sf, "v_element").withColumn("kind", F.when(F.col("score") % 9 == 0, "facade").otherwise(F.col("kind")))
    pick = lambda d: d.select(F.col("facade_id").alias("image_id"), F.col("element_id").alias("region_id"), "kind")
    images = view(spark, sf, "v_facade").select(F.col("facade_id").alias("image_id"), (F.col("facade_id") % 11 / 100.0).alias("marked_share"), (F.col("facade_id") % 2 == 0).alias("central"))
    return O.routed_regions(pick(e.filter("side = 'F'")), pick(e.filter("side = 'O'")), images)


INSIDE = f"""{duck("v_facade", "v_element")}, e AS (SELECT e.facade_id, element_id AS region_id, kind, f.x + e.x % f.w AS x, f.y + e.y % f.h AS y, e.w, e.h, f.x AS fx, f.y AS fy, f.w AS fw, f.h AS fh, f.image_id FROM v_element e JOIN v_facade f ON e.facade_id = f.facade_id)"""


def _score_sql(source: str, area: str, many: str) -> str:
    return f"""SELECT *, CASE WHEN wr BETWEEN 0.030 AND 0.32 AND hr BETWEEN 0.30 AND 0.92 AND ar BETWEEN 0.18 AND 0.72 AND cr BETWEEN 0.18 AND 0.82 AND br BETWEEN 0.58 AND 1.02 AND sr BETWEEN 0.008 AND 0.26
        THEN greatest(1 - abs(cr - 0.5::DOUBLE) / 0.32::DOUBLE, 0) * 0.34::DOUBLE + least(greatest((br - 0.58::DOUBLE) / 0.25::DOUBLE, 0), 1) * 0.28::DOUBLE + least(greatest((hr - 0.22::DOUBLE) / 0.40::DOUBLE, 0), 1) * 0.18::DOUBLE
             + greatest(1 - abs(wr - 0.13::DOUBLE) / 0.14::DOUBLE, 0) * 0.12::DOUBLE + greatest(1 - abs(ar - 0.42::DOUBLE) / 0.38::DOUBLE, 0) * 0.08::DOUBLE + CASE WHEN {many} THEN 0.08::DOUBLE ELSE 0 END ELSE -1 END AS score
        FROM (SELECT *, w / fw::DOUBLE AS wr, h / fh::DOUBLE AS hr, (y + h - fy) / fh::DOUBLE AS br, (x + w * 0.5::DOUBLE - fx) / fw AS cr, w / h::DOUBLE AS ar, {area} / (fw * fh)::DOUBLE AS sr FROM {source})"""


QUERIES = {f.__name__: f for f in (door_score, promoted_door, gap_fit, central_cluster, scene_class, prune_openings, validator_geometry, composite_openings, routed_regions)}
ORACLES = {
    "door_score": f"""{INSIDE}, s AS ({_score_sql("e", "w * h", "region_id % 2 = 1")}) SELECT region_id, round(score, 9) AS score FROM s""",
    "promoted_door": f"""{INSIDE}, i AS (SELECT * FROM e WHERE x + w * 0.5::DOUBLE BETWEEN fx AND fx + fw AND y + h * 0.5::DOUBLE BETWEEN fy AND fy + fh),
        p AS (SELECT a.facade_id, a.region_id, b.region_id AS second_id, least(a.x, b.x) AS x, least(a.y, b.y) AS y, greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) AS w, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) AS h, a.fx, a.fy, a.fw, a.fh, a.w * a.h + b.w * b.h AS area
              FROM i a JOIN i b ON a.facade_id = b.facade_id AND a.region_id < b.region_id
              WHERE abs((a.x + a.w * 0.5::DOUBLE) - (b.x + b.w * 0.5::DOUBLE)) <= greatest(42, floor(a.fw * 0.12::DOUBLE)) AND greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) >= least(a.w, b.w) * 0.30::DOUBLE
                AND greatest(greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h), 0) <= greatest(44, floor(a.fh * 0.22::DOUBLE))),
        u AS (SELECT facade_id, region_id, -1 AS second_id, x, y, w, h, fx, fy, fw, fh, w * h AS area FROM i UNION ALL SELECT * FROM p), s AS ({_score_sql("u", "area", "second_id >= 0")}),
        k AS (SELECT *, count(*) OVER (PARTITION BY facade_id) AS n, row_number() OVER o AS rn, lead(score) OVER o AS next FROM s WHERE score >= 0 WINDOW o AS (PARTITION BY facade_id ORDER BY score DESC, region_id, second_id))
        SELECT facade_id, round(score, 9) AS score, region_id, second_id, x, y, w, h FROM k WHERE rn = 1 AND score >= CASE n WHEN 1 THEN 0.42 WHEN 2 THEN 0.50 ELSE 0.55 END AND (n <= 2 OR score >= next + 0.06::DOUBLE)""",
    "gap_fit": f"""{INSIDE}, g AS (SELECT *, x - region_id % 150 // 2 AS g0, x + w + region_id % 150 // 3 AS g1 FROM e), k AS (SELECT *, g1 - g0 AS gap, g1 - g0 > greatest(floor(fw * 0.12::DOUBLE), floor(w * 2.4::DOUBLE)) AS wide FROM g WHERE g1 - g0 >= greatest(28, floor(fw * 0.035::DOUBLE))),
        t AS (SELECT *, greatest(w, least(CASE WHEN wide THEN least(greatest(w, round_even(w * 1.10::DOUBLE, 0)), greatest(round_even(fw * 0.085::DOUBLE, 0), w + 18)) ELSE least(gap, greatest(w, round_even(gap * 0.98::DOUBLE, 0))) END, round_even(fw * 0.12::DOUBLE, 0))) AS tw,
                     CASE WHEN wide THEN (g0 + g1) * 0.5::DOUBLE * 0.55::DOUBLE + (x + w * 0.5::DOUBLE) * 0.45::DOUBLE ELSE (g0 + g1) * 0.5::DOUBLE END AS c FROM k)
        SELECT region_id, greatest(fx, least(round_even(c - tw * 0.5::DOUBLE, 0), fx + fw - tw))::BIGINT AS x, y, tw::BIGINT AS w, h FROM t""",
    "central_cluster": f"""{INSIDE}, r AS (SELECT *, x + w * 0.5::DOUBLE AS cx, y + h * 0.5::DOUBLE AS cy, fx + fw * 0.5::DOUBLE AS fc, greatest(8.0::DOUBLE, fw * 0.025::DOUBLE) AS sl FROM e WHERE fw >= 160 AND fh >= 90 AND fw / fh::DOUBLE >= 2.0),
        i AS (SELECT * FROM r WHERE cx BETWEEN fx - sl AND fx + fw + sl AND cy BETWEEN fy - sl AND fy + fh + sl),
        d AS (SELECT facade_id, arg_min(struct_pack(x := x, y := y, w := w, h := h), (abs(cx - fc) - h * 0.03::DOUBLE, region_id)) AS d FROM i WHERE kind = 'door' AND abs(cx - fc) <= fw * 0.17::DOUBLE AND w BETWEEN fw * 0.020::DOUBLE AND fw * 0.18::DOUBLE AND h BETWEEN fh * 0.18::DOUBLE AND fh * 0.82::DOUBLE
              AND (y - fy) / fh::DOUBLE BETWEEN 0.18 AND 0.78 AND (y + h - fy) / fh::DOUBLE BETWEEN 0.55 AND 0.98 GROUP BY facade_id),
        n AS (SELECT i.*, d.d, greatest(greatest(x, d.x) - least(x + w, d.x + d.w), 0) AS gap, greatest(least(y + h, d.y + d.h) - greatest(y, d.y), 0) AS sh, abs(cy - (d.y + d.h * 0.5::DOUBLE)) AS down FROM i JOIN d USING (facade_id) WHERE kind = 'window'),
        k AS (SELECT * FROM n WHERE w <= fw * 0.24::DOUBLE AND h <= fh * 0.52::DOUBLE AND gap <= greatest(44, round_even(fw * 0.14::DOUBLE, 0)) AND (sh >= least(h, d.h) * 0.12::DOUBLE OR down <= greatest(42, round_even(fh * 0.18::DOUBLE, 0))) AND cy BETWEEN fy + fh * 0.16::DOUBLE AND fy + fh * 0.78::DOUBLE),
        s AS (SELECT facade_id, fw, fh, arg_min(struct_pack(gap := gap, y := y), (gap, down, region_id)) FILTER (WHERE x + w <= d.x AND cx < fc) AS l, arg_min(struct_pack(gap := gap, y := y), (gap, down, region_id)) FILTER (WHERE x >= d.x + d.w AND cx > fc) AS r FROM k GROUP BY facade_id, fw, fh)
        SELECT facade_id FROM s WHERE l IS NOT NULL AND r IS NOT NULL AND abs(l.gap - r.gap) <= greatest(36, round_even(fw * 0.08::DOUBLE, 0)) AND abs(l.y - r.y) <= greatest(36, round_even(fh * 0.15::DOUBLE, 0))""",
    "validator_geometry": f"""{INSIDE}, k AS (SELECT *, (y + h - fy) / fh::DOUBLE AS b, w / h::DOUBLE AS q FROM e)
        SELECT region_id, q > 4.5 OR q < 0.22 OR w * h > 600000 OR w * h > fw * fh * 0.35::DOUBLE OR (h < fh * 0.15::DOUBLE AND w > fw * 0.60::DOUBLE AND y < fy + fh * 0.20::DOUBLE) OR b > 0.92 AS invalid,
               (b > 0.78 AND h < floor(fh * 0.22::DOUBLE)) OR (w < floor(fw * 0.045::DOUBLE) AND h < floor(fh * 0.22::DOUBLE)) OR (x + w > fx + fw - floor(fw * 0.05::DOUBLE) AND w < floor(fw * 0.07::DOUBLE)) OR (b > 0.64 AND h < floor(fh * 0.24::DOUBLE) AND w < floor(fw * 0.07::DOUBLE) AND q < 1.45) OR (q > 1.9 AND b > 0.65) AS implausible,
               y + h * 0.5::DOUBLE <= fy + fh * 0.72::DOUBLE AND w * h / (fw * fh)::DOUBLE BETWEEN 0.006 AND 0.30 AS markup FROM k""",
}
SCENE = """sc AS (SELECT facade_id, w, h, facade_id % 11 = 0 AS merged, w - facade_id % 5 * 200 AS nc, facade_id % 6 AS no, h * (facade_id % 13) / 60.0::DOUBLE AS iqr, h * (facade_id % 17) / 40.0::DOUBLE AS span, h * (facade_id % 7) / 50.0::DOUBLE AS peak,
          h * (facade_id % 9) / 50.0::DOUBLE AS ts, h * (facade_id % 8) / 50.0::DOUBLE AS cs, facade_id % 10 = 1 AS central, w / h::DOUBLE AS a FROM v_facade),
  scenes AS (SELECT facade_id, CASE WHEN merged THEN 'composite_stepped_facade' WHEN w < 60 OR h < 60 THEN 'unknown' WHEN nc < greatest(18, floor(w * 0.12::DOUBLE)) THEN CASE WHEN no <= 1 THEN 'sparse_openings_flat' ELSE 'unknown' END
          WHEN a <= 2.15 AND span >= h * 0.28::DOUBLE AND (iqr >= h * 0.12::DOUBLE OR peak >= h * 0.10::DOUBLE) THEN 'gable_facade' WHEN no >= 4 AND a >= 2.0 AND (ts >= h * 0.12::DOUBLE OR cs >= h * 0.16::DOUBLE) THEN 'composite_stepped_facade'
          WHEN central THEN 'flat_long_facade' WHEN a >= 2.0 AND no <= 1 THEN 'sparse_openings_flat' WHEN span >= h * 0.08::DOUBLE AND no <= 4 THEN 'sparse_openings_flat' WHEN a >= 2.0 AND iqr <= h * 0.10::DOUBLE THEN 'flat_long_facade'
          WHEN no <= 4 THEN 'sparse_openings_flat' ELSE 'flat_long_facade' END AS scene FROM sc)"""
ORACLES["scene_class"] = f"{duck('v_facade')}, {SCENE} SELECT facade_id, scene FROM scenes"
ORACLES["prune_openings"] = f"""{INSIDE}, {SCENE}, q AS (SELECT e.*, scene FROM e JOIN scenes USING (facade_id)),
  near AS (SELECT a.region_id, count(*) AS n, count(*) FILTER (WHERE b.x + b.w * 0.5::DOUBLE < a.x + a.w * 0.5::DOUBLE) AS l FROM q a JOIN q b ON a.facade_id = b.facade_id AND a.region_id <> b.region_id AND a.kind <> b.kind
           WHERE greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) >= least(a.h, b.h) * 0.20::DOUBLE AND greatest(greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w), 0) <= greatest(90.0::DOUBLE, greatest(a.w, b.w) * 1.4::DOUBLE) GROUP BY a.region_id),
  z AS (SELECT q.*, coalesce(n, 0) AS n, coalesce(l, 0) AS l FROM q LEFT JOIN near USING (region_id))
  SELECT facade_id, region_id, scene FROM z WHERE NOT ((scene = 'gable_facade' AND kind = 'door' AND n <= 1) OR (scene = 'gable_facade' AND kind <> 'door' AND w * h < fw * fh * 0.004::DOUBLE)
     OR (scene = 'sparse_openings_flat' AND kind <> 'door' AND n > 0 AND (l = 0 OR l = n) AND w < fw * 0.05::DOUBLE))"""
ORACLES["composite_openings"] = f"""{INSIDE}, o AS (SELECT facade_id, region_id, CASE WHEN kind = 'window' AND region_id % 3 = 0 THEN 'sidelight' ELSE kind END AS kind, x, y, w, h FROM e),
  p AS (SELECT a.*, d.region_id AS did, d.x AS dx, d.y AS dy, d.w AS dw, d.h AS dh, greatest(least(a.x + a.w, d.x + d.w) - greatest(a.x, d.x), 0) AS ox, greatest(least(a.y + a.h, d.y + d.h) - greatest(a.y, d.y), 0) AS oy,
               greatest(greatest(a.x, d.x) - least(a.x + a.w, d.x + d.w), 0) AS gx FROM o a JOIN o d ON a.facade_id = d.facade_id AND a.kind <> 'door' AND d.kind = 'door'),
  gone AS (SELECT DISTINCT region_id FROM p WHERE kind = 'window' AND ox >= least(w, dw) * 0.5::DOUBLE AND y + h <= dy + dh * 0.15::DOUBLE AND dy - y - h <= dh * 0.25::DOUBLE),
  s AS (SELECT *, x + w * 0.5::DOUBLE < dx + dw * 0.5::DOUBLE AS l FROM p WHERE kind = 'sidelight' AND gx <= dw * 0.25::DOUBLE AND ox <= w * 0.2::DOUBLE AND oy >= dh * 0.5::DOUBLE),
  one AS (SELECT facade_id, did, dx, dw, arg_min(struct_pack(x := x, y := y, w := w, h := h), region_id) AS s FROM s GROUP BY facade_id, did, dx, dw HAVING bool_or(l) <> bool_or(NOT l))
  SELECT * FROM o WHERE region_id NOT IN (SELECT region_id FROM gone) UNION ALL SELECT facade_id, -did, 'sidelight', 2 * dx + dw - s.x - s.w, s.y, s.w, s.h FROM one"""
ORACLES["routed_regions"] = f"""{duck("v_facade", "v_element")}, e AS (SELECT facade_id AS image_id, element_id AS region_id, CASE WHEN score % 9 = 0 THEN 'facade' ELSE kind END AS kind, side FROM v_element),
  r AS (SELECT facade_id AS image_id, facade_id % 11 / 100.0::DOUBLE <= 0.05 AND count(region_id) FILTER (WHERE side = 'O') > 0 AND NOT (facade_id % 2 = 0 AND count(*) FILTER (WHERE side = 'O' AND kind = 'window') > 0 AND count(*) FILTER (WHERE side = 'O' AND kind = 'door') = 0) AS use,
               count(*) FILTER (WHERE side = 'F' AND kind = 'facade') = 0 AS bare FROM v_facade LEFT JOIN e ON e.image_id = facade_id GROUP BY facade_id)
  SELECT image_id, region_id, kind, 'detected' AS route FROM e JOIN r USING (image_id) WHERE side = 'F' AND (NOT use OR kind = 'facade')
  UNION ALL SELECT image_id, region_id, kind, 'predicted' FROM e JOIN r USING (image_id) WHERE side = 'O' AND use AND (kind <> 'facade' OR bare)"""
