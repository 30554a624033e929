"""Queries over accuracy, validation, pixels and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions.boxes import Box, pixel_area, relative_box, relative_points, yolo_line
from ..operators import metrics as M
from ..operators import pixels as P
from ..operators import validate as V
from ..sources.adapter import duck, view
from ..sources.formats import predictions_to_regions, worldfile_scale
from .duck import apart, greedy, iou


def _sides(spark, sf):
    e = view(spark, sf, "v_element").select(F.col("facade_id").alias("sample_id"), F.col("element_id").alias("id"), "x", "y", (F.col("w") * 3).alias("w"), (F.col("h") * 3).alias("h"), (F.col("w_cm") * F.col("h_cm")).alias("area_cm2"), "side", "kind")
    return e.filter("side = 'F'").drop("side"), e.filter("side = 'O'").drop("side")


def eval_iou(spark, sf):
    return M.facade_iou(*_sides(spark, sf)).withColumn("mean_iou", F.round("mean_iou", 6))


def _wide(spark, sf):
    """Sides near each other, so that distances match something."""
    return (d.withColumns({"x": F.floor(F.col("x") / 10), "y": F.floor(F.col("y") / 10)}) for d in _sides(spark, sf))


def eval_windows(spark, sf):
    return M.window_scores(*_wide(spark, sf))


def eval_area(spark, sf):
    return M.area_errors(*_wide(spark, sf))


def eval_match(spark, sf):
    return M.iou_matches(*_wide(spark, sf), 0.5)


def positional_iou(spark, sf):
    return M.positional_iou(*_wide(spark, sf)).withColumn("mean_iou", F.round("mean_iou", 6))


def micro_pr(spark, sf):
    pred, truth = _wide(spark, sf)
    by = [M.iou_matches(pred.filter(F.col("kind") == k), truth.filter(F.col("kind") == k), 0.5).withColumn("kind", F.lit(k)) for k in ("window", "door")]
    return M.micro_scores(by[0].unionByName(by[1]), "kind")


def scenario_rollup(spark, sf):
    """Samples by scenario (the customer's segment): counts and mean F1."""
    scores = M.window_scores(*_wide(spark, sf))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("c_custkey"))
    names = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("scenario"))
    rows = orders.join(names, "c_custkey").join(scores, "sample_id", "left")
    micro = lambda c: F.round(F.sum(F.floor(F.col(c) * 1000000).cast("long")) / F.count(c) / 1000000.0, 4).alias(f"mean_{c}")
    return rows.groupBy("scenario").agg(F.count("*").alias("n_samples"), F.count("f1").alias("n_evaluated"), *(micro(c) for c in ("precision", "recall", "f1")))


def count_checks(spark, sf):
    n = view(spark, sf, "v_element").groupBy("facade_id").agg(F.count("*").alias("n"))
    c = F.col("facade_id")
    return n.select("facade_id", "n", M.count_check(F.col("n"), F.when(c % 3 == 0, c % 7), F.when(c % 3 == 1, c % 5)).alias("state"))


def geometry_metrics(spark, sf):
    f = view(spark, sf, "v_facade")
    socle = Box(F.col("x") + 3, F.col("y") + F.col("h") - 40, F.col("w") - F.col("facade_id") % 9, F.lit(40))
    door = Box(F.col("x") + F.col("facade_id") % 150, F.col("y"), F.lit(31), F.col("h") - F.col("facade_id") % 60)
    point = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    line = F.array(point(F.col("x"), F.col("y") + F.col("h") - 35), point(F.col("x") + 100, F.col("y") + F.col("h") - 30), point(F.col("x") + F.col("w"), F.col("y") + F.col("h") - 50))
    return f.select("facade_id", M.geometry_metrics(Box.of(), socle, door, line).alias("m")).select("facade_id", "m.*")


def baseline_delta(spark, sf):
    e = view(spark, sf, "v_element").select(F.col("facade_id").alias("case_id"), "element_id", *"xywh")
    before = e.filter("element_id % 50 <> 7").withColumn("x", F.col("x") + F.when(F.col("case_id") % 4 == 0, 3).otherwise(1))
    return M.baseline_changes(e.drop("element_id"), before.drop("element_id"))


def annotation_validation(spark, sf):
    f, e = view(spark, sf, "v_facade"), view(spark, sf, "v_element")
    c = lambda n, t="string": F.lit(None).cast(t).alias(n)
    facades = f.select(F.col("facade_id").alias("file_id"), F.lit(0).cast("long").alias("item_id"), F.lit("facade").alias("kind"), F.col("name").alias("label"), c("parent"), *"xywh", (F.col("total_cm2") / 10000.0).alias("area_m2"), c("width_m", "double"), c("height_m", "double"))
    parent = F.when(F.col("score") < 10, F.lit("FATADA_X")).when(F.col("score") < 90, F.concat(F.lit("FATADA_"), F.col("facade_id")))
    parts = e.select(F.col("facade_id").alias("file_id"), F.col("element_id").alias("item_id"), "kind", F.when(F.col("score") % 30 == 0, " ").otherwise(F.col("label")).alias("label"), parent.alias("parent"), *"xywh", (F.col("w_cm") * F.col("h_cm") / 10000.0).alias("area_m2"), (F.col("w_cm") / 100.0).alias("width_m"), (F.col("h_cm") / 100.0).alias("height_m"))
    images = f.select(F.col("facade_id").alias("file_id"), F.lit(1800).alias("width"), F.lit(900).alias("height"), (F.col("facade_id") % 2).alias("n_scale_refs"))
    return V.annotation_errors(facades.unionByName(parts), images, strict=True)


def validation_summary(spark, sf):
    """How many files of `annotation_validation` broke a rule."""
    return V.validation_summary(annotation_validation(spark, sf), view(spark, sf, "v_facade").select(F.col("facade_id").alias("file_id")))


def sample_scores(spark, sf):
    """Every score of each sample."""
    rows = M.sample_scores(*_wide(spark, sf))
    return rows.na.fill(-1.0, ["mean_error_m2", "max_error_m2"])


def filled_truth(spark, sf):
    """Openings of one side as truth; facades without any take the others."""
    e = view(spark, sf, "v_element").select(F.col("facade_id").alias("stem"), "element_id", "side", *"xywh")
    images = view(spark, sf, "v_facade").select(F.col("facade_id").alias("stem"))
    side = lambda s: e.filter(F.col("side") == s).drop("side")
    return M.filled_truth(side("F"), side("O"), images)


def relative_boxes(spark, sf):
    """Openings and a point of each in shares of their facade."""
    f = view(spark, sf, "v_facade").select("facade_id", *(F.col(c).alias("f" + c) for c in "xywh"))
    e = view(spark, sf, "v_element").join(f, "facade_id")
    middle = F.array(F.struct((F.col("x") + F.floor(F.col("w") / 2)).alias("x"), (F.col("y") + F.floor(F.col("h") / 2)).alias("y")))
    out = e.select("element_id", relative_box(Box.of(), Box.of("f")).alias("b"), F.get(relative_points(middle, Box.of("f")), F.lit(0)).alias("p"), pixel_area(F.when(F.col("score") % 2 == 0, F.col("score")), Box.of()).alias("area_px"))
    return out.select("element_id", "b.*", F.col("p.x").alias("px"), F.col("p.y").alias("py"), "area_px")


def reference_verdicts(spark, sf):
    f = view(spark, sf, "v_facade")
    c = F.col("facade_id")
    return V.reference_verdicts(f.select(c.alias("id"), *"xywh", F.lit(2000).alias("width"), F.lit(1000).alias("height"), (F.col("w") * (c % 50)).alias("area_px"), (c % 5 > 0).alias("same_size"), (c % 7).alias("n_bright")))


def row_occupancy(spark, sf):
    return P.row_occupancy(view(spark, sf, "v_pixel"), 0.0)


def top_profile(spark, sf):
    return P.top_profile(view(spark, sf, "v_pixel"), 0.1)


def percentile_mask(spark, sf):
    return P.percentile_mask(view(spark, sf, "v_pixel"), 65.0)


def profile_steps(spark, sf):
    return P.largest_step(P.top_profile(view(spark, sf, "v_pixel"), 0.1))


def rolling_profile(spark, sf):
    rows = P.top_profile(view(spark, sf, "v_pixel"), 0.1)
    return rows.select("image_id", "x", P.rolling_mean(F.col("top"), "image_id", "x", 2).alias("mean"))


def connected_components(spark, sf):
    return P.components(view(spark, sf, "v_pixel"), 0.12, 8)


def hsv_range(spark, sf):
    """Pixels in the marking colours, counted by kind, with a made-up
    mapping of grey values to colours."""
    p = view(spark, sf, "v_pixel").select("image_id", F.floor(F.abs("v") * 400).alias("h"), F.floor(F.abs("v") * 900 + 40).alias("s"), (F.lit(90) + F.col("x") * 8).alias("b"))
    any_of = lambda kind: F.array_max(F.array(*(P.in_hsv(F.col("h"), F.col("s"), F.col("b"), *r) for r in config.COLOUR_RANGES[kind].values())))
    return p.groupBy("image_id").agg(*(F.count_if(any_of(k)).alias(f"n_{k}") for k in config.COLOUR_RANGES))


def yolo_lines(spark, sf):
    e = view(spark, sf, "v_element")
    box = Box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return e.select("element_id", yolo_line(F.when(F.col("kind") == "door", 2).otherwise(1), box, F.lit(2048), F.lit(1024)).alias("line"))


def worldfile_scales(spark, sf):
    text = F.concat_ws("\n", F.concat(F.lit("0,0"), F.col("w")), F.lit("0.0"), F.lit("0.0"), F.concat(F.lit("-0.0"), F.col("h")), F.lit("12.5"), F.lit("99"))
    f = view(spark, sf, "v_facade").select("facade_id", F.when(F.col("facade_id") % 10 == 0, "0.1\n0").otherwise(text).alias("text"))
    return f.select("facade_id", worldfile_scale(F.col("text")).alias("s")).filter("s IS NOT NULL").select("facade_id", F.round("s.px_per_m", 6).alias("px_per_m"), F.round("s.axis_difference", 9).alias("axis_difference"))


def prediction_adapter(spark, sf):
    e = view(spark, sf, "v_element")
    name = F.when(F.col("score") % 5 == 0, "Fereastra").when(F.col("score") % 5 == 1, "USA").when(F.col("score") % 5 == 2, "socle").when(F.col("score") % 5 == 3, "fatada").otherwise("thing")
    p = e.select(F.col("facade_id").alias("image_id"), F.col("element_id").alias("pred_id"), name.alias("class_name"), (F.col("score") % 8).alias("class_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w") - F.col("score") % 40).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    return predictions_to_regions(p)


SIDES = f"""{duck("v_element", recursive=True)}, s AS (SELECT facade_id AS sample_id, element_id AS id, x, y, w * 3 AS w, h * 3 AS h, w_cm * h_cm AS area_cm2, side, kind FROM v_element), p AS (SELECT * FROM s WHERE side = 'F'), g AS (SELECT * FROM s WHERE side = 'O')"""
WIDE = SIDES.replace("x, y, w * 3", "x // 10 AS x, y // 10 AS y, w * 3")
CNT = "n AS (SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng FROM (SELECT sample_id, count(*) AS np FROM p GROUP BY ALL) a FULL JOIN (SELECT sample_id, count(*) AS ng FROM g GROUP BY ALL) b ON a.sample_id = b.sample_id)"
NEAR = f"""q AS (SELECT p.sample_id, p.id AS pred_id, g.id AS gt_id, {apart("p", "g")} AS d, p.area_cm2 AS pa, g.area_cm2 AS ga FROM p JOIN g USING (sample_id) WHERE {apart("p", "g")} <= 80), {greedy("q", "sample_id", "pred_id", "gt_id", "pred_id, d, gt_id")}, {CNT},
  w AS (SELECT n.*, coalesce(tp, 0) AS tp FROM n LEFT JOIN (SELECT sample_id, count(*) AS tp FROM chosen GROUP BY ALL) USING (sample_id)),
  pr AS (SELECT sample_id, tp, np - tp AS fp, ng - tp AS fn, CASE WHEN np > 0 THEN tp / np::DOUBLE ELSE 1 END AS precision, CASE WHEN ng > 0 THEN tp / ng::DOUBLE ELSE 1 END AS recall, np, ng FROM w),
  ws AS (SELECT sample_id, tp, fp, fn, precision, recall, CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END::DOUBLE AS f1 FROM pr)"""


def _match(p: str, g: str, tag: str = "") -> str:
    return f"""SELECT p.sample_id, p.id AS pred_id, g.id AS gt_id, {iou("p", "g")} AS iou FROM {p} p JOIN {g} g USING (sample_id) WHERE {iou("p", "g")} >= 0.5"""


PIX = duck("v_pixel")
TOP = "t AS (SELECT image_id, x, coalesce(min(y) FILTER (WHERE v > 0.1::DOUBLE), -1) AS top, coalesce(max(y) FILTER (WHERE v > 0.1::DOUBLE), -1) AS bottom FROM v_pixel GROUP BY image_id, x)"
QUERIES = {f.__name__: f for f in (
    eval_iou, eval_windows, eval_area, eval_match, positional_iou, micro_pr, scenario_rollup, count_checks, geometry_metrics, baseline_delta, annotation_validation, validation_summary, sample_scores, filled_truth,
    relative_boxes, reference_verdicts, row_occupancy, top_profile, percentile_mask, profile_steps, rolling_profile, connected_components, hsv_range, yolo_lines, worldfile_scales, prediction_adapter,
)}
ORACLES = {
    "eval_iou": f"""{SIDES}, q AS (SELECT p.sample_id, p.id AS pred_id, g.id AS gt_id, {iou("p", "g")} AS v FROM p JOIN g USING (sample_id) WHERE {iou("p", "g")} >= 0.1), {greedy("q", "sample_id", "pred_id", "gt_id", "pred_id, v DESC, gt_id")}, {CNT},
        f AS (SELECT sample_id, sum(round(v, 9)) AS s, count(*) AS k FROM q JOIN chosen USING (sample_id, pred_id, gt_id) GROUP BY ALL)
        SELECT sample_id, coalesce(k, 0) AS n_matched, round(CASE WHEN ng = 0 THEN 0.0 ELSE coalesce(s, 0) / (np + ng - coalesce(k, 0)) END, 6) AS mean_iou FROM n LEFT JOIN f USING (sample_id)""",
    "eval_windows": f"{WIDE}, {NEAR} SELECT * FROM ws",
    "eval_area": f"""{WIDE}, {NEAR} SELECT sample_id, sum(abs(pa - ga))::DOUBLE / count(*) / 10000.0::DOUBLE AS mean_error_m2, max(abs(pa - ga)) / 10000.0::DOUBLE AS max_error_m2 FROM q JOIN chosen USING (sample_id, pred_id, gt_id) GROUP BY sample_id""",
    "eval_match": f"""{WIDE}, q AS ({_match("p", "g")}), {greedy("q", "sample_id", "gt_id", "pred_id", "iou DESC, gt_id DESC, pred_id DESC")}, {CNT}, k AS (SELECT sample_id, count(*) AS m FROM chosen GROUP BY ALL)
        SELECT sample_id, coalesce(m, 0) AS matched, ng - coalesce(m, 0) AS missed, np - coalesce(m, 0) AS extra FROM n LEFT JOIN k USING (sample_id)""",
    "positional_iou": f"""{WIDE}, a AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY x + w * 0.5::DOUBLE, y, w, h, x, id) AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM p),
        b AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY x + w * 0.5::DOUBLE, y, w, h, x, id) AS k, count(*) OVER (PARTITION BY sample_id) AS n FROM g),
        u AS (SELECT a.sample_id, a.n AS na, b.n AS nb, CASE WHEN a.k = b.k THEN round({iou("a", "b")}, 9) ELSE 0 END AS v FROM a JOIN b USING (sample_id))
        SELECT sample_id, round(CASE WHEN any_value(na) = any_value(nb) THEN sum(v) / any_value(nb) ELSE 0 END, 6) AS mean_iou FROM u GROUP BY sample_id""",
    "micro_pr": f"""{WIDE}, q AS (SELECT sample_id || p.kind AS grp, p.id AS pred_id, g.id AS gt_id, {iou("p", "g")} AS iou FROM p JOIN g USING (sample_id) WHERE p.kind = g.kind AND {iou("p", "g")} >= 0.5), {greedy("q", "grp", "gt_id", "pred_id", "iou DESC, gt_id DESC, pred_id DESC")},
        m AS (SELECT p.kind, count(*) AS m FROM chosen JOIN p ON p.id = chosen.pred_id GROUP BY ALL)
        SELECT kind, m / (SELECT count(*) FROM p WHERE p.kind = m.kind)::DOUBLE AS precision, m / (SELECT count(*) FROM g WHERE g.kind = m.kind)::DOUBLE AS recall FROM m""",
    "scenario_rollup": f"""{WIDE}, {NEAR} SELECT c_mktsegment AS scenario, count(*) AS n_samples, count(f1) AS n_evaluated,
        {", ".join(f"round(sum(floor({c} * 1000000)::BIGINT)::DOUBLE / count({c}) / 1000000.0::DOUBLE, 4) AS mean_{c}" for c in ("precision", "recall", "f1"))}
        FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN ws ON sample_id = o_orderkey GROUP BY c_mktsegment""",
    "count_checks": f"""{duck("v_element")} SELECT facade_id, count(*) AS n, CASE facade_id % 3 WHEN 0 THEN CASE WHEN count(*) = facade_id % 7 THEN 'ok' ELSE 'differs' END WHEN 1 THEN CASE WHEN count(*) >= facade_id % 5 THEN 'ok' ELSE 'too few' END ELSE 'unchecked' END AS state FROM v_element GROUP BY facade_id""",
    "geometry_metrics": f"""{duck("v_facade")}, k AS (SELECT *, x + w * 0.5::DOUBLE AS fc, x + facade_id % 150 + 15.5::DOUBLE AS dc FROM v_facade),
        l AS (SELECT *, CASE WHEN fc < x + 100 THEN y + h - 35 + 5 * (fc - x) / 100 ELSE y + h - 30 - 20 * (fc - x - 100) / (w - 100) END AS fy, CASE WHEN dc < x + 100 THEN y + h - 35 + 5 * (dc - x) / 100 WHEN dc >= x + w THEN y + h - 50 ELSE y + h - 30 - 20 * (dc - x - 100) / (w - 100) END AS dy FROM k)
        SELECT facade_id, (-3)::BIGINT AS left_offset, 3 - facade_id % 9 AS right_offset, round_even(y + h - fy, 0)::BIGINT AS facade_to_line, round_even(y + h - facade_id % 60 - dy, 0)::BIGINT AS door_to_line FROM l""",
    "baseline_delta": f"""{duck("v_element")}, a AS (SELECT facade_id AS case_id, x, y, w, h, row_number() OVER o AS k FROM v_element WINDOW o AS (PARTITION BY facade_id ORDER BY x, y, w, h)),
        b AS (SELECT facade_id AS case_id, x + CASE WHEN facade_id % 4 = 0 THEN 3 ELSE 1 END AS x, y, w, h, row_number() OVER o AS k FROM v_element WHERE element_id % 50 <> 7 WINDOW o AS (PARTITION BY facade_id ORDER BY x, y, w, h)),
        na AS (SELECT case_id, count(*) AS na FROM a GROUP BY ALL), nb AS (SELECT case_id, count(*) AS nb FROM b GROUP BY ALL),
        d AS (SELECT case_id, max(greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.w - b.w), abs(a.h - b.h))) AS d FROM a JOIN b USING (case_id, k) GROUP BY case_id)
        SELECT case_id, (na - nb)::INT AS more, CASE WHEN na = nb THEN d ELSE 1000000 END AS delta, na <> nb OR d > 2 AS changed FROM na JOIN nb USING (case_id) JOIN d USING (case_id)""",
    "annotation_validation": f"""{duck("v_facade", "v_element")}, i AS (SELECT facade_id AS file_id, 0 AS item_id, true AS top, name AS label, NULL AS parent, x, y, w, h, total_cm2 / 10000.0::DOUBLE AS area, NULL::DOUBLE AS wm, NULL::DOUBLE AS hm, 'facade' AS kind FROM v_facade
          UNION ALL SELECT facade_id, element_id, false, CASE WHEN score % 30 = 0 THEN ' ' ELSE label END, CASE WHEN score < 10 THEN 'FATADA_X' WHEN score < 90 THEN 'FATADA_' || facade_id END, x, y, w, h, w_cm * h_cm / 10000.0::DOUBLE, w_cm / 100.0::DOUBLE, h_cm / 100.0::DOUBLE, kind FROM v_element),
        k AS (SELECT i.*, f.name AS pn, f.x AS px, f.y AS py, f.w AS pw, f.h AS ph FROM i LEFT JOIN v_facade f ON f.facade_id = file_id AND parent = f.name)
        SELECT file_id, item_id, 'empty_label' AS rule FROM k WHERE trim(label) = '' UNION ALL SELECT file_id, item_id, 'outside_image' FROM k WHERE x + w > 1800 OR y + h > 900 UNION ALL SELECT file_id, item_id, 'unknown_parent' FROM k WHERE NOT top AND parent IS NOT NULL AND pn IS NULL
        UNION ALL SELECT file_id, item_id, 'outside_parent' FROM k WHERE NOT top AND (x < px - 20 OR y < py - 20 OR x + w > px + pw + 20 OR y + h > py + ph + 20) UNION ALL SELECT file_id, item_id, 'area_out_of_range' FROM k WHERE CASE kind WHEN 'facade' THEN NOT area BETWEEN 1 AND 5000 WHEN 'window' THEN NOT area BETWEEN 0.15 AND 15 ELSE NOT area BETWEEN 0.5 AND 6.5 END
        UNION ALL SELECT file_id, item_id, 'width_out_of_range' FROM k WHERE CASE kind WHEN 'window' THEN NOT wm BETWEEN 0.2 AND 8 WHEN 'door' THEN NOT wm BETWEEN 0.5 AND 5 END
        UNION ALL SELECT file_id, item_id, 'height_out_of_range' FROM k WHERE CASE kind WHEN 'window' THEN NOT hm BETWEEN 0.2 AND 5 WHEN 'door' THEN NOT hm BETWEEN 1.4 AND 5 END
        UNION ALL SELECT facade_id, -1, 'no_scale_reference' FROM v_facade WHERE facade_id % 2 = 0""",
    "reference_verdicts": f"""{duck("v_facade")} SELECT facade_id AS id, CASE WHEN x + w > 2000 OR y + h > 1000 OR w * (facade_id % 50) < 1000 THEN 'INVALID' WHEN facade_id % 5 = 0 OR facade_id % 7 > 0 THEN 'WARNING' ELSE 'VALID' END AS verdict FROM v_facade""",
    "row_occupancy": f"{PIX} SELECT image_id, y, count(*) FILTER (WHERE v > 0)::DOUBLE / count(*) AS share FROM v_pixel GROUP BY image_id, y",
    "top_profile": f"{PIX}, {TOP} SELECT * FROM t",
    "percentile_mask": f"{PIX}, c AS (SELECT image_id, quantile_cont(v, 0.65::DOUBLE) AS cut FROM v_pixel GROUP BY image_id) SELECT image_id, any_value(cut) AS cut, count(*) FILTER (WHERE v > cut) AS n_over FROM v_pixel JOIN c USING (image_id) GROUP BY image_id",
    "profile_steps": f"""{PIX}, {TOP}, s AS (SELECT *, abs(top - lag(top) OVER (PARTITION BY image_id ORDER BY x)) AS step FROM t WHERE top >= 0), b AS (SELECT image_id, max(step) AS step, arg_min(x, (-coalesce(step, -1), x)) AS x, max(top) - min(top) AS span FROM s GROUP BY image_id)
        SELECT image_id, x, step FROM b WHERE step >= greatest(2.0::DOUBLE, span * 0.18::DOUBLE)""",
    "rolling_profile": f"{PIX}, {TOP} SELECT image_id, x, sum(top) OVER (PARTITION BY image_id ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE AS mean FROM t",
    "connected_components": f"""{duck("v_pixel", recursive=True)}, o AS (SELECT image_id, (y * 8 + x)::INT AS p, x::INT AS x, y::INT AS y FROM v_pixel WHERE v > 0.12::DOUBLE), edge AS (SELECT a.image_id, a.p AS a, b.p AS b FROM o a JOIN o b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
        reach AS (SELECT image_id, a, b FROM edge UNION SELECT r.image_id, r.a, e.b FROM reach r JOIN edge e ON r.image_id = e.image_id AND r.b = e.a), l AS (SELECT image_id, a AS p, min(b) AS label FROM reach GROUP BY image_id, a)
        SELECT image_id, label, count(*)::INT AS n, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM l JOIN o USING (image_id, p) GROUP BY image_id, label""",
    "hsv_range": f"""{PIX}, c AS (SELECT image_id, floor(abs(v) * 400) AS h, floor(abs(v) * 900 + 40) AS s, 90 + x * 8 AS b FROM v_pixel)
        SELECT image_id, """ + ", ".join("count(*) FILTER (WHERE " + " OR ".join(f"(h BETWEEN {lo[0]} AND {hi[0]} AND s BETWEEN {lo[1]} AND {hi[1]} AND b BETWEEN {lo[2]} AND {hi[2]})" for lo, hi in rs.values()) + f") AS n_{k}" for k, rs in config.COLOUR_RANGES.items()) + " FROM c GROUP BY image_id",
    "yolo_lines": f"""{duck("v_element")} SELECT element_id, printf('%d %.6f %.6f %.6f %.6f', CASE kind WHEN 'door' THEN 2 ELSE 1 END, least(greatest((x + w * 0.5::DOUBLE) / 2048, 0), 1), least(greatest((y + h * 0.5::DOUBLE) / 1024, 0), 1), least(greatest(w / 2048::DOUBLE, 0.001), 1), least(greatest(h / 1024::DOUBLE, 0.001), 1)) AS line FROM v_element""",
    "worldfile_scales": f"""{duck("v_facade")}, k AS (SELECT facade_id, ('0.0' || w)::DOUBLE AS a, ('0.0' || h)::DOUBLE AS e FROM v_facade WHERE facade_id % 10 <> 0) SELECT facade_id, round(1 / ((a + e) / 2), 6) AS px_per_m, round(abs(a - e) / greatest(a, e), 9) AS axis_difference FROM k""",
    "prediction_adapter": f"""{duck("v_element")}, k AS (SELECT facade_id AS image_id, element_id AS pred_id, x, y, w - score % 40 AS w, h, CASE score % 5 WHEN 0 THEN 'window' WHEN 1 THEN 'door' WHEN 2 THEN 'socle' WHEN 3 THEN 'facade' ELSE CASE score % 8 % 3 WHEN 0 THEN 'facade' WHEN 1 THEN 'window' ELSE 'door' END END AS kind FROM v_element)
        SELECT image_id, pred_id, kind, CASE kind WHEN 'facade' THEN 'FATADA_' WHEN 'window' THEN 'F_' WHEN 'door' THEN 'U_' ELSE 'SOCLU_' END || row_number() OVER (PARTITION BY image_id, kind ORDER BY pred_id) AS label, x, y, w, h FROM k WHERE w > 0""",
}
ORACLES["validation_summary"] = f"""SELECT count(*) AS n_files, count(e.file_id) AS n_failed, count(*) - count(e.file_id) AS n_passed
    FROM (SELECT o_orderkey FROM orders) f LEFT JOIN (SELECT DISTINCT file_id FROM ({ORACLES["annotation_validation"]})) e ON e.file_id = f.o_orderkey"""
ORACLES["sample_scores"] = f"""SELECT i.sample_id, round(mean_iou, 4) AS mean_iou, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
      round(coalesce(mean_error_m2, -1), 4) AS mean_error_m2, round(coalesce(max_error_m2, -1), 4) AS max_error_m2
    FROM ({ORACLES["eval_iou"].replace(SIDES, WIDE).replace(", 6) AS mean_iou", ", 12) AS mean_iou")}) i JOIN ({ORACLES["eval_windows"]}) w ON i.sample_id = w.sample_id LEFT JOIN ({ORACLES["eval_area"]}) a ON a.sample_id = i.sample_id"""
ORACLES["filled_truth"] = f"""{duck("v_facade", "v_element")}, own AS (SELECT DISTINCT facade_id FROM v_element WHERE side = 'F')
    SELECT facade_id AS stem, element_id, x, y, w, h, CASE side WHEN 'F' THEN 'truth' ELSE 'found' END AS source FROM v_element
    WHERE side = 'F' OR (facade_id IN (SELECT facade_id FROM v_facade) AND facade_id NOT IN (SELECT facade_id FROM own))"""
ORACLES["relative_boxes"] = f"""{duck("v_facade", "v_element")}
    SELECT element_id, round((e.x - f.x) / f.w::DOUBLE, 6) AS x, round((e.y - f.y) / f.h::DOUBLE, 6) AS y, round(e.w / f.w::DOUBLE, 6) AS w, round(e.h / f.h::DOUBLE, 6) AS h,
           round((e.x + e.w // 2 - f.x) / f.w::DOUBLE, 6) AS px, round((e.y + e.h // 2 - f.y) / f.h::DOUBLE, 6) AS py, CASE WHEN score % 2 = 0 AND score > 0 THEN score ELSE e.w * e.h END AS area_px
    FROM v_element e JOIN v_facade f ON e.facade_id = f.facade_id"""
