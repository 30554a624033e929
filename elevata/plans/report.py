"""Report queries over the adapter tables, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import label_key
from ..operators import report as R
from ..sources.adapter import duck, view


def _facades(spark: SparkSession, sf: str) -> DataFrame:
    """Facades with a socle below every fourth, and a pixel as a centimetre."""
    socle = F.when(F.col("facade_id") % 4 == 0, F.col("w") * 100).otherwise(0).cast("long")
    return view(spark, sf, "v_facade").withColumns({"socle": socle, "corner": 2 * F.col("h"), "socle_drip": F.col("w")})


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return R.facade_report(_facades(spark, sf), view(spark, sf, "v_element"))


def facade_report(spark, sf):
    return R.shown(_report(spark, sf), "image_id", "facade_id", "name")


def project_totals(spark, sf):
    return R.shown(R.project_totals(_report(spark, sf), "image_id"), "image_id", "n_facades")


def report_grouping_sets(spark, sf):
    return R.detail_rows(_report(spark, sf), view(spark, sf, "v_element"))


def quantities_list(spark, sf):
    return R.quantities_list(R.project_totals(_report(spark, sf), "image_id"), "image_id")


def _zones(facades):
    return facades.filter("facade_id % 5 = 0").select("facade_id", (F.col("w") * 100).alias("zone_cm2"))


def missing_zone_report(spark, sf):
    rows = R.with_missing_zones(_report(spark, sf), _zones(view(spark, sf, "v_facade")))
    return rows.select("facade_id", (F.col("reconstructed") / 10000.0).alias("reconstructed_m2"), (F.col("total") / 10000.0).alias("total_m2"), (F.col("net") / 10000.0).alias("net_m2"))


def orphan_parent_last(spark, sf):
    facades = view(spark, sf, "v_facade").select("image_id", "facade_id")
    elements = view(spark, sf, "v_element").join(facades, "facade_id").select("image_id", "element_id", F.when(F.col("score") < 20, -1).otherwise(F.col("facade_id")).cast("long").alias("facade_id"))
    return R.with_fallback_parent(elements, facades).select("image_id", "element_id", "facade_id")


def summary_text(spark, sf):
    return R.summary_text(_report(spark, sf), "image_id")


def report_text(spark, sf):
    """The whole report as text, of every project."""
    report = R.with_missing_zones(_report(spark, sf), _zones(view(spark, sf, "v_facade")))
    return R.report_text(report, view(spark, sf, "v_element"), "image_id")


def propagate_areas(spark, sf):
    e = view(spark, sf, "v_element")
    e = e.select(F.col("facade_id").alias("image_id"), "element_id", "kind", label_key(F.col("label")).alias("key"), F.when(F.col("known"), F.col("w_cm") * F.col("h_cm")).alias("area_cm2"))
    return R.propagated_areas(e).select("element_id", "key", "area_m2")


SUMS = """sums AS (
  SELECT facade_id, sum(CASE kind WHEN 'window' THEN w_cm * h_cm ELSE 0 END)::BIGINT AS windows, sum(CASE kind WHEN 'door' THEN w_cm * h_cm ELSE 0 END)::BIGINT AS doors,
         count(*) FILTER (WHERE kind = 'window') AS n_windows, count(*) FILTER (WHERE kind = 'door') AS n_doors,
         sum(CASE kind WHEN 'window' THEN w_cm ELSE 0 END)::BIGINT AS sill, sum(w_cm)::BIGINT AS drip,
         sum(CASE kind WHEN 'window' THEN 2 * (w_cm + h_cm) ELSE 0 END)::BIGINT AS window_perimeter, sum(CASE kind WHEN 'door' THEN 2 * h_cm + w_cm ELSE 0 END)::BIGINT AS door_perimeter
  FROM v_element GROUP BY facade_id),
r AS (
  SELECT f.*, coalesce(windows, 0) AS windows, coalesce(doors, 0) AS doors, coalesce(n_windows, 0) AS n_windows, coalesce(n_doors, 0) AS n_doors, coalesce(sill, 0) AS sill, coalesce(drip, 0) AS drip,
         coalesce(window_perimeter, 0) AS window_perimeter, coalesce(door_perimeter, 0) AS door_perimeter, coalesce(windows, 0) + coalesce(doors, 0) AS carpentry,
         greatest(total_cm2 - coalesce(windows, 0) - coalesce(doors, 0), 0) AS net, total_cm2 AS total,
         CASE WHEN f.facade_id % 4 = 0 THEN f.w * 100 ELSE 0 END AS socle, total_cm2 + CASE WHEN f.facade_id % 4 = 0 THEN f.w * 100 ELSE 0 END AS gross, 0 AS reconstructed, 2 * f.h AS corner, f.w AS socle_drip
  FROM v_facade f LEFT JOIN sums s ON f.facade_id = s.facade_id)"""
SHOWN = ", ".join([*(f"{c} / 10000.0::DOUBLE AS {c}_m2" for c in R.AREAS), *(f"{c} / 100.0::DOUBLE AS {c}_m" for c in R.LENGTHS), "n_windows", "n_doors"])
BASE = duck("v_facade", "v_element") + ",\n" + SUMS
TOTALS = ", t AS (SELECT image_id, count(*) AS n_facades, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in (*R.AREAS, *R.LENGTHS, "n_windows", "n_doors")) + " FROM r GROUP BY image_id)"

QUERIES = {f.__name__: f for f in (facade_report, project_totals, report_grouping_sets, quantities_list, missing_zone_report, orphan_parent_last, summary_text, report_text, propagate_areas)}
ORACLES = {
    "facade_report": f"{BASE} SELECT image_id, facade_id, name, {SHOWN} FROM r",
    "project_totals": f"{BASE}{TOTALS} SELECT image_id, n_facades, {SHOWN} FROM t",
    "report_grouping_sets": f"""{duck("v_facade", "v_element")}
        SELECT image_id, coalesce(facade_id, -1) AS facade_id, coalesce(kind, 'all') AS kind, (4 * grouping(image_id) + 2 * grouping(facade_id) + grouping(kind))::INT AS level, sum(w_cm * h_cm)::BIGINT AS area_cm2, count(*) AS n
        FROM v_element JOIN (SELECT facade_id, image_id FROM v_facade) USING (facade_id)
        GROUP BY GROUPING SETS ((image_id, facade_id, kind), (image_id, facade_id), (image_id))""",
    "quantities_list": f"{BASE}{TOTALS} " + " UNION ALL ".join(f"SELECT image_id, {s} AS section, {o} AS line, '{t}' AS label, '{u}' AS unit, {'0' if c is None else f'(({c} + 50) // 100)' if u == 'mp' else c} / 100.0::DOUBLE AS quantity FROM t" for s, o, t, c, u in R.QUANTITY_LINES),
    "missing_zone_report": f"""{BASE}, z AS (SELECT *, CASE WHEN facade_id % 5 = 0 THEN w * 100 ELSE 0 END AS zone FROM r)
        SELECT facade_id, zone / 10000.0::DOUBLE AS reconstructed_m2, (total + zone) / 10000.0::DOUBLE AS total_m2, greatest(total + zone - carpentry, 0) / 10000.0::DOUBLE AS net_m2 FROM z""",
    "orphan_parent_last": f"""{duck("v_facade", "v_element")}, last AS (SELECT image_id, max(facade_id) AS last_id FROM v_facade GROUP BY image_id)
        SELECT image_id, element_id, CASE WHEN score < 20 THEN last_id ELSE e.facade_id END AS facade_id
        FROM v_element e JOIN (SELECT facade_id, image_id FROM v_facade) f ON e.facade_id = f.facade_id JOIN last USING (image_id)""",
    "summary_text": f"""{BASE} SELECT image_id, string_agg(printf('%s: total %d.%02d m2, carpentry %d.%02d m2, net %d.%02d m2', name, (total + 50) // 10000, (total + 50) // 100 % 100, (carpentry + 50) // 10000, (carpentry + 50) // 100 % 100, (net + 50) // 10000, (net + 50) // 100 % 100), chr(10) ORDER BY facade_id) AS text
        FROM r GROUP BY image_id""",
    "propagate_areas": f"""{duck("v_element")}, k AS (SELECT *, regexp_extract(label, '^([FU][0-9]+)', 1) AS key, CASE WHEN known THEN w_cm * h_cm END AS area_cm2 FROM v_element)
        SELECT element_id, key, coalesce(area_cm2, median(area_cm2) OVER (PARTITION BY facade_id, kind, key)) / 10000.0::DOUBLE AS area_m2 FROM k""",
}
