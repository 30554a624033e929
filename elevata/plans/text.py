"""Queries over texts and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import correlate as C
from ..sources.adapter import duck, view


def parse_measurement(spark, sf):
    t = view(spark, sf, "v_token")
    return t.withColumn("m", X.measurement(F.col("text"))).select("token_id", "text", "m.value", "m.unit")


def label_keys(spark, sf):
    e = view(spark, sf, "v_element")
    return e.select("element_id", X.label_key(F.lower("label")).alias("key"), X.element_type(F.col("label")).alias("kind_read"))


def door_signal(spark, sf):
    e = view(spark, sf, "v_element")
    ocr = F.when(F.col("score") % 3 == 0, F.lit("FATADA 1")).when(F.col("score") % 3 == 1, F.lit(" u-12 "))
    return e.select("element_id", X.door_signal(F.col("label"), ocr, F.when(F.col("known"), F.col("w_cm") * F.col("h_cm") / 10000.0)).alias("is_door"))


def document_slugs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", X.slug(F.concat_ws(" - ", "source", "lang", "text")).alias("slug"))


def _measured(spark, sf):
    t = view(spark, sf, "v_token")
    return t.withColumn("m", X.measurement(F.col("text"))).select("*", "m.*").drop("m").withColumn("cx", F.floor((2 * F.col("x") + F.col("w")) / 2)).withColumn("cy", F.floor((2 * F.col("y") + F.col("h")) / 2))


def nearby_numbers(spark, sf):
    tokens = _measured(spark, sf)
    return C.nearby_numbers(tokens, tokens.filter("value IS NOT NULL"), most=200.0, distance=400, keep=2)


def element_labels(spark, sf):
    tokens = _measured(spark, sf)
    labels = view(spark, sf, "v_element").select(F.col("facade_id").alias("image_id"), F.col("element_id").alias("token_id"), "kind", "label", F.floor((2 * F.col("x") + F.col("w")) / 2).alias("cx"), F.floor((2 * F.col("y") + F.col("h")) / 2).alias("cy"))
    return C.label_values(labels, tokens.filter("value IS NOT NULL"))


VALUE = r"""
  SELECT *, CASE WHEN area <> '' THEN CASE WHEN area::DOUBLE > 100 AND NOT contains(area, '.') THEN 0 - 1 ELSE area::DOUBLE END
                 WHEN len <> '' THEN CASE WHEN len::DOUBLE > 100 AND NOT contains(len, '.') THEN 0 - 2 ELSE len::DOUBLE END
                 WHEN bare <> '' AND bare::DOUBLE > 0.1 AND bare::DOUBLE < 200 THEN bare::DOUBLE END AS v0
  FROM (SELECT *, regexp_extract(replace(text, ',', '.'), '(?i)(\d+\.?\d*)\s*(?:m[²2]|mp)', 1) AS area, regexp_extract(replace(text, ',', '.'), '(?i)(\d+\.?\d*)\s*m(?:[^\d²2p]|$)', 1) AS len,
               regexp_extract(replace(text, ',', '.'), '(\d+\.\d{2,3})\b', 1) AS bare FROM v_token)"""
FIXED = """
  SELECT *, CASE WHEN v0 < 0 THEN CASE WHEN n BETWEEN 100 AND 999 THEN n / 100.0::DOUBLE
      WHEN n BETWEEN 1000 AND 9999 THEN CASE WHEN n / 1000.0::DOUBLE > 0.5 AND n / 1000.0::DOUBLE < 15 THEN n / 1000.0::DOUBLE WHEN n / 100.0::DOUBLE > 1 AND n / 100.0::DOUBLE < 200 THEN n / 100.0::DOUBLE ELSE n / 1000.0::DOUBLE END
      WHEN n BETWEEN 10000 AND 99999 THEN n / 1000.0::DOUBLE ELSE n::DOUBLE END ELSE v0 END AS value,
      CASE WHEN area <> '' THEN 'm²' WHEN len <> '' THEN 'm' WHEN v0 < 30 THEN 'm' WHEN v0 IS NOT NULL THEN 'm²' END AS unit,
      x + w // 2 AS cx, y + h // 2 AS cy
  FROM (SELECT *, CASE v0 WHEN -1 THEN area::BIGINT WHEN -2 THEN len::BIGINT END AS n FROM raw_value)"""
MEASURED = duck("v_token") + f", raw_value AS ({VALUE}), m AS ({FIXED})"

QUERIES = {f.__name__: f for f in (parse_measurement, label_keys, door_signal, document_slugs, nearby_numbers, element_labels)}
ORACLES = {
    "parse_measurement": f"{MEASURED} SELECT token_id, text, value, unit FROM m",
    "label_keys": f"""{duck("v_element")} SELECT element_id, CASE WHEN regexp_matches(upper(label), '^[FU][_-]?[0-9]+') THEN regexp_extract(upper(label), '^([FU])[_-]?([0-9]+)', 1) || regexp_extract(upper(label), '^([FU])[_-]?([0-9]+)', 2) ELSE upper(label) END AS key,
        CASE label[1] WHEN 'F' THEN 'window' WHEN 'U' THEN 'door' END AS kind_read FROM v_element""",
    "door_signal": f"""{duck("v_element")} SELECT element_id, score % 3 <> 0 AND (regexp_matches(upper(label), '\\bU(?:SA)?[_ -]*[0-9]+\\b') OR score % 3 = 1 OR (known AND w_cm * h_cm / 10000.0::DOUBLE BETWEEN 0.5 AND 6.5)) AS is_door FROM v_element""",
    "document_slugs": "SELECT doc_id, trim(regexp_replace(strip_accents(concat_ws(' - ', source, lang, text)), '[^A-Za-z0-9]+', '_', 'g'), '_') AS slug FROM documents",
    "nearby_numbers": f"""{MEASURED}, p AS (SELECT a.token_id, b.token_id AS value_id, b.value, sqrt(((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))::DOUBLE) AS distance
        FROM m a JOIN m b ON a.image_id = b.image_id AND b.value BETWEEN 0.01 AND 200),
        k AS (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY distance, value_id) AS rank FROM p WHERE distance < 400)
        SELECT token_id, rank::INT AS rank, value_id, value, distance FROM k WHERE rank <= 2""",
    "element_labels": f"""{MEASURED}, e AS ({"SELECT facade_id AS image_id, element_id AS token_id, kind, label, x + w // 2 AS cx, y + h // 2 AS cy FROM v_element"}),
        p AS (SELECT e.token_id, b.token_id AS value_id, b.value, sqrt(((e.cx - b.cx) * (e.cx - b.cx) + (e.cy - b.cy) * (e.cy - b.cy))::DOUBLE) AS d, kind
              FROM e JOIN m b ON e.image_id = b.image_id AND b.value >= 0.01),
        k AS (SELECT token_id, arg_min(value, (d, value_id)) AS value FROM p WHERE d < CASE kind WHEN 'door' THEN 80 ELSE 120 END AND value <= CASE kind WHEN 'door' THEN 8 ELSE 20 END GROUP BY token_id)
        SELECT e.token_id, e.label, coalesce(k.value, 0) AS area_m2 FROM e LEFT JOIN k ON e.token_id = k.token_id""",
}
