"""Take-off tables derived from generic star-schema tables, for tests and
benchmarks: orders become facades, line items become openings and tokens,
embeddings become small grey images.

Each view is written once, in SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_facade": """
        SELECT o_custkey AS image_id, o_orderkey AS facade_id, concat('FATADA_', o_orderkey) AS name,
               CAST(round(o_totalprice * 100) AS BIGINT) AS total_cm2,
               (o_orderkey * 37) % 1600 AS x, (o_orderkey * 23) % 600 AS y,
               200 + o_orderkey % 1200 AS w, 120 + o_orderkey % 400 AS h
        FROM orders""",
    "v_element": """
        SELECT l_orderkey AS facade_id, l_orderkey * 100 + ord AS element_id, ord,
               CASE l_returnflag WHEN 'R' THEN 'door' ELSE 'window' END AS kind,
               CAST(round(l_quantity * 10) AS BIGINT) AS w_cm, 50 + l_partkey % 350 AS h_cm,
               (l_partkey * 7) % 2000 AS x, (l_suppkey * 13) % 1000 AS y,
               20 + l_partkey % 180 AS w, 20 + l_suppkey % 160 AS h,
               concat(CASE l_returnflag WHEN 'R' THEN 'U' ELSE 'F' END, l_linenumber, '-', l_partkey % 3) AS label,
               l_discount >= 0.03 AS known, l_partkey % 97 AS score, l_linestatus AS side
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord FROM lineitem) AS numbered""",
    "v_token": """
        SELECT facade_id AS image_id, element_id AS token_id, x, y, w, h,
               CASE element_id % 6 WHEN 0 THEN concat(w, ',', 10 + h % 90, ' m²') WHEN 1 THEN concat(100 + w, 'm') WHEN 2 THEN concat(1000 + w * 7, 'm')
                    WHEN 3 THEN concat(1 + w % 9, '.', 100 + h, ' m') WHEN 4 THEN concat(10 + w % 50, '.', 10 + h % 90, ' mp') ELSE 'FATADA' END AS text
        FROM v_element""",
    "v_pixel": """
        SELECT vec_id AS image_id, pos % 8 AS x, CAST(floor(pos / 8) AS BIGINT) AS y, v
        FROM pixels""",
}
NEEDS = {"v_facade": [], "v_element": [], "v_token": ["v_element"], "v_pixel": []}

#: The pixels of an image, in DuckDB's words.
DUCK_PIXELS = "SELECT vec_id, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"


def _all(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for each in (*NEEDS[name], name):
            if each not in out:
                out.append(each)
    return out


def duck(*names: str, recursive: bool = False) -> str:
    """The views as the beginning of a DuckDB statement."""
    parts = [f"pixels AS ({DUCK_PIXELS})"] if "v_pixel" in names else []
    parts += [f"{n} AS ({VIEWS[n]})" for n in _all(names)]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the Parquet tables of ``sf_dir``."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "v_facade":
        return spark.sql(VIEWS[name].replace("FROM orders", "FROM {t}"), t=read("orders"))
    if name == "v_element":
        return spark.sql(VIEWS[name].replace("FROM lineitem", "FROM {t}"), t=read("lineitem"))
    if name == "v_token":
        return spark.sql(VIEWS[name].replace("FROM v_element", "FROM {t}"), t=view(spark, sf_dir, "v_element"))
    pixels = read("embeddings").selectExpr("vec_id", "posexplode(embedding) AS (pos, v)").selectExpr("vec_id", "CAST(pos AS BIGINT) AS pos", "CAST(v AS DOUBLE) AS v")
    return spark.sql(VIEWS[name].replace("FROM pixels", "FROM {t}"), t=pixels)
