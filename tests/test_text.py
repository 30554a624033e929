import pytest
from pyspark.sql import functions as F

from elevata.functions import text as X
from elevata.operators.scale import ratio_votes


@pytest.mark.parametrize("text,value,unit", [
    ("24.29 m²", 24.29, "m²"), ("24,29 m2", 24.29, "m²"), ("6.080 m", 6.08, "m"), ("31.53 mp", 31.53, "m²"), ("226m", 2.26, "m"),
    ("5886m²", 5.886, "m²"), ("6220m", 6.22, "m"), ("54.279", 54.279, "m²"), ("24.29", 24.29, "m"), ("FATADA", None, None), (None, None, None), ("", None, None),
])
def test_measurement(spark, text, value, unit):
    row = spark.createDataFrame([(text,)], "t string").select(X.measurement(F.col("t")).alias("m")).first()["m"]
    assert (None if row["value"] is None else pytest.approx(row["value"]), row["unit"]) == (value, unit)


def test_labels_and_slugs(spark):
    rows = spark.createDataFrame([("f 2-1",), ("F_2",), (" u12 ",), ("Soclu",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.label_key(F.col("t"))).collect()] == ["F2", "F2", "U12", "SOCLU", None]
    assert [r[0] for r in rows.select(X.element_type(F.col("t"))).collect()] == ["window", None, "door", None, None]
    titles = spark.createDataFrame([("Fatada principala",), ("parter",)], "t string").select(X.facade_title(F.col("t"))).collect()
    assert [t[0] for t in titles] == [True, False]
    slugs = spark.createDataFrame([("Ușă și fereastră (1)",), ("--",), ("Çà et là",)], "t string").select(X.slug(F.col("t"))).collect()
    assert [s[0] for s in slugs] == ["Usa_si_fereastra_1", "", "Ca_et_la"]


def test_scale_ratios(spark):
    texts = ["SC I:50 si 1/100", "200:1", "SCARA1:50", "PLAN1:100", "11:50", "1:5", "50:100", "l | 20", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.scale_ratios(F.col("t")).alias("r")).collect()
    want = [[(50, False), (100, False)], [(200, True)], [(50, False)], [(100, False)], [(50, False)], [], [(50, True)], [(20, False)], []]
    assert [[tuple(x) for x in r["r"] or []] for r in rows] == want


@pytest.mark.parametrize("text,score", [("SCR 1:20", 1.15), ("SC 1:20", 0.65), ("SC. 1:20", 1.15), ("Scara 1:20", 1.15), ("SCALE 1:20", 0.65), ("Scara 20:1", 0.95), ("1:30", 0.5)])
def test_ratio_scores(spark, text, score):
    """0.5 of confidence, 0.5 for a word (0.4 where reversed), 0.15 for a common ratio."""
    row = ratio_votes(spark.createDataFrame([(1, 1, text, 0.5)], "image_id long, token_id long, text string, confidence double")).first()
    assert row["score"] == pytest.approx(score)


def test_titles(spark):
    """The words that make a text a title."""
    texts = ["FATADA PRINCIPALA", "fatada stinga", "Fatada", "FATADA NORD", "Fatada laterala 2", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.qualified_title(F.col("t")).alias("q")).collect()
    assert [r["q"] for r in rows] == [True, True, False, False, True, None]
