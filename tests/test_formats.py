import io
import json
import xml.etree.ElementTree as ET
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from elevata.sinks import documents as D
from elevata.sources import formats as S


def test_world_files(spark, tmp_path):
    for name, text in {"a.pgw": "0.01\n0\n0\n-0.01\n5\n6", "a.wld": "9\n0\n0\n9\n5\n6", "b.pgw": "x\n0", "b.pngw": "0,02\n0\n0\n0\n5\n6\n", "c.x.wld": "0.5\n0\n0\n-0.25\n5\n6"}.items():
        (tmp_path / name).write_text(text)
    got = {r["stem"]: (r["px_per_m"], r["axis_difference"]) for r in S.world_files(spark, str(tmp_path)).collect()}
    assert got == {"a": (100.0, 0.0), "b": (50.0, 1.0), "c.x": (pytest.approx(1 / 0.375), 0.5)}


def test_truth_and_annotations(spark, tmp_path):
    truth = tmp_path / "gt"
    truth.mkdir()
    (truth / "One.json").write_text(json.dumps({"sample_id": "1", "facades": [{"name": "A", "bbox": [1, 2, 3, 4], "total_area_m2": 9.5, "area_m2": 1}], "windows": [{"label": "F1", "bbox": [0, 0, 1, 1], "area": 2}], "doors": [{"bbox": [1]}]}))
    (truth / "Two.json").write_text("{}")
    got = sorted((r["stem"], r["kind"], r["label"], r["x"], r["h"], r["area_m2"]) for r in S.ground_truth(spark, str(truth)).collect())
    assert got == [("one", "facade", "A", 1, 4, 9.5), ("one", "window", "F1", 0, 1, 2.0)]
    (tmp_path / "x.xml").write_text("<annotation><size><width>100</width><height>50</height></size><object><name>facade</name><bndbox><xmin>10</xmin><ymin>15</ymin><xmax>90</xmax><ymax>45</ymax></bndbox></object><object><name> </name></object></annotation>")
    (tmp_path / "y.json").write_text(json.dumps([{"annotations": [{"label": "usa", "coordinates": {"x": 50, "y": 30, "width": 20, "height": 10}}]}]))
    (tmp_path / "z.txt").write_text("0 0.5 0.6 0.8 0.6\nbad\n7 0 0 1 1\n")
    voc, js, yolo = S.voc_annotations(spark, str(tmp_path)), S.label_json(spark, str(tmp_path)), S.yolo_labels(spark, str(tmp_path), S.class_map(["facade", "window", "door", "socle"]))
    assert [tuple(r) for r in voc.collect()] == [("x", 100, 50, 0, "facade", 10.0, 15.0, 80.0, 30.0)]
    assert [tuple(r) for r in js.collect()] == [("y", 0, "usa", 40.0, 25.0, 20.0, 10.0)]
    assert [tuple(r) for r in yolo.collect()] == [("z", 0, "0.5 0.6 0.8 0.6")]
    both = S.best_annotations(("xml", voc), ("json", js.unionByName(js.withColumn("stem", F.lit("x"))))).collect()
    assert sorted((r["stem"], r["source"]) for r in both) == [("x", "xml"), ("y", "json")]
    with pytest.raises(ValueError, match="door, socle"):
        S.class_map(["Window", "facade"])
    ids = spark.createDataFrame([("Ușa ",), ("facade",)], "n string").select(S.class_id(F.col("n"))).collect()
    assert [r[0] for r in ids] == [2, 0]


def test_equal_names_in_two_folders_stay_apart(spark, tmp_path):
    for owner, size in (("one", "0.01"), ("two two", "0.02")):
        (tmp_path / owner).mkdir()
        (tmp_path / owner / "Fatada.pgw").write_text(f"{size}\n0\n0\n-{size}\n5\n6")
        (tmp_path / owner / "Fatada.json").write_text(json.dumps([{"annotations": [{"label": owner, "coordinates": {"x": 5, "y": 5, "width": 2, "height": 2}}]}]))
    assert {r["stem"]: r["px_per_m"] for r in S.world_files(spark, str(tmp_path)).collect()} == {"one/fatada": 100.0, "two two/fatada": 50.0}
    assert {r["stem"]: r["name"] for r in S.label_json(spark, f"file://{tmp_path}/").collect()} == {"one/fatada": "one", "two two/fatada": "two two"}


def test_reference_shapes_and_baselines(spark, tmp_path):
    refs = tmp_path / "refs"
    refs.mkdir()
    shape = {"reference_id": "a", "scene": "flat", "image_size": [100, 50], "targets": {"facade_bbox": [1, 2, 3, 4], "facade_contour": [[0, 0], [1, 1]], "window_boxes": [[1, 1, 2, 2]]}}
    (refs / "a.json").write_text("\ufeff" + json.dumps(shape), encoding="utf-8")
    (refs / "b.json").write_text(json.dumps({"reference_id": "b", "targets": {"facade_net_area_m2": 24.81, "openings": [{"id": "o1", "type": "window", "target_area_m2": 1.5}]}}))
    (refs / "c.json").write_text("{}")
    got = {r["stem"]: r for r in S.reference_shapes(spark, str(refs)).collect()}
    assert set(got) == {"a", "b"} and got["a"]["facade_bbox"] == [1, 2, 3, 4] and (got["a"]["width"], got["a"]["height"]) == (100, 50)
    assert got["b"]["openings"][0]["target_area_m2"] == 1.5 and got["b"]["facade_bbox"] is None
    case = {"id": "x", "facades": [{"x": 1, "y": 2, "w": 3, "h": 4}], "doors": [{"x": 5, "y": 6, "w": 7, "h": 8}, {"x": 0, "y": 0, "w": 1, "h": 1}]}
    for name, body in (("m.json", {"cases": [case]}), ("l.json", [case])):
        (tmp_path / name).write_text(json.dumps(body))
        rows = sorted((r["case_id"], r["kind"], r["ord"], r["x"], r["h"]) for r in S.baseline_boxes(spark, str(tmp_path / name)).collect())
        assert rows == [("x", "door", 0, 5.0, 8.0), ("x", "door", 1, 0.0, 1.0), ("x", "facade", 0, 1.0, 4.0)]


def test_manifest_with_mark(spark, tmp_path):
    (tmp_path / "m.json").write_text("﻿" + json.dumps({"scenarios": [{"id": "a", "expected": {"windows": 4}, "focus": ["x"]}, {"id": "b"}]}), encoding="utf-8")
    rows = S.manifest(spark, str(tmp_path / "m.json")).collect()
    assert [(r["id"], r["expected"]["windows"] if r["expected"] else None) for r in rows] == [("a", 4), ("b", None)]


def test_workbook_and_page():
    book = D.xlsx({"One": [["a", "b"], [1, "x & <y>"], [2.5, None]], "Two": []})
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        assert z.testzip() is None
        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        cells = ET.fromstring(z.read("xl/worksheets/sheet1.xml")).findall(".//m:c", ns)
        assert [(c.get("r"), "".join(c.itertext())) for c in cells] == [("A1", "a"), ("B1", "b"), ("A2", "1"), ("B2", "x & <y>"), ("A3", "2.5")]
        assert [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).findall(".//m:sheet", ns)] == ["One", "Two"]
    image = np.random.default_rng(0).integers(0, 255, (20, 30, 3), dtype=np.uint8)
    page = D.pdf(image, 254, "scale (1:50)")
    assert page.startswith(b"%PDF") and b"/MediaBox [0 0 8.504 5.669]" in page and b"scale \\(1:50\\)" in page
    start = page.index(b"stream\n", page.index(b"/Subtype /Image")) + 7
    assert zlib.decompress(page[start: page.index(b"\nendstream", start)]) == image[..., ::-1].tobytes()
    assert int(page.rstrip().split(b"\n")[-2]) == page.index(b"xref\n")


def test_png_round_trip(spark, tmp_path):
    image = D.overlay(np.random.default_rng(0).integers(0, 255, (20, 30, 3), dtype=np.uint8), [("door", (2, 3, 5, 6)), ("window", (25, 15, 50, 50))])
    (tmp_path / "a.png").write_bytes(D.png(image))
    row = S.decoded_images(spark, str(tmp_path)).first()
    assert row["error"] is None and np.array_equal(np.frombuffer(row["data"], np.uint8).reshape(20, 30, 3), image)
    data = D.png(image)
    assert D.png_dpi(data) is None
    phys = b"pHYs" + (10000).to_bytes(4, "big") * 2 + b"\x01"
    assert D.png_dpi(data[:33] + (9).to_bytes(4, "big") + phys + b"0000" + data[33:]) == pytest.approx(254)


def test_listings_and_manual_rows(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.PNG", "sub/b.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["stem"] for r in S.image_files(spark, str(tmp_path)).collect()) == ["a", "sub/b"]
    assert [r["stem"] for r in S.image_files(spark, str(tmp_path), recursive=False).collect()] == ["a"]
    rows = S.manual_rows(spark, [{"facade": "A", "kind": "door", "label": "U1", "area_m2": 2}, {"facade": "A"}]).collect()
    assert [tuple(r) for r in rows] == [("A", "door", "U1", 2.0), ("A", None, None, 0.0)]


def test_workbooks_and_labels(spark, tmp_path):
    columns = ["total_m2", "carpentry_m2", "net_m2", "socle_m2", "windows_m2", "doors_m2", "sill_m", "drip_m", "corner_m", "socle_drip_m", "window_perimeter_m", "door_perimeter_m"]
    facades = spark.createDataFrame([(1, 2, "B", *map(float, range(12))), (1, 1, "A", *([2.0] * 12)), (2, 1, "C", *([0.0] * 12))], "image_id long, facade_id long, name string, " + ", ".join(f"{c} double" for c in columns))
    elements = spark.createDataFrame([(1, 1, "t1", "door", "U1", 1.5), (1, 1, "t2", "window", "F1", 0.5), (3, 1, "x", "door", "U9", 1.0)], "image_id long, facade_id long, element_id string, kind string, label string, area_m2 double")
    files = {r["image_id"]: r["file"] for r in D.write_workbooks(facades, elements, f"file://{tmp_path}/books").collect()}
    assert files == {1: "quantities-1.xlsx", 2: "quantities-2.xlsx"}
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(tmp_path / "books" / "quantities-1.xlsx") as z:
        sheets = [[["".join(c.itertext()) for c in row] for row in ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).findall(".//m:row", ns)] for i in (1, 2, 3)]
    assert sheets[0][0] == ["RAPORT CANTITATI - 1"] and len(sheets[0][3]) == 7
    assert sheets[0][4:8] == [["1", "A", "FATADA", "Termosistem", "2.0"], ["A", "F1", "Fereastra", "0.5"], ["A", "U1", "Usa", "1.5"], ["  Subtotal A", "2.0", "2.0"]]
    assert [r[0] for r in sheets[0][-10:]] == [t for t, _ in D.TOTALS] and sheets[0][-10] == ["TOTAL SUPRAFATA FATADE", "2.0"]
    assert [len(r) for r in sheets[1][2:]] == [11] * 4 and sheets[1][-1][:3] == ["TOTAL", "2.0", "3.0"]
    assert ["Glaf exterior", "8.0"] in sheets[2] and sheets[2][-1] == ["TOTAL goluri (uși + ferestre)", "3.0"]
    assert sum(len(r) >= 2 and r[0] != "Descriere" for r in sheets[2]) == 22
    images = spark.createDataFrame([(f"i{i}",) for i in range(30)], "stem string")
    split = D.validation_split(images)
    assert split.filter("split = 'val'").count() == 4 and split.count() == 30
    D.write_yolo(split.withColumn("line", F.lit("0 0.5 0.5 1 1")), str(tmp_path / "yolo"))
    assert spark.read.text(str(tmp_path / "yolo" / "labels")).count() == 30
    regions = spark.createDataFrame([("a", "door", "U_1", 1, 2, 3, 4), ("a", "facade", "X", 0, 0, 9, 9)], "image_id string, kind string, label string, x int, y int, w int, h int")
    assert json.loads(D.ground_truth_json(regions).first()["json"]) == {"sample_id": "a", "facades": [{"label": "X", "bbox": [0, 0, 9, 9]}], "windows": [], "doors": [{"label": "U_1", "bbox": [1, 2, 3, 4]}], "socles": []}
