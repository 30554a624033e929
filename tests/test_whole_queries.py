"""Queries over every row of their tables, against plain Python."""

import re
import unicodedata

from elevata import plans
from elevata.operators import correlate as C
from elevata.operators import scale as S
from elevata.sources.adapter import view

SF = "/root/testdata/sf0.001"


def test_summary_of_every_image(spark):
    lines = {}
    for r in plans.QUERIES["facade_report"](spark, SF).join(view(spark, SF, "v_facade").select("facade_id", "total_cm2"), "facade_id").collect():
        cm2 = [r["total_cm2"], round(r["carpentry_m2"] * 10000), round(r["net_m2"] * 10000)]
        two = [f"{(c + 50) // 10000}.{(c + 50) // 100 % 100:02}" for c in cm2]
        lines.setdefault(r["image_id"], []).append((r["facade_id"], f"{r['name']}: total {two[0]} m2, carpentry {two[1]} m2, net {two[2]} m2"))
    want = {i: "\n".join(text for _, text in sorted(rows)) for i, rows in lines.items()}
    got = plans.QUERIES["summary_text"](spark, SF).collect()
    assert len(got) == len(want) and {r["image_id"]: r["text"] for r in got} == want
    assert any(i % 10 for i in want)


def test_slugs_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()

    def slug(d):
        text = " - ".join(x for x in (d["source"], d["lang"], d["text"]) if x is not None)
        plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
        return re.sub("[^A-Za-z0-9]+", "_", plain).strip("_")

    want = {d["doc_id"]: slug(d) for d in docs}
    got = {r["doc_id"]: r["slug"] for r in plans.QUERIES["document_slugs"](spark, SF).collect()}
    assert got == want and max(map(len, want.values())) > 10000


def facades(spark):
    out = {}
    for f in view(spark, SF, "v_facade").collect():
        out.setdefault(f["image_id"], []).append(f)
    return out


def test_proximity_to_all_facades(spark):
    boxes = facades(spark)
    image = {f["facade_id"]: i for i, fs in boxes.items() for f in fs}
    out = lambda p, a, n: max(a - p, p - a - n, 0)
    near = lambda e, f: out(e["x"], f["x"], f["w"]) ** 2 + out(e["y"], f["y"], f["h"]) ** 2 <= 80 ** 2
    want = [e["element_id"] for e in view(spark, SF, "v_element").collect() if e["facade_id"] in image and any(near(e, f) for f in boxes[image[e["facade_id"]]])]
    assert sorted(r["element_id"] for r in plans.QUERIES["filter_proximity"](spark, SF).collect()) == sorted(want)


def test_all_facades_as_labels_and_regions(spark):
    want = []
    for i, fs in facades(spark).items():
        far = lambda a, b: (a["x"] - b["x"] - b["w"] // 2) ** 2 + (a["y"] - b["y"] - b["h"] // 2) ** 2
        pairs = sorted((far(a, b), a["facade_id"], b["facade_id"]) for a in fs for b in fs if far(a, b) <= 600 ** 2)
        taken, used = {}, set()
        for _, a, b in pairs:
            if a not in taken and b not in used:
                taken[a] = b
                used.add(b)
        want += [(i, f["facade_id"], taken.get(f["facade_id"], -1)) for f in fs]
    assert sorted(tuple(r) for r in plans.QUERIES["match_facade_regions"](spark, SF).collect()) == sorted(want)


def test_metrics_and_warnings_of_all_facades(spark):
    rows = {r["image_id"]: r for r in plans.QUERIES["signal_metrics"](spark, SF).collect()}
    every = [f for fs in facades(spark).values() for f in fs]
    assert {f["facade_id"] for f in every} <= set(rows)
    assert all(rows[f["facade_id"]]["facades_total"] + rows[f["facade_id"]]["color_facades"] == 1 for f in every)
    known = {f["facade_id"] for f in every}
    warned = {r["image_id"] for r in plans.QUERIES["warnings"](spark, SF).collect() if r["code"] == "no_facade"}
    assert not warned & known


def test_images_without_facades(spark):
    elements = spark.createDataFrame([(1, 10, 0, 0), (1, 11, 900, 0), (2, 20, 900, 0)], "image_id long, element_id long, px long, py long")
    boxes = spark.createDataFrame([(1, 0, 0, 50, 50)], "image_id long, x long, y long, w long, h long")
    assert sorted(r["element_id"] for r in C.near_facades(elements, boxes).collect()) == [10, 20]
    labels = spark.createDataFrame([(1, 5, 0, 0), (2, 6, 0, 0), (3, 7, 0, 0)], "image_id long, label_id long, lx long, ly long")
    regions = spark.createDataFrame([(1, 8, 0, 0, 50, 50), (3, 9, 2000, 0, 50, 50)], "image_id long, region_id long, x long, y long, w long, h long")
    assert sorted(tuple(r) for r in C.match_regions(labels, regions, 600).collect()) == [(1, 5, 8), (2, 6, None), (3, 7, None)]
    drawn = spark.createDataFrame([(1, 20.0, 0.0, "ocr")], "image_id long, area_m2 double, socle_m2 double, origin string")
    found = spark.createDataFrame([(1, "window", 2.0, 1.0, 2.0, "ocr"), (2, "window", None, None, None, "ocr")], "image_id long, kind string, area_m2 double, width_m double, height_m double, origin string")
    metrics = S.signal_metrics(drawn, found)
    assert {r["image_id"]: (r["facades_total"], r["ocr_windows"]) for r in metrics.collect()} == {1: (1, 1), 2: (0, 1)}
    got = S.warnings(metrics.selectExpr("*", "CAST(NULL AS DOUBLE) AS px_per_m")).collect()
    assert sorted(tuple(r) for r in got) == [(2, "no_facade", "high"), (2, "no_lengths", "low"), (2, "no_signal", "high")]


def by_facade(spark, keep=lambda e: True):
    boxes = {f["facade_id"]: f for f in view(spark, SF, "v_facade").collect()}
    out = {}
    for e in view(spark, SF, "v_element").collect():
        if keep(e) and e["facade_id"] in boxes:
            out.setdefault(e["facade_id"], []).append(e)
    return boxes, out


def test_fragments_by_loops(spark):
    boxes, parts = by_facade(spark, lambda e: e["kind"] == "window")
    want, joins = [], 0
    for i, es in parts.items():
        f = boxes[i]
        left = [(f["x"] + e["x"] % f["w"], f["y"] + e["y"] % f["h"], e["w"], e["h"], e["element_id"], 1) for e in es]
        while True:
            left.sort()
            pair = None
            for k, a in enumerate(left):
                for b in left[k + 1:]:
                    x, y = min(a[0], b[0]), min(a[1], b[1])
                    w, h = max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y
                    gap = max(0, b[0] - a[0] - a[2], a[0] - b[0] - b[2])
                    shared = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
                    shaped = 0.06 <= w / f["w"] <= 0.20 and 0.16 <= h / f["h"] <= 0.55 and 0.22 <= (y + h * 0.5 - f["y"]) / f["h"] <= 0.70 and 0.55 <= w / h <= 2.20
                    if gap <= max(16, int(f["w"] * 0.02)) and shared >= min(a[3], b[3]) * 0.45 and shaped:
                        pair = a, b, (x, y, w, h, a[4], a[5] + b[5])
                        break
                if pair:
                    break
            if not pair:
                break
            left = [r for r in left if r not in pair[:2]] + [pair[2]]
            joins += 1
        want += [(i, r[4], *r[:4], r[5]) for r in left]
    got = [(r["facade_id"], r["region_id"], r["x"], r["y"], r["w"], r["h"], r["parts"]) for r in plans.QUERIES["merge_fragments"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and joins >= 3


def test_rows_by_loops(spark):
    boxes, parts = by_facade(spark)
    want = []
    for i, es in parts.items():
        row, n = [], 0
        for y, e in sorted((e["y"], e["element_id"]) for e in es):
            middle = (row[(len(row) - 1) // 2] + row[len(row) // 2]) / 2 if row else None
            row, n = (row + [y], n) if row and abs(y - middle) <= max(14.0, boxes[i]["h"] * 0.05) else ([y], n + 1)
            want.append((e, n))
    assert sorted((r["region_id"], r["row"]) for r in plans.QUERIES["row_groups_median"](spark, SF).collect()) == sorted(want)


def test_regions_read_by_loops(spark):
    from test_analysis import enrich, number

    tokens, regions = {}, {}
    for t in sorted(view(spark, SF, "v_token").collect(), key=lambda t: t["token_id"]):
        value, unit = number(t["text"])
        tokens.setdefault(t["image_id"], []).append({"text": t["text"], "value": value, "unit": unit, "c": ((2 * t["x"] + t["w"]) // 2, (2 * t["y"] + t["h"]) // 2)})
    for e in view(spark, SF, "v_element").collect():
        r = {"kind": e["kind"], "label": None, "x": e["x"], "y": e["y"], "w": e["w"] * 4, "h": e["h"] * 4}
        enrich(r, tokens[e["facade_id"]])
        if r["ocr"]:
            regions[e["element_id"]] = (r["area"] or 0.0, r["wm"] or 0.0, r["hm"] or 0.0, r["label"] or "", r["ocr"])
    got = {r["region_id"]: tuple(round(v, 9) if isinstance(v, float) else v for v in (r["area_m2"], r["width_m"], r["height_m"], r["label"], r["texts"])) for r in plans.QUERIES["enrich_regions"](spark, SF).collect()}
    assert got == {i: tuple(round(v, 9) if isinstance(v, float) else v for v in r) for i, r in regions.items()}


def test_texts_of_every_project(spark):
    """Sums of the texts' lines against the report's rows."""
    rows = {}
    for r in plans.QUERIES["project_totals"](spark, SF).collect():
        rows[r["image_id"]] = r
    texts = {r["image_id"]: r["text"] for r in plans.QUERIES["report_text"](spark, SF).collect()}
    assert texts.keys() == rows.keys()
    number = lambda line: float(line.rsplit(": ", 1)[1].split()[0])
    for i, text in texts.items():
        head, *blocks, end = text.split("\n\n")
        assert head == "RAPORT CANTITATI" and len(blocks) == rows[i]["n_facades"] and end.startswith("TOTALURI PROIECT\n")
        last = {line.strip().split(":")[0]: line for line in end.split("\n")[1:]}
        for label, c in (("Total ferestre", "windows_m2"), ("Total usi", "doors_m2"), ("TOTAL SOCLU EXCLUS", "socle_m2"), ("TOTAL GLAF EXTERIOR", "sill_m"), ("TOTAL PERIMETRU USI", "door_perimeter_m")):
            assert abs(number(last[label]) - rows[i][c]) <= 0.00051
        windows = [line for b in blocks for line in b.split("\n") if line.startswith("  Total ferestre")]
        assert abs(sum(map(number, windows)) - rows[i]["windows_m2"]) <= 0.00051 * len(blocks)
        for n, b in enumerate(blocks, 1):
            lines = b.split("\n")
            formula = next(x for x in lines if x.startswith("  Formula net"))
            value = {x.split(":")[0].strip(): x for x in lines if ": " in x}
            assert lines[0].startswith(f"{n}. FATADA_") and formula.endswith(f"= {number(value['TERMOSISTEM (net)']):.3f} m²")
