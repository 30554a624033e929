"""Expected boxes are those of the rules' own worked examples."""

import random

import pytest
from pyspark.sql import functions as F

from elevata.functions.boxes import Box
from elevata.operators import matching as M
from elevata.operators import openings as O

WIDE = [(120, 150, 90, 95), (300, 150, 92, 98), (700, 150, 90, 95), (840, 150, 88, 96)]


def frames(spark, facade, boxes):
    f = spark.createDataFrame([(1, *facade)], "facade_id long, x long, y long, w long, h long")
    w = spark.createDataFrame([(1, i, *b) for i, b in enumerate(boxes)], "facade_id long, region_id long, x long, y long, w long, h long")
    return f, w


@pytest.mark.parametrize("facade,boxes,want", [
    ((0, 0, 1000, 500), [*WIDE, (470, 185, 115, 235)], (470, 185, 115, 235, -1)),
    ((0, 0, 1000, 500), [*WIDE, (470, 180, 112, 86), (474, 272, 108, 155)], (470, 180, 112, 247, 5)),
    ((20, 265, 1400, 296), [(205, 312, 141, 119), (521, 310, 149, 122), (753, 317, 61, 134), (919, 344, 149, 90), (1169, 312, 103, 110)], (753, 317, 61, 134, -1)),
    ((0, 0, 1000, 500), [(110, 285, 110, 120), (300, 290, 110, 120), (470, 292, 110, 118), (650, 289, 110, 120), (820, 286, 110, 119)], None),
])
def test_promoted_door(spark, facade, boxes, want):
    got = [(r["x"], r["y"], r["w"], r["h"], r["second_id"]) for r in O.promoted_doors(*frames(spark, facade, boxes)).collect()]
    assert got == ([want] if want else [])


def test_fragments(spark):
    boxes = [(205, 150, 141, 119), (521, 150, 65, 119), (586, 203, 84, 69), (753, 155, 61, 134), (919, 184, 149, 90), (1169, 152, 103, 110)]
    _, w = frames(spark, (0, 0, 1400, 500), boxes)
    got = {(r["x"], r["y"], r["w"], r["h"]) for r in O.merged_fragments(w.withColumns({"fy": F.lit(0), "fw": F.lit(1000), "fh": F.lit(500)})).collect()}
    assert len(got) == 5 and (521, 150, 149, 122) in got


@pytest.mark.parametrize("door,left,right,want", [
    ((626, 588, 101, 225), (439, 543, 82, 128), (642, 543, 44, 126), (522, 588, 119, 225)),
    ((1262, 544, 122, 200), (833, 541, 182, 128), (1475, 403, 181, 134), (1213, 544, 134, 200)),
    ((10, 10, 20, 20), (0, 0, 10, 10), (20, 0, 10, 10), None),
])
def test_gap_fit(spark, door, left, right, want):
    box = lambda b: Box(*(F.lit(v) for v in b))
    row = spark.range(1).select(O.fitted_door(box((131, 155, 2230, 658)), box(door), box(left), box(right)).alias("d")).first()["d"]
    assert (tuple(row) if row else None) == want


def iou(a, b):
    w = max(min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), 0)
    h = max(min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]), 0)
    return w * h, w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


def test_suppression_and_greedy_against_loops(spark):
    rng = random.Random(2)
    rows = [(g, g * 100 + i, rng.randrange(80), rng.randrange(80), rng.randrange(5, 60), rng.randrange(5, 60)) for g in range(30) for i in range(rng.randrange(1, 15))]
    frame = spark.createDataFrame(rows, "image_id long, region_id long, x long, y long, w long, h long")
    want = set()
    for g in range(30):
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[4] * r[5], r[1])):
            boxes = [(iou(r[2:], k[2:]), k) for k in kept]
            if all(i == 0 or (v <= 0.30 and i / min(r[4] * r[5], k[4] * k[5]) < 0.72) for (i, v), k in boxes):
                kept.append(r)
        want |= {r[1] for r in kept}
    assert {r["region_id"] for r in M.suppress(frame, "image_id").collect()} == want

    pairs = [(g, l, r, rng.randrange(20)) for g in range(20) for l in range(6) for r in range(6) if rng.random() < 0.6]
    frame = spark.createDataFrame(pairs, "g long, l long, r long, d long")
    got = {tuple(r) for r in M.greedy_pairs(frame, "g", "l", "r", [F.col("d")]).collect()}
    want = set()
    for g in range(20):
        used_l, used_r = set(), set()
        for _, l, r in sorted((d, l, r) for k, l, r, d in pairs if k == g):
            if l not in used_l and r not in used_r:
                used_l.add(l), used_r.add(r), want.add((g, l, r))
    assert got == want


def test_median_rows(spark):
    ys = [0, 5, 12, 30, 44, 45, 46, 90]
    frame = spark.createDataFrame([(1, i, y, 100) for i, y in enumerate(ys)], "facade_id long, region_id long, y long, fh long")
    got = {r["region_id"]: r["row"] for r in O.median_rows(frame).collect()}
    want, row, n = {}, [], 0
    for i, y in enumerate(ys):
        middle = (row[(len(row) - 1) // 2] + row[len(row) // 2]) / 2 if row else None
        if row and abs(y - middle) <= 14:
            row.append(y)
        else:
            row, n = [y], n + 1
        want[i] = n
    assert got == want


def test_empty_inputs(spark):
    f, w = frames(spark, (0, 0, 10, 10), [(0, 0, 1, 1)])
    assert O.promoted_doors(f, w.limit(0)).count() == 0
    assert O.central_cluster(f.limit(0), w.withColumn("kind", F.lit("door"))).count() == 0
    assert M.suppress(w.withColumnRenamed("facade_id", "image_id").limit(0), "image_id").count() == 0
