import numpy as np
import pytest

from elevata.operators import geometry as G
from elevata.operators import kernels as K
from elevata.operators import refine as R
from elevata.sinks.documents import png


def wall(height=240, width=400):
    rng = np.random.default_rng(0)
    return (190 + rng.integers(-3, 4, (height, width))).astype(np.uint8)


def test_socle_and_lines():
    image = wall()
    image[200:] = 120
    mask = np.ones(image.shape, bool)
    assert abs(G.socle_cut(image, mask) - 200) <= 2
    assert G.socle_cut(wall(), mask) is None
    assert G.band_between(mask, np.full(400, 200)).sum() == 40 * 400
    line = G.edge_line(np.where(np.arange(100) % 17 == 0, -1, 50 + np.arange(100) // 20))
    assert abs(line[0] - 49.5) < 1 and abs(line[-1] - 54.5) < 1
    assert np.ptp(G.edge_line(np.arange(100) * 3)) <= 0.12 * 99 + 1e-9


def test_profile_statistics():
    roof = np.zeros((200, 200), bool)
    for x in range(200):
        roof[100 - min(x, 199 - x):, x] = True
    s = G.profile_statistics(roof)
    assert s["n_columns"] == 200 and s["gable_peak"] > 50 and s["top_span"] > 80
    assert G.profile_statistics(np.zeros((9, 9), bool))["n_columns"] == 0


def test_windows_and_doors():
    g = wall()
    facade = (0, 0, 400, 240)
    for x in (60, 180, 300):
        g[70:130, x: x + 50] = 90
        g[98:102, x: x + 50] = 180
    for found in (R.windows_by_gradient(g, facade), R.windows_by_contrast(g, facade)):
        assert len(found) == 3 and all(np.abs(np.array(b) - (x, 70, 50, 60)).max() <= 8 for b, x in zip(sorted(found), (60, 180, 300), strict=True))
    door = wall()
    door[100:220, 150:200] = 60
    assert np.abs(np.array(R.door_by_jambs(door, (144, 100, 62, 110))) - (150, 100, 50, 120)).max() <= 4
    assert R.door_by_jambs(np.full((240, 400), 190, np.uint8), (144, 100, 62, 110)) == (144, 100, 62, 110)
    door[110:205, 128:146] = 70
    assert len(R.sidelights(door, (150, 100, 50, 120), facade)) == 1
    pair = wall()
    pair[60:120, 100:200] = 80
    pair[60:120, 145:152] = 200
    assert [b[2] > 35 for b in R.split_wide(pair, (100, 60, 100, 60))] == [True, True]
    gaps = wall()
    gaps[100:200, 180:220] = 60
    assert len(R.gap_doors([(100, 120, 60, 70), (240, 120, 60, 70)], facade, gaps)) == 1
    assert R.joined_parts([(0, 0, 10, 10), (10, 1, 10, 10), (60, 0, 5, 5)]) == [(0, 0, 20, 11), (60, 0, 5, 5)]
    assert R.distinct([(0, 0, 10, 10), (1, 1, 8, 8), (30, 0, 5, 5)]) == [(0, 0, 10, 10), (30, 0, 5, 5)]


def test_bodies():
    mask = np.zeros((100, 200), bool)
    mask[20:90, 20:180] = True
    mask[80:90, :] = True
    assert R.side_trimmed(mask)[:, :20].sum() == 0 and R.side_trimmed(mask).sum() == 70 * 160
    tower = np.zeros_like(mask)
    tower[2:22, 60:100] = True
    assert R.merged_bodies(mask, tower)[2:22, 62:98].all()
    image = np.full((100, 200, 3), 240, np.uint8)
    image[30:, 20:180] = (90, 120, 160)
    found = R.segmented_facade(image)
    assert abs(int(found.sum()) - 70 * 160) < 300


def test_processed_drawing():
    image = np.full((200, 300, 3), 255, np.uint8)
    image[20:180, 20:280] = R.PALETTES["facade"]
    image[50:90, 60:110] = R.PALETTES["window"]
    image[160:180, 20:280] = R.PALETTES["socle"]
    found = dict(R.processed_regions(image))
    assert found["window"] == (60, 50, 50, 40) and found["socle"] == (20, 160, 260, 20)
    assert np.abs(np.array(found["facade"]) - (20, 20, 260, 140)).max() <= 2
    outline = R.contour_of(K.palette_mask(image, R.PALETTES["window"]))
    assert K.polygon_iou(outline, [(60, 50), (109, 50), (109, 89), (60, 89)]) == pytest.approx(1, abs=0.02)


def test_geometry_stage(spark, tmp_path):
    image = np.full((300, 500, 3), 250, np.uint8)
    image[80:280, 50:450] = wall(200, 400)[..., None]
    image[240:280, 50:450] = 110
    (tmp_path / "a.png").write_bytes(png(image))
    (tmp_path / "blank.png").write_bytes(png(np.full((50, 50, 3), 255, np.uint8)))
    rows = G.facade_geometry(spark.read.format("image").load(str(tmp_path)).select("image.*")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert abs(r["socle_px"] - 40 * 400) <= 2000 and abs(r["socle_y"] - 240) <= 3 and abs(r["facade_px"] - 160 * 400) <= 2500


def test_new_boxes_and_origins(spark):
    from pyspark.sql import functions as F

    from elevata.functions.boxes import Box
    from elevata.operators import openings as O

    regions = spark.createDataFrame([(1, 0, 0, 10, 10, 100, "abc")], "region_id long, x long, y long, w long, h long, area_px long, contour string")
    row = O.with_box(regions, Box(F.col("x") + 1, F.col("x") + 2, F.col("w") * 2, F.col("w"))).first()
    assert tuple(row) == (1, 1, 2, 20, 10, 200, None)
    origins = spark.createDataFrame([("photo-window",), ("WINDOW photo",), ("photo",), ("color-window",), (None,)], "o string")
    assert [r[0] for r in origins.select(O.photo_window(F.col("o"))).collect()] == [True, True, False, False, False]
    rows = spark.createDataFrame([(1, 1, True, True, False), (1, 2, True, False, True), (2, 3, False, True, True), (2, 4, True, False, False), (3, 5, True, None, None), (3, 6, True, True, None)], "image_id long, region_id long, photo boolean, invalid boolean, bright boolean")
    assert sorted(r["region_id"] for r in O.photo_validated(rows).collect()) == [1, 2, 3, 4, 5]  # of image 1 all would go
    levels = spark.createDataFrame([(210.0, 10.0, 900), (210.0, 50.0, 900), (150.0, 5.0, 900), (250.0, 0.0, 20)], "m double, s double, n long")
    assert [r[0] for r in levels.select(O.bright_wall(F.col("m"), F.col("s"), F.col("n"))).collect()] == [True, False, False, False]


def test_scenario_texts_and_references(spark):
    import json

    from elevata.operators import metrics as M
    from elevata.operators import validate as V

    scores = spark.createDataFrame([("a", 2, 0.5, 1.0), ("a", 1, 0.25, None), ("b", 3, 1.0, 0.0)], "scenario string, sample_id long, f1 double, recall double")
    got = {r["scenario"]: json.loads(r["json"]) for r in M.scenario_json(scores, "scenario").collect()}
    assert got["a"] == {"scenario": "a", "n": 2, "means": {"f1": 0.375, "recall": 1.0}, "samples": [{"sample_id": 1, "f1": 0.25}, {"sample_id": 2, "f1": 0.5, "recall": 1.0}]}
    refs = [(1, 1, "linear", 2.0, 100.0, None, None, None, None, None), (1, 2, "linear", 0.0, 100.0, None, 0, 0, 5, 5), (1, 3, "linear_from_ocr", None, None, None, 95, 0, 10, 5), (1, 4, "linear_from_ocr", None, None, 3.0, 0, 0, 0, 5), (1, 5, "other", None, None, None, None, None, None, None)]
    frame = spark.createDataFrame(refs, "file_id long, ref_id long, type string, ref_m double, ref_px double, value_m double, x long, y long, w long, h long")
    images = spark.createDataFrame([(1, 100, 50)], "file_id long, width int, height int")
    got = sorted((r["ref_id"], r["rule"]) for r in V.scale_reference_errors(frame, images).collect())
    assert got == [(2, "not_positive"), (3, "not_positive"), (3, "outside_image"), (4, "outside_image")]
