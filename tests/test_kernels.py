from collections import deque

import numpy as np
import pytest

from elevata.operators import kernels as K
from elevata.operators.detect import detect_all, detected_regions, inferred_facades
from elevata.sinks.documents import png


def bgr_of(h, s, v):
    """Colour whose hue, saturation and value are given."""
    c = v * s / 255
    x = c * (1 - abs(h / 30 % 2 - 1))
    r, g, b = [(c, x, 0), (x, c, 0), (0, c, x), (0, x, c), (x, 0, c), (c, 0, x)][int(h // 30) % 6]
    return [round(q + v - c) for q in (b, g, r)]


def elevation():
    image = np.full((300, 400, 3), 200, np.uint8)
    image[40:261, 40:361] = bgr_of(90, 150, 200)
    image[110:191, 140:261] = bgr_of(25, 200, 230)
    image[200:256, 300:330] = bgr_of(12, 200, 230)
    return image


def photograph():
    rng = np.random.default_rng(0)
    image = np.full((400, 800, 3), 250, np.uint8)
    image[120:380, 60:740] = 150 + rng.integers(-4, 5, (260, 680, 1))
    for x in (140, 300, 560):
        image[180:260, x: x + 70] = 60
    image[230:375, 430:500] = 50
    return image


def flood(mask):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not out[y, x]:
            n += 1
            todo = deque([(y, x)])
            out[y, x] = n
            while todo:
                a, b = todo.popleft()
                for c in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                    for d in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                        if mask[c, d] and not out[c, d]:
                            out[c, d] = n
                            todo.append((c, d))
    return out, n


def test_labels_against_flood_fill():
    rng = np.random.default_rng(1)
    for density in (0.0, 0.2, 0.45, 0.8, 1.0):
        mask = rng.random((23, 31)) < density
        marks, stats = K.label(mask)
        want, n = flood(mask)
        assert len(stats) == n and sorted(stats[:, 4]) == sorted(np.bincount(want.ravel())[1:])
        assert len({(a, b) for a, b in zip(marks.ravel(), want.ravel(), strict=True)}) == len(np.unique(want))
        for i, (x, y, w, h, _) in enumerate(stats):
            at = np.argwhere(marks == i + 1)
            assert (at.min(axis=0) == (y, x)).all() and (at.max(axis=0) == (y + h - 1, x + w - 1)).all()


def test_morphology():
    mask = np.zeros((9, 9), bool)
    mask[4, 4] = True
    assert K.dilate(mask, 3).sum() == 9 and K.erode(K.dilate(mask, 3), 3).sum() == 1
    ring = K.dilate(mask, 5) & ~K.dilate(mask, 3)
    assert K.filled(ring).sum() == 25 and K.without_small(ring | mask, 2).sum() == 16
    assert K.touching(ring | mask, mask).sum() == 1 and K.largest(ring | mask).sum() == 16


def test_profiles_and_lines():
    mask = np.zeros((6, 5), bool)
    mask[2:4, 1] = mask[1:6, 3] = True
    top, bottom = K.profiles(mask)
    assert top.tolist() == [-1, 2, -1, 1, -1] and bottom.tolist() == [-1, 3, -1, 5, -1]
    assert K.interpolated(top).tolist() == [2, 2, 1.5, 1, 1]
    line = np.array([(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 10)])
    assert K.simplified(line, 0.1).tolist() == [[0, 0], [2, 0], [4, 10]]
    assert {tuple(p) for p in K.hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)])} == {(0, 0), (2, 0), (2, 2), (0, 2)}


def test_polygons():
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert K.polygon_area(square) == 100 and K.polygon_mask(square, 20, 20).sum() == 121
    assert K.polygon_iou(square, square) == 1
    assert K.polygon_iou(square, [(5, 0), (15, 0), (15, 10), (5, 10)]) == pytest.approx(1 / 3, abs=0.01)


def test_colours():
    colours = [(90, 150, 200), (25, 200, 230), (0, 0, 77), (140, 99, 180)]
    got = K.hsv(np.array([[bgr_of(*c) for c in colours]], np.uint8))[0]
    assert (np.abs(got.astype(int) - np.array(colours)) <= 2).all()
    assert K.gray(np.array([[[0, 0, 255], [255, 255, 255]]], np.uint8)).tolist() == [[76, 255]]


def test_marked_elevation():
    found = {kind: box for kind, _, box in detect_all(elevation())}
    for kind, want in (("facade", (40, 40, 321, 221)), ("window", (140, 110, 121, 81)), ("door", (300, 200, 30, 56))):
        assert np.abs(np.array(found[kind][:4]) - want).max() <= 5, kind


def test_photograph():
    found = detect_all(photograph())
    facade = next(b for k, _, b in found if k == "facade")
    assert np.abs(np.array(facade[:4]) - (60, 120, 680, 260)).max() <= 4
    assert sum(k == "window" for k, *_ in found) == 3 and sum(k == "door" for k, *_ in found) == 1


def outlined(image, colour, box, pen=4):
    x, y, w, h = box
    for part in (np.s_[y: y + pen, x: x + w], np.s_[y + h - pen: y + h, x: x + w], np.s_[y: y + h, x: x + pen], np.s_[y: y + h, x + w - pen: x + w]):
        image[part] = colour


def test_markup_comes_first():
    image = elevation(), np.full((500, 800, 3), 200, np.uint8)
    for boxes in ([(150, 120, 80, 60), (400, 130, 90, 70)], []):
        drawn = image[1].copy()
        outlined(drawn, bgr_of(0, 220, 220), (100, 50, 600, 400))
        for b in [*boxes, (300, 380, 70, 50)]:  # the last one stands too low
            outlined(drawn, bgr_of(25, 200, 230), b)
        found = detect_all(drawn)
        assert {how for _, how, _ in found} == {"markup"}
        assert [k for k, *_ in found] == ["facade"] + ["window"] * len(boxes)
        for (_, _, got), want in zip(found, [(100, 50, 600, 400), *boxes], strict=True):
            assert np.abs(np.array(got[:4]) - want).max() <= 6


def test_facades_around_openings():
    image = np.full((600, 1000, 3), 200, np.uint8)
    for x, y in ((100, 150), (200, 155), (320, 150), (800, 400)):
        image[y: y + 50, x: x + 60] = bgr_of(25, 200, 230)
    found = detect_all(image)
    assert [(k, how) for k, how, _ in found if k == "facade"] == [("facade", "inferred")] * 2 and sum(k == "window" for k, *_ in found) == 4
    assert inferred_facades([(100, 150, 60, 50), (200, 155, 60, 50), (800, 400, 60, 50)], 600, 1000) == [(30, 40, 300, 245), (730, 290, 200, 240)]
    assert inferred_facades([], 600, 1000) == [] and detect_all(np.full((200, 200, 3), 120, np.uint8)) == []


def test_opening_evidence():
    wall = np.full((120, 160), 225, np.uint8)
    hole = wall.copy()
    hole[30:90, 40:100] = 60
    hole[58:62, 40:100] = 200
    assert K.opening_evidence(hole, (40, 30, 60, 60))["support"] > 0.5 > 0.1 > K.opening_evidence(wall, (40, 30, 60, 60))["support"]
    assert K.opening_evidence(wall, (500, 500, 5, 5))["support"] == 0


def test_laplacian():
    assert K.laplacian_variance(np.full((20, 20), 9.0)) == 0 < K.laplacian_variance(np.random.default_rng(0).random((20, 20)))


def test_k_means_repeats():
    x = np.concatenate([np.zeros((20, 3)), np.full((20, 3), 50), np.full((20, 3), 200)])
    near = K.k_means(x, 3)
    assert len({*near[:20]}) == len({*near[20:40]}) == len({*near[40:]}) == 1 and len({*near}) == 3


def test_stage(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(elevation()))
    (tmp_path / "b.png").write_bytes(png(photograph()))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    images = spark.read.format("image").load(str(tmp_path)).select("image.*")
    rows = detected_regions(images).collect()
    by = {}
    for r in rows:
        by.setdefault(r["image_id"].rpartition("/")[2], []).append((r["kind"], r["origin"], r["error"]))
    assert len(by["a.png"]) == 3 and {o for _, o, _ in by["a.png"]} == {"color"}
    assert len(by["b.png"]) == 5 and by["bad.png"] == [(None, None, "cannot be decoded")]
