"""A folder of drawn elevations, from pixels to workbooks."""

import zipfile

import numpy as np
import pytest

from elevata.job import analyse_folder
from elevata.sinks.documents import png


def bgr(hsv):
    """A marking colour (H 0-180) as blue, green, red."""
    h, s, v = hsv[0] * 2, hsv[1] / 255, hsv[2]
    c, m = v * s, v - v * s
    x = c * (1 - abs(h / 60 % 2 - 1))
    r, g, b = [(c, x, 0), (x, c, 0), (0, c, x), (0, x, c), (x, 0, c), (c, 0, x)][int(h // 60)]
    return [round(b + m), round(g + m), round(r + m)]


def drawn(width, height, boxes):
    image = np.full((height, width, 3), 200, np.uint8)
    for hsv, (x0, y0, x1, y1) in boxes:
        image[y0: y1 + 1, x0: x1 + 1] = bgr(hsv)
    return image


CYAN, YELLOW = (90, 150, 200), (25, 200, 230)


def test_folder(spark, tmp_path):
    for owner, size in (("one", "0.01"), ("two", "0.02")):
        (tmp_path / "in" / owner).mkdir(parents=True)
        (tmp_path / "in" / owner / "Fatada.png").write_bytes(png(drawn(400, 300, [(CYAN, (40, 40, 360, 260)), (YELLOW, (140, 110, 260, 190))])))
        (tmp_path / "in" / owner / "Fatada.pgw").write_text(f"{size}\n0\n0\n-{size}\n5\n6")
    (tmp_path / "in" / "one" / "broken.png").write_bytes(b"no image")
    texts = [("one/fatada", 1, "Fatada principala", 0.9, 150, 60, 90, 15), ("one/fatada", 2, "F1", 0.9, 190, 140, 20, 10)]
    tokens = spark.createDataFrame(texts, "image_id string, token_id long, text string, confidence double, x long, y long, w long, h long")
    out = f"file://{tmp_path}/out"
    done, failed = analyse_folder(spark, str(tmp_path / "in"), tokens, out)
    assert [r["image_id"] for r in failed.collect()] == ["one/broken"]
    got = {r["image_id"]: r for r in done.facades.collect()}
    assert set(got) == {"one/fatada", "two/fatada"} and got["one/fatada"]["name"] == "Fatada principala" and got["two/fatada"]["name"] == "Fatada 1"
    for name, px in (("one/fatada", 100.0), ("two/fatada", 50.0)):
        r = got[name]
        assert (r["x"], r["y"], r["w"], r["h"]) == (pytest.approx(40, abs=3), pytest.approx(40, abs=3), pytest.approx(321, abs=6), pytest.approx(221, abs=6))
        assert r["total_m2"] == pytest.approx(r["w"] * r["h"] / px**2, rel=0.02) and r["n_windows"] == 1
        assert r["windows_m2"] == pytest.approx(121 * 81 / px**2, rel=0.1) and r["net_m2"] == pytest.approx(r["total_m2"] - r["windows_m2"])
        assert r["corner_m"] == pytest.approx(2 * r["h"] / px, abs=1e-3) and r["socle_drip_m"] == pytest.approx(r["w"] / px, abs=1e-3)
    assert {(r["image_id"], r["element_id"], r["label"]) for r in done.elements.select("image_id", "element_id", "label").collect() if r["image_id"] == "one/fatada"} == {("one/fatada", "t2", "F1")}
    assert {r["source"] for r in done.scales.collect()} == {"manual_ref"}
    books = sorted(p.name for p in (tmp_path / "out" / "workbooks").iterdir() if not p.name.startswith("."))
    assert books == ["quantities-one%2Ffatada.xlsx", "quantities-two%2Ffatada.xlsx"] and zipfile.is_zipfile(tmp_path / "out" / "workbooks" / books[0])
    pages = sorted(p.name for p in (tmp_path / "out" / "pages").iterdir() if not p.name.startswith("."))
    assert pages == ["one%2Ffatada.pdf", "one%2Ffatada.png", "two%2Ffatada.pdf", "two%2Ffatada.png"]
    assert (tmp_path / "out" / "pages" / pages[0]).read_bytes().startswith(b"%PDF")
