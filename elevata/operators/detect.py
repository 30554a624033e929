"""Regions of images: one Python stage over image rows, pixels read once.

Rows come as Spark's image source gives them (BGR bytes). The stage emits
small region rows; the bytes are dropped before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .. import config
from . import kernels as K
from . import lines as L
from . import refine as R

REGIONS = T.StructType([
    T.StructField("image_id", T.StringType()), T.StructField("region_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("label", T.StringType()),
    *(T.StructField(c, T.LongType()) for c in ("x", "y", "w", "h", "area_px")), T.StructField("origin", T.StringType()), T.StructField("error", T.StringType()),
])


def _boxes(mask: np.ndarray, least: float, most: float) -> list[tuple[int, int, int, int, int]]:
    _, stats = K.label(mask)
    return [tuple(int(v) for v in s) for s in stats if least <= s[4] and s[2] * s[3] <= most]


def marked_facades(bgr: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Filled facades in the marking colours."""
    area = bgr.shape[0] * bgr.shape[1]
    mask = K.dilate(K.opened(K.closed(K.colour_mask(bgr, "facade"), 9), 5), 3, 2)
    mask = K.filled(mask)
    found = _boxes(mask, max(config.MIN_FACADE_AREA_PX, 0.015 * area), 0.90 * area)
    return [b for b in found if b[2] >= 150 and b[3] >= 70 and 0.35 <= b[2] / b[3] <= 8 and b[4] / (b[2] * b[3]) >= 0.08]


def marked_windows(bgr: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    area = bgr.shape[0] * bgr.shape[1]
    found = _boxes(K.filled(K.closed(K.colour_mask(bgr, "window"), 5)), config.MIN_WINDOW_AREA_PX, 0.15 * area)
    return [b for b in found if min(b[2], b[3]) >= 15 and 0.25 <= b[2] / b[3] <= 5.5 and b[4] / (b[2] * b[3]) >= 0.25]


def marked_doors(bgr: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    area = bgr.shape[0] * bgr.shape[1]
    found = _boxes(K.filled(K.closed(K.colour_mask(bgr, "door"), 5)), config.MIN_DOOR_AREA_PX, 0.20 * area)
    return [b for b in found if b[2] >= 12 and b[3] >= 18 and b[2] / b[3] >= 0.08 and b[4] / (b[2] * b[3]) >= 0.15]


def photo_facade(bgr: np.ndarray) -> tuple[int, int, int, int, int] | None:
    """The wall of a photograph or extracted elevation, from the foreground
    against the border's level: the largest component, begun at the first row
    that is nearly full, and cut to the columns that carry it."""
    g = K.gray(bgr)
    height, width = g.shape
    level = K.border_percentile(g, 65.0)
    mask = K.filled(K.largest(K.closed(K.opened(g < level - 10.0, 3), 5)))
    if mask.sum() < 0.08 * g.size:
        return None
    rows = mask.mean(axis=1)
    full = np.flatnonzero(rows >= max(0.78 * rows.max(), 0.74 * rows[rows > 0].mean()))
    used = np.flatnonzero(mask.any(axis=1))
    top = int(full[0]) if len(full) and full[0] <= used[0] + 0.72 * (used[-1] - used[0]) else int(used[0])
    body = mask[top: used[-1] + 1]
    columns = np.flatnonzero(body.mean(axis=0) >= 0.08)
    if not len(columns) or len(body) < 0.20 * height:
        return None
    x, w, h = int(columns[0]), int(columns[-1] - columns[0] + 1), len(body)
    return x, top, w, h, int(body[:, x: x + w].sum())


def photo_openings(bgr: np.ndarray, facade: tuple[int, int, int, int, int]) -> list[tuple[int, int, int, int, int]]:
    """Dark and structured boxes inside a facade of a photograph."""
    fx, fy, fw, fh, _ = facade
    g = K.gray(bgr)[fy: fy + fh, fx: fx + fw]
    local = K.gaussian(g, max(2.0, fw * 0.05), max(2.0, fh * 0.05))
    mask = K.opened(K.closed((g < local - 14) | (g < np.percentile(g, 12)), 5), 3)
    out = []
    for x, y, w, h, n in _boxes(K.filled(mask), 0.0015 * fw * fh, 0.25 * fw * fh):
        wide = w >= fw * 0.02 and (w >= fw * 0.035 or h >= fh * 0.16)
        placed = 0.12 <= (y + h / 2) / fh <= 0.92
        if wide and placed and 0.22 <= w / h <= 4.5 and n / (w * h) >= 0.45:
            patch = g[y: y + h, x: x + w]
            if patch.mean() <= 185 or patch.std() >= 24:
                out.append((x + fx, y + fy, w, h, n))
    return out


def dark_background(bgr: np.ndarray) -> bool:
    return K.border_percentile(K.gray(bgr), 80.0) <= 25.0


def inferred_facades(boxes: list[R.Box], height: int, width: int) -> list[R.Box]:
    """Facades around openings where none was found: rows by the running mean
    of centre heights, cut at wide gaps, with margins; unions of those that
    overlap."""
    near, gap = max(60, height // 14), max(140, width // 7)
    side, above, below = max(70, width // 30), max(110, height // 8), max(80, height // 12)
    centre = lambda b: (b[0] + b[2] // 2, b[1] + b[3] // 2)
    rows: list[list[R.Box]] = []
    for b in sorted(boxes, key=lambda b: centre(b)[::-1]):
        mean = lambda row: int(sum(centre(x)[1] for x in row) / len(row))
        row = next((r for r in rows if abs(centre(b)[1] - mean(r)) <= near), None)
        if row is None:
            rows.append([b])
        else:
            row.append(b)
    out: list[list[int]] = []
    for row in rows:
        row.sort(key=lambda b: centre(b)[0])
        cuts = [i for i in range(1, len(row)) if centre(row[i])[0] - centre(row[i - 1])[0] > gap]
        for i, j in zip([0, *cuts], [*cuts, len(row)], strict=True):
            part = row[i:j]
            x, y = max(0, min(b[0] for b in part) - side), max(0, min(b[1] for b in part) - above)
            right, bottom = min(width, max(b[0] + b[2] for b in part) + side), min(height, max(b[1] + b[3] for b in part) + below)
            if right - x >= 120 and bottom - y >= 90:
                out.append([x, y, right, bottom])
    merged: list[list[int]] = []
    for f in sorted(out, key=lambda f: (f[1], f[0])):
        for k in [k for k in merged if min(f[2], k[2]) > max(f[0], k[0]) and min(f[3], k[3]) > max(f[1], k[1])]:
            merged.remove(k)
            f = [min(f[0], k[0]), min(f[1], k[1]), max(f[2], k[2]), max(f[3], k[3])]
        merged.append(f)
    return [(x, y, right - x, bottom - y) for x, y, right, bottom in merged]


def marked_up(bgr: np.ndarray) -> list[tuple[str, str, tuple[int, int, int, int, int]]]:
    """Facades outlined by a red pen, and the windows outlined in yellow that
    lie and are sized plausibly in theirs; none without such a facade."""
    found = L.markup(bgr)
    walls = [b for kind, b in found if kind == "facade"]
    out = [("facade", "markup", (*b, b[2] * b[3])) for b in walls]
    for x, y, w, h in (b for kind, b in found if kind == "window" and walls):
        cx, cy = x + w // 2, y + h // 2
        far = lambda f: (not (f[0] <= cx <= f[0] + f[2] and f[1] <= cy <= f[1] + f[3]), (cx - f[0] - f[2] / 2) ** 2 + (cy - f[1] - f[3] / 2) ** 2)  # noqa: B023, E731
        f = min(walls, key=far)
        if cy <= f[1] + f[3] * 0.72 and 0.006 <= w * h / (f[2] * f[3]) <= 0.30:
            out.append(("window", "markup", (x, y, w, h, w * h)))
    return out


def photographed(bgr: np.ndarray) -> list[tuple[str, str, tuple[int, int, int, int, int]]]:
    """The wall of a photograph with its openings; by colour where the border's
    level doesn't tell it from the ground."""
    facade = photo_facade(bgr)
    if facade is None:
        mask = R.segmented_facade(bgr)
        if mask is None or mask.mean() > 0.85:
            return []
        mask = R.side_trimmed(mask)
        rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        box = (int(columns[0]), int(rows[0]), int(np.ptp(columns)) + 1, int(np.ptp(rows)) + 1)
        if box[3] < 0.20 * bgr.shape[0]:
            return []
        facade = (*box, int(mask.sum()))
    out = [("facade", "photo", facade)]
    _, fy, fw, fh, _ = facade
    g, wall = K.gray(bgr), facade[:4]
    boxes = [b[:4] for b in photo_openings(bgr, facade)]
    boxes = R.distinct(boxes + R.windows_by_contrast(g, wall) + R.windows_by_gradient(g, wall))
    boxes = R.distinct(boxes + R.gap_doors(boxes, wall, g))
    is_door = lambda b: (b[1] + b[3] - fy) / fh >= 0.72 and 0.20 <= b[3] / fh <= 0.82 and 0.28 <= b[2] / b[3] <= 1.25 and 0.04 <= b[2] / fw <= 0.28
    doors = R.distinct([R.door_by_jambs(g, b) for b in boxes if is_door(b)])
    windows = [part for b in boxes if not is_door(b) for part in (R.split_wide(g, b) if b[2] > 0.35 * fw else [b])]
    # What is found beside a door is a window of its own where nothing else is.
    for door in doors:
        for light in R.sidelights(g, door, wall):
            if len(R.distinct([light, *windows, *doors])) == len(windows) + len(doors) + 1:
                windows.append(light)
    return out + [(kind, "photo", (*b, b[2] * b[3])) for kind, bs in (("window", windows), ("door", doors)) for b in bs]


def detect_all(bgr: np.ndarray) -> list[tuple[str, str, tuple[int, int, int, int, int]]]:
    """Kind, origin and box of all regions. Facades outlined by hand come
    first; then filled ones in marking colours; without any (or with a tiny
    one), or where windows on a dark ground have no door, the photograph rules;
    facades around marked openings where nothing else gives one."""
    if marked := marked_up(bgr):
        return marked
    height, width = bgr.shape[:2]
    facades, windows, doors = marked_facades(bgr), marked_windows(bgr), marked_doors(bgr)
    if facades and max(b[4] for b in facades) < 0.02 * height * width:
        facades = []
    if not facades:
        if photo := photographed(bgr):
            return photo
    elif not doors and len(windows) >= 4 and dark_background(bgr):
        photo = photographed(bgr)
        if any(kind == "door" for kind, _, _ in photo):
            return photo
    out = [("facade", "color", b) for b in facades]
    if not facades:
        out = [("facade", "inferred", (*b, b[2] * b[3])) for b in inferred_facades([b[:4] for b in windows + doors], height, width)]
    return out + [("window", "color", b) for b in windows] + [("door", "color", b) for b in doors]


def bgr_of(row: dict) -> np.ndarray | None:
    """The pixels of an image row; null where it could not be decoded."""
    height, width, channels = row["height"], row["width"], row["nChannels"]
    if height is None or height <= 0 or width <= 0:
        return None
    bgr = np.frombuffer(row["data"], np.uint8).reshape(height, width, channels)[..., :3]
    return np.repeat(bgr, 3, axis=2) if bgr.shape[2] == 1 else bgr


def image_levels(images: DataFrame) -> DataFrame:
    """image_id (the stem), width, height and grey level of the border (its
    70th percentile) of the images that can be read."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(row["stem"], bgr_of(row)) for row in batch.to_dict("records")]
            found = [(stem, bgr.shape[1], bgr.shape[0], float(K.border_percentile(K.gray(bgr), 70.0))) for stem, bgr in rows if bgr is not None]
            yield pd.DataFrame(found, columns=["image_id", "width", "height", "white_level"])

    return images.select("stem", "height", "width", "nChannels", "data").mapInPandas(run, "image_id string, width int, height int, white_level double")


STEM = {"facade": "FATADA_", "window": "F_", "door": "U_"}


def detected_regions(images: DataFrame) -> DataFrame:
    """Region rows of all images (``origin``, ``height``, ``width``,
    ``nChannels``, ``data``). An image that cannot be read gives one row with
    ``error``, so no image is lost silently."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for name, height, width, channels, data in zip(batch["origin"], batch["height"], batch["width"], batch["nChannels"], batch["data"], strict=True):
                try:
                    if height <= 0 or width <= 0:
                        raise ValueError("cannot be decoded")
                    bgr = np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., :3]
                    bgr = np.repeat(bgr, 3, axis=2) if bgr.shape[2] == 1 else bgr
                    number = dict.fromkeys(STEM, 0)
                    found = sorted(detect_all(bgr), key=lambda r: (list(STEM).index(r[0]), r[2][1], r[2][0], r[2]))
                    for i, (kind, how, (x, y, w, h, n)) in enumerate(found):
                        number[kind] += 1
                        rows.append((name, i + 1, kind, f"{STEM[kind]}{number[kind]}", x, y, w, h, n, how, None))
                except ValueError as e:
                    rows.append((name, 0, None, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=REGIONS.fieldNames()).astype({c: "Int64" for c in ("region_id", "x", "y", "w", "h", "area_px")})

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, REGIONS)
