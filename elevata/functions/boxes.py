"""Bounding boxes as groups of columns, and what is measured on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Top-left corner and size in pixels."""

    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "", struct: Column | None = None) -> Box:
        """From columns ``{prefix}x`` ... or from the fields of a struct."""
        if struct is not None:
            return cls(*(struct.getField(c) for c in "xywh"))
        return cls(*(F.col(prefix + c) for c in "xywh"))

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def cx(self) -> Column:
        """Centre, with halves."""
        return self.x + self.w * 0.5

    @property
    def cy(self) -> Column:
        return self.y + self.h * 0.5

    @property
    def ix(self) -> Column:
        """Centre in whole pixels."""
        return self.x + F.floor(self.w / 2)

    @property
    def iy(self) -> Column:
        return self.y + F.floor(self.h / 2)

    def holds(self, px: Column, py: Column, slack: Column | float = 0) -> Column:
        """Whether a point lies inside, edges included."""
        return px.between(self.x - slack, self.right + slack) & py.between(self.y - slack, self.bottom + slack)

    def distance(self, px: Column, py: Column) -> Column:
        """From a point outside to the nearest edge; 0 inside."""
        dx = F.greatest(self.x - px, px - self.right, F.lit(0))
        dy = F.greatest(self.y - py, py - self.bottom, F.lit(0))
        return F.sqrt((dx * dx + dy * dy).cast("double"))


def overlap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a.right, b.right) - F.greatest(a.x, b.x), F.lit(0))


def overlap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y), F.lit(0))


def gap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.greatest(a.x, b.x) - F.least(a.right, b.right), F.lit(0))


def gap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.greatest(a.y, b.y) - F.least(a.bottom, b.bottom), F.lit(0))


def intersection(a: Box, b: Box) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where both are empty."""
    both = intersection(a, b)
    union = a.area + b.area - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def centre_distance(a: Box, b: Box) -> Column:
    dx, dy = a.cx - b.cx, a.cy - b.cy
    return F.sqrt(dx * dx + dy * dy)


def yolo_line(class_id: Column, box: Box, width: Column, height: Column) -> Column:
    """``class cx cy w h``, relative and clamped; null for empty boxes."""
    clamp = lambda c, low: F.bround(F.least(F.greatest(c, F.lit(low)), F.lit(1.0)), 6)
    line = F.format_string("%d %.6f %.6f %.6f %.6f", class_id.cast("int"), clamp(box.cx / width, 0.0), clamp(box.cy / height, 0.0), clamp(box.w / width, 0.001), clamp(box.h / height, 0.001))
    return F.when((box.w > 0) & (box.h > 0) & (width > 0) & (height > 0), line)


def relative_box(box: Box, within: Box) -> Column:
    """A box in shares of another one, to six decimals; null where that is
    empty."""
    part = lambda value, size: F.round(value / size, 6)
    shares = F.struct(part(box.x - within.x, within.w).alias("x"), part(box.y - within.y, within.h).alias("y"), part(box.w, within.w).alias("w"), part(box.h, within.h).alias("h"))
    return F.when((within.w > 0) & (within.h > 0), shares)


def relative_points(points: Column, within: Box) -> Column:
    """Points (x, y) in shares of a box, to six decimals."""
    return F.transform(points, lambda p: F.struct(F.round((p["x"] - within.x) / within.w, 6).alias("x"), F.round((p["y"] - within.y) / within.h, 6).alias("y")))


def pixel_area(mask_px: Column, box: Box) -> Column:
    """Pixels of a region's mask where there is one, else of its box."""
    return F.when(mask_px > 0, mask_px).otherwise(box.area)
