"""Greedy matching, suppression and first-match joins, all as folds.

Pairs of a group (an image) are gathered into one sorted array and folded, so
a group must be of bounded size: the regions or tokens of one image. Every
order ends in unique ids, which makes results independent of input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box, intersection


def greedy_pairs(pairs: DataFrame, group: str, left: str, right: str, order: list[Column], carry: tuple[str, ...] = ()) -> DataFrame:
    """One-to-one pairs: walk in ``order``, skip what is used already.

    ``order`` sorts ascending; with the left side's place first it becomes
    the left-driven variant, in which each left row takes the best right one
    that is still free. Columns to ``carry`` come out with the chosen pairs.
    """
    keyed = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r"), *(F.col(c).alias(f"c_{c}") for c in carry))
    rows = pairs.select(F.col(group), keyed.alias("p")).groupBy(group).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    empty = F.array().cast("array<bigint>")
    names = {"l": left, "r": right} | {f"c_{c}": c for c in carry}
    kinds = {"l": "bigint", "r": "bigint"} | {f"c_{c}": pairs.schema[c].dataType.simpleString() for c in carry}
    start = F.struct(empty.alias("l"), empty.alias("r"), F.array().cast(f"array<struct<{','.join(f'{n}:{k}' for n, k in kinds.items())}>>").alias("out"))

    def walk(state: Column, p: Column) -> Column:
        used = F.array_contains(state["l"], p["l"]) | F.array_contains(state["r"], p["r"])
        own = F.struct(*(p[n].alias(n) for n in names))
        grown = F.struct(F.concat(state["l"], F.array(p["l"])).alias("l"), F.concat(state["r"], F.array(p["r"])).alias("r"), F.concat(state["out"], F.array(own)).alias("out"))
        return F.when(used, state).otherwise(grown)

    done = rows.select(group, F.aggregate("ps", start, walk).alias("s"))
    return done.select(group, F.explode("s.out").alias("m")).select(group, *(F.col(f"m.{n}").alias(c) for n, c in names.items()))


def suppress(regions: DataFrame, group: str, most_iou: float = 0.30, most_contained: float = 0.72) -> DataFrame:
    """Non-maximum suppression: the largest region first; what overlaps one
    that is kept goes. ``regions``: group, ``region_id``, x, y, w, h."""
    item = F.struct((-F.col("w") * F.col("h")).cast("long").alias("o"), F.col("region_id").cast("long").alias("region_id"), *(F.col(c).cast("long").alias(c) for c in "xywh"))
    rows = regions.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("rs"))
    none = F.array().cast("array<struct<o:bigint,region_id:bigint,x:bigint,y:bigint,w:bigint,h:bigint>>")

    def walk(kept: Column, r: Column) -> Column:
        a = Box.of(struct=r)

        def clash(k: Column) -> Column:
            b = Box.of(struct=k)
            both = intersection(a, b)
            union = F.greatest(a.area + b.area - both, F.lit(1))
            return (both > 0) & ((both / union > most_iou) | (both / F.greatest(F.least(a.area, b.area), F.lit(1)) >= most_contained))

        return F.when(F.exists(kept, clash), kept).otherwise(F.concat(kept, F.array(r)))

    done = rows.select(group, F.explode(F.aggregate("rs", none, walk)).alias("r"))
    return done.select(group, *(F.col(f"r.{c}").alias(c) for c in ("region_id", "x", "y", "w", "h")))


def first_holding(elements: DataFrame, facades: DataFrame, group: str, fallback: bool = True) -> DataFrame:
    """The facade of each element: the first (by ``ord``) whose box holds the
    element's position; else, with ``fallback``, the nearest label position.

    ``elements``: group, element_id, px, py; ``facades``: group, facade_id,
    ord, lx, ly, x, y, w, h. One row per element; null where none.
    """
    pairs = elements.select(group, "element_id", "px", "py").join(facades, group, "left")
    inside = F.coalesce(Box.of().holds(F.col("px"), F.col("py")), F.lit(False))
    dx, dy = F.col("px") - F.col("lx"), F.col("py") - F.col("ly")
    far = F.when(inside, F.lit(0.0)).otherwise((dx * dx + dy * dy).cast("double"))
    rank = F.struct((~inside).alias("out"), far.alias("far"), F.col("ord"), F.col("facade_id"))
    usable = F.col("facade_id").isNotNull() if fallback else inside
    best = pairs.groupBy(group, "element_id").agg(F.min(F.when(usable, rank)).alias("b"))
    return best.select(group, "element_id", F.col("b.facade_id").alias("facade_id"))


def merge_overlapping(boxes: DataFrame, group: str, most_gap: int) -> DataFrame:
    """Clusters of boxes along x: a gap over ``most_gap`` to all earlier
    boxes begins a new one. Adds ``cluster`` (from 1)."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(group).orderBy("x", "y", "region_id")
    reach = F.max(F.col("x") + F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("x") - reach > most_gap), 1).otherwise(0)
    return boxes.withColumn("_begins", begins).withColumn("cluster", F.sum("_begins").over(order).cast("int")).drop("_begins")
