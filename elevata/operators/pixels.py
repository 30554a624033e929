"""Pixel measures over exploded images: image_id, x, y, v.

For whole photographs the same measures run inside one Python stage (see
`elevata.operators.kernels`); exploded pixels serve small rasters and checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def row_occupancy(pixels: DataFrame, least: float) -> DataFrame:
    """Share of foreground by image row."""
    return pixels.groupBy("image_id", "y").agg((F.count_if(F.col("v") > least) / F.count("*")).alias("share"))


def top_profile(pixels: DataFrame, least: float) -> DataFrame:
    """First and last foreground row of each column; −1 where none."""
    on = F.when(F.col("v") > least, F.col("y"))
    return pixels.groupBy("image_id", "x").agg(F.coalesce(F.min(on), F.lit(-1)).alias("top"), F.coalesce(F.max(on), F.lit(-1)).alias("bottom"))


def percentile_mask(pixels: DataFrame, percent: float) -> DataFrame:
    """Pixels over an exact percentile of their image, and how many."""
    cut = pixels.groupBy("image_id").agg(F.percentile("v", F.lit(percent / 100)).alias("cut"))
    return pixels.join(cut, "image_id").groupBy("image_id").agg(F.first("cut").alias("cut"), F.count_if(F.col("v") > F.col("cut")).alias("n_over"))


def rolling_mean(values: Column, group: str, order: str, reach: int) -> Column:
    """Centred mean over 2 * reach + 1 places; places beyond the ends count
    as zeros."""
    over = Window.partitionBy(group).orderBy(order).rowsBetween(-reach, reach)
    return F.sum(values).over(over) / float(2 * reach + 1)


def largest_step(profile: DataFrame) -> DataFrame:
    """The column behind the largest step of each image's top profile, where
    the step reaches max(2, 18 % of the span)."""
    order = Window.partitionBy("image_id").orderBy("x")
    rows = profile.filter("top >= 0").withColumn("step", F.abs(F.col("top") - F.lag("top").over(order)))
    best = rows.groupBy("image_id").agg(F.max("step").alias("step"), F.min_by("x", F.struct((-F.coalesce("step", F.lit(-1))).alias("s"), "x")).alias("x"), (F.max("top") - F.min("top")).alias("span"))
    return best.filter(F.col("step") >= F.greatest(F.lit(2.0), F.col("span") * 0.18)).select("image_id", "x", "step")


def components(pixels: DataFrame, least: float, size: int) -> DataFrame:
    """8-connected foreground components of rasters of ``size`` pixels a side:
    image_id, label (smallest y * size + x), n, x, y, w, h.

    Labels spread as a fold over each image's pixel set, as often as a path
    may be long; made for small rasters.
    """
    on = pixels.filter(F.col("v") > least).select("image_id", (F.col("y") * size + F.col("x")).cast("int").alias("p"))
    sets = on.groupBy("image_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))

    def near(a: Column, b: Column) -> Column:
        dy = F.abs(F.floor(a / size) - F.floor(b / size))
        return (dy <= 1) & (F.abs(a % size - b % size) <= 1)

    empty = F.array().cast("array<array<int>>")

    def add(groups: Column, p: Column) -> Column:
        hit = lambda g: F.exists(g, lambda q: near(q, p))
        joined = F.concat(F.flatten(F.filter(groups, hit)), F.array(p))
        return F.concat(F.filter(groups, lambda g: ~hit(g)), F.array(joined))

    rows = sets.select("image_id", F.explode(F.aggregate("ps", empty, add)).alias("g"))
    xs, ys = F.transform("g", lambda p: p % size), F.transform("g", lambda p: F.floor(p / size).cast("int"))
    x, y = F.array_min(xs), F.array_min(ys)
    return rows.select("image_id", F.array_min("g").alias("label"), F.size("g").alias("n"), x.alias("x"), y.alias("y"), (F.array_max(xs) - x + 1).alias("w"), (F.array_max(ys) - y + 1).alias("h"))


def in_hsv(h: Column, s: Column, v: Column, low: tuple, high: tuple) -> Column:
    return h.between(low[0], high[0]) & s.between(low[1], high[1]) & v.between(low[2], high[2])
