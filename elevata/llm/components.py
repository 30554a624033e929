"""Connected components by contraction, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``comp`` (smallest node of a label's component, or another
    fixed node of it) for every node of ``edges`` (longs ``a``, ``b``).

    Each round maps every node to the smallest of itself and its neighbours
    and contracts the edges. What is left of the edges shrinks by a factor
    each round; what is written shrinks with it.
    """
    left = written(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "cc-edges")
    labels = None
    while labels is None or not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "cc-least")
        at_a = least.withColumnsRenamed({"node": "a", "comp": "ca"})
        at_b = least.withColumnsRenamed({"node": "b", "comp": "cb"})
        smaller = left.join(at_a, "a").select("b", "ca").join(at_b, "b").filter(F.col("ca") != F.col("cb"))
        left = written(smaller.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "cc-edges")
        if labels is None:
            labels = least
        else:
            step = least.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
            labels = written(labels.join(step, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "cc-labels")
    return labels
