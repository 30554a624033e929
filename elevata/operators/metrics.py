"""Accuracy of detections against ground truth, and its roll-ups.

Predictions and truth: sample_id, id, x, y, w, h (and area_cm2). Every metric
works on all samples at once, keyed by sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.boxes import Box, centre_distance, iou
from .matching import greedy_pairs


def _pairs(pred: DataFrame, truth: DataFrame) -> DataFrame:
    p = pred.select("sample_id", F.col("id").alias("pred_id"), *(F.col(c).alias("p" + c) for c in "xywh"), *(["area_cm2"] if "area_cm2" in pred.columns else []))
    t = truth.select("sample_id", F.col("id").alias("gt_id"), *(F.col(c).alias("g" + c) for c in "xywh"), *([F.col("area_cm2").alias("gt_cm2")] if "area_cm2" in truth.columns else []))
    return p.join(t, "sample_id")


def _counts(pred: DataFrame, truth: DataFrame) -> DataFrame:
    a = pred.groupBy("sample_id").agg(F.count("*").alias("n_pred"))
    b = truth.groupBy("sample_id").agg(F.count("*").alias("n_gt"))
    return a.join(b, "sample_id", "full").na.fill(0, ["n_pred", "n_gt"])


def facade_iou(pred: DataFrame, truth: DataFrame, least: float = 0.1) -> DataFrame:
    """Mean IoU of each sample: each prediction, in order, takes the best
    truth still free, if it reaches ``least``; what stays alone counts 0."""
    pairs = _pairs(pred, truth).withColumn("iou", iou(Box.of("p"), Box.of("g"))).filter((F.col("iou") >= least) & (F.col("iou") > 0))
    chosen = greedy_pairs(pairs, "sample_id", "pred_id", "gt_id", [F.col("pred_id"), -F.col("iou")], ("iou",))
    found = chosen.groupBy("sample_id").agg(F.sum(F.round("iou", 9)).alias("s"), F.count("*").alias("n"))
    rows = _counts(pred, truth).join(found, "sample_id", "left").na.fill(0, ["s", "n"])
    total = F.col("n_pred") + F.col("n_gt") - F.col("n")
    mean = F.when(F.col("n_gt") == 0, F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)).otherwise(F.col("s") / total)
    return rows.select("sample_id", F.col("n").cast("long").alias("n_matched"), mean.alias("mean_iou"))


def nearest_matches(pred: DataFrame, truth: DataFrame, distance: float = config.METRIC_DISTANCE) -> DataFrame:
    """Each prediction, in order, takes the nearest truth that is free."""
    pairs = _pairs(pred, truth).withColumn("d", centre_distance(Box.of("p"), Box.of("g"))).filter(F.col("d") <= distance)
    carry = tuple(c for c in ("area_cm2", "gt_cm2") if c in pairs.columns)
    return greedy_pairs(pairs, "sample_id", "pred_id", "gt_id", [F.col("pred_id"), F.col("d")], carry)


def window_scores(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 by sample, with the usual conventions where
    one side is empty."""
    found = nearest_matches(pred, truth).groupBy("sample_id").agg(F.count("*").alias("tp"))
    rows = _counts(pred, truth).join(found, "sample_id", "left").na.fill(0, ["tp"])
    tp, p, g = F.col("tp"), F.col("n_pred"), F.col("n_gt")
    precision = F.when(p > 0, tp / p).otherwise(F.when(g > 0, 1.0).otherwise(1.0))
    recall = F.when(g > 0, tp / g).otherwise(1.0)
    rows = rows.withColumns({"precision": precision, "recall": recall})
    both = F.col("precision") + F.col("recall")
    f1 = F.when((p == 0) & (g == 0), 1.0).when((p == 0) | (g == 0), 0.0).when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    return rows.select("sample_id", "tp", (p - tp).alias("fp"), (g - tp).alias("fn"), "precision", "recall", f1.alias("f1"))


def area_errors(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean and largest area error (m2) of matched pairs by sample."""
    error = F.abs(F.col("area_cm2") - F.col("gt_cm2"))
    found = nearest_matches(pred, truth).filter((F.col("area_cm2") > 0) | (F.col("gt_cm2") > 0))
    return found.groupBy("sample_id").agg((F.sum(error) / F.count("*") / 10000.0).alias("mean_error_m2"), (F.max(error) / 10000.0).alias("max_error_m2"))


def iou_matches(pred: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one matches of each sample, best IoU first; counts of matched,
    missed and extra boxes."""
    pairs = _pairs(pred, truth).withColumn("iou", iou(Box.of("p"), Box.of("g"))).filter(F.col("iou") >= least)
    chosen = greedy_pairs(pairs, "sample_id", "gt_id", "pred_id", [-F.col("iou"), -F.col("gt_id"), -F.col("pred_id")])
    found = chosen.groupBy("sample_id").agg(F.count("*").alias("matched"))
    rows = _counts(pred, truth).join(found, "sample_id", "left").na.fill(0, ["matched"])
    return rows.select("sample_id", "matched", (F.col("n_gt") - F.col("matched")).alias("missed"), (F.col("n_pred") - F.col("matched")).alias("extra"))


def positional_iou(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean IoU of boxes paired by place after sorting by centre; 0 where the
    counts differ."""
    key = lambda: F.array_sort(F.collect_list(F.struct(Box.of().cx.alias("cx"), "y", "w", "h", "x", "id")))
    p, t = pred.groupBy("sample_id").agg(key().alias("ps")), truth.groupBy("sample_id").agg(key().alias("ts"))
    both = p.join(t, "sample_id")
    each = F.zip_with("ps", "ts", lambda a, b: F.round(iou(Box.of(struct=a), Box.of(struct=b)), 9))
    mean = F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size("ts")
    return both.select("sample_id", F.when(F.size("ps") == F.size("ts"), mean).otherwise(0.0).alias("mean_iou"))


def micro_scores(matches: DataFrame, key: str) -> DataFrame:
    """Precision and recall over all boxes of a class."""
    m, e, n = F.sum("matched"), F.sum("extra"), F.sum("missed")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return matches.groupBy(key).agg(safe(m, m + e).alias("precision"), safe(m, m + n).alias("recall"))


def count_check(found: Column, exact: Column, low: Column) -> Column:
    """Whether a count is as expected: exactly, or at least."""
    return F.when(exact.isNotNull(), F.when(found == exact, "ok").otherwise("differs")).when(low.isNotNull(), F.when(found >= low, "ok").otherwise("too few")).otherwise("unchecked")


def baseline_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Cases whose boxes changed: counts, or a coordinate by over 2 px after
    sorting. Both: case_id, x, y, w, h."""
    boxes = lambda df, n: df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*"xywh"))).alias(n))
    both = boxes(now, "a").join(boxes(before, "b"), "case_id", "left")
    delta = F.array_max(F.zip_with("a", "b", lambda p, q: F.greatest(*(F.abs(p[c] - q[c]) for c in "xywh"))))
    same = F.size("a") == F.size("b")
    return both.filter("b IS NOT NULL").select("case_id", (F.size("a") - F.size("b")).alias("more"), F.when(same, delta).otherwise(10**6).cast("long").alias("delta"), (~same | (delta > 2)).alias("changed"))


def line_y(points: Column, x: Column) -> Column:
    """Height of a polyline (array of x, y, sorted by x) at ``x``; its ends
    reach on level."""
    ordered = F.array_sort(points)
    first, last = F.get(ordered, F.lit(0)), F.element_at(ordered, -1)
    before, after = F.element_at(F.filter(ordered, lambda p: p["x"] <= x), -1), F.get(F.filter(ordered, lambda p: p["x"] > x), F.lit(0))
    inner = before["y"] + (after["y"] - before["y"]) * (x - before["x"]) / (after["x"] - before["x"])
    return F.when(F.size(points) == 0, F.lit(None)).when(x <= first["x"], first["y"].cast("double")).when(x >= last["x"], last["y"].cast("double")).otherwise(inner)


def geometry_metrics(facade: Box, socle: Box, door: Box, profile: Column) -> Column:
    """Offsets between a facade, its socle, the socle line and a door."""
    gap = lambda b: F.bround(b.bottom - line_y(profile, b.cx)).cast("long")
    return F.struct((facade.x - socle.x).alias("left_offset"), (socle.right - facade.right).alias("right_offset"), gap(facade).alias("facade_to_line"), gap(door).alias("door_to_line"))


def sample_scores(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """All scores of each sample in one row, to four decimals: mean IoU,
    precision, recall, F1, and errors of areas (null without matched areas)."""
    rows = facade_iou(pred, truth).join(window_scores(pred, truth), "sample_id").join(area_errors(pred, truth), "sample_id", "left")
    return rows.select("sample_id", *(F.round(c, 4).alias(c) for c in ("mean_iou", "precision", "recall", "f1", "mean_error_m2", "max_error_m2")))


def filled_truth(truth: DataFrame, found: DataFrame, images: DataFrame) -> DataFrame:
    """Truth of all images: that of ``truth``, and for images without any what
    was found in them (``source`` says which). All are keyed by ``stem``."""
    empty = images.select("stem").distinct().join(truth.select("stem").distinct(), "stem", "left_anti")
    own = truth.withColumn("source", F.lit("truth"))
    return own.unionByName(found.join(empty, "stem", "left_semi").withColumn("source", F.lit("found")), allowMissingColumns=True)


def scenario_json(scores: DataFrame, key: str) -> DataFrame:
    """One JSON text for each scenario: its number of samples, mean scores and
    the samples' own scores in the order of their ids."""
    names = [c for c in scores.columns if c not in (key, "sample_id")]
    sample = F.struct("sample_id", *names)
    means = F.struct(*(F.round(F.avg(c), 4).alias(c) for c in names))
    rows = scores.groupBy(key).agg(F.count("*").alias("n"), means.alias("means"), F.array_sort(F.collect_list(sample)).alias("samples"))
    return rows.select(key, F.to_json(F.struct(F.col(key).alias("scenario"), "n", "means", "samples")).alias("json"))
