"""Regions of interest as joins and column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def roi_mask_filter(locs: DataFrame, mask: DataFrame, height: int, width: int, per_frame: bool = False) -> DataFrame:
    """Localisations whose nearest pixel, held inside the frame, is in the mask
    ``(recording_id, [frame,] y, x)``."""
    def pixel(c: str, size: int) -> Column:
        return F.least(F.greatest(F.floor(F.col(c) + 0.5), F.lit(0)), F.lit(size - 1)).cast("int")
    keys = ["recording_id", "frame"] if per_frame else ["recording_id"]
    inside = mask.select(*keys, F.col("y").cast("int").alias("_py"), F.col("x").cast("int").alias("_px"))
    at = locs.withColumns({"_py": pixel("y", height), "_px": pixel("x", width)})
    return at.join(inside, [*keys, "_py", "_px"], "left_semi").drop("_py", "_px")


def in_polygon(x: Column, y: Column, vertices: Column) -> Column:
    """Even–odd rule over an array of (x, y) corners."""
    n = F.size(vertices)
    after = F.concat(F.slice(vertices, F.lit(2), n - 1), F.slice(vertices, 1, 1))
    crossed = F.filter(F.arrays_zip(vertices.alias("a"), after.alias("b")), lambda e: (
        ((e["a"]["y"] > y) != (e["b"]["y"] > y))
        & (x < (e["b"]["x"] - e["a"]["x"]) * F.try_divide(y - e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])))
    return F.size(crossed) % 2 == 1


def roi_polygon_filter(locs: DataFrame, rois: DataFrame) -> DataFrame:
    """Localisations inside any polygon of their recording:
    ``rois(recording_id, roi_id, vertices array<struct<x,y>>)``."""
    shapes = rois.groupBy("recording_id").agg(F.collect_list("vertices").alias("_shapes"))
    inside = F.exists("_shapes", lambda v: in_polygon(F.col("x"), F.col("y"), v))
    return locs.join(shapes, "recording_id").where(inside).drop("_shapes")


def roi_replicates(locs: DataFrame, rois: DataFrame) -> DataFrame:
    """Every region becomes a recording of its own, named after both. Regions of a
    recording that share a label are told apart by number."""
    from pyspark.sql import Window as W
    same = W.partitionBy("recording_id", "label").orderBy("roi_id")     # labels of one recording
    named = rois.withColumn("_k", F.row_number().over(same)).withColumn(
        "_name", F.concat_ws("_", F.col("recording_id").cast("string"), "label",
                             F.when(F.col("_k") > 1, F.col("_k").cast("string"))))
    hit = locs.join(named.select("recording_id", "_name", "vertices"), "recording_id").where(
        in_polygon(F.col("x"), F.col("y"), F.col("vertices")))
    return hit.withColumn("recording_id", F.col("_name")).drop("_name", "vertices")


def roi_growth_check(locs: DataFrame, rois: DataFrame) -> DataFrame:
    """Regions that leave the bounding box of the saved localisations."""
    box = locs.groupBy("recording_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"),
                                           F.min("y").alias("y0"), F.max("y").alias("y1"))
    xs, ys = F.transform("vertices", lambda v: v["x"]), F.transform("vertices", lambda v: v["y"])
    beyond = ((F.array_min(xs) < F.col("x0")) | (F.array_max(xs) > F.col("x1"))
              | (F.array_min(ys) < F.col("y0")) | (F.array_max(ys) > F.col("y1")))
    return rois.join(box, "recording_id").select("recording_id", "roi_id", beyond.alias("grows"))


def polygon_edges(rois: DataFrame) -> DataFrame:
    """One row per edge, the last corner joined to the first."""
    n = F.size("vertices")
    return rois.select("recording_id", "roi_id", "vertices", F.posexplode("vertices").alias("edge", "a")).select(
        "recording_id", "roi_id", "edge", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"),
        F.get("vertices", (F.col("edge") + 1) % n)["x"].alias("x1"),
        F.get("vertices", (F.col("edge") + 1) % n)["y"].alias("y1"))


def mask_union(*masks: DataFrame) -> DataFrame:
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m)
    return out.distinct()
