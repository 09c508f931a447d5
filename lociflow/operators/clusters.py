"""Density clusters and density maps."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lociflow.functions.distribution import distribution
from lociflow.operators.graph import connected_components
from lociflow.operators.spatial import cell, knn_distance
from lociflow.operators.tracks import dense_ids
from lociflow.session import cut_lineage

# Cells of side eps/√2 whose nearest points can be within eps of each other.
OFFSETS = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]
SMALL = 1024                       # point pairs compared directly
CELL = ["recording_id", "cx", "cy"]


def _around(df: DataFrame, offsets=OFFSETS) -> DataFrame:
    shifts = F.array(*[F.struct(F.lit(i).alias("ox"), F.lit(j).alias("oy")) for i, j in offsets])
    return (df.withColumn("_o", F.explode(shifts))
            .withColumns({"nx": F.col("cx") + F.col("_o.ox"), "ny": F.col("cy") + F.col("_o.oy")}).drop("_o"))


def _d2():
    return F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2)


def _in_cells(points: DataFrame, eps: float) -> DataFrame:
    side = eps / math.sqrt(2.0)
    return points.select("recording_id", "loc_id", "x", "y", cell("x", side).alias("cx"), cell("y", side).alias("cy"))


def core_points(cells: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Points with min_samples points (itself included) within eps.

    Two points of one cell are always within eps, so a cell with enough points is
    core as a whole; only the few points of sparse cells look at their
    surroundings.
    """
    full = cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    dense = cells.join(full.where(F.col("n") >= min_samples), CELL, "left_semi")
    sparse = _around(cells.join(full.where(F.col("n") < min_samples), CELL, "left_semi"))
    other = cells.select("recording_id", F.col("cx").alias("nx"), F.col("cy").alias("ny"),
                         F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = sparse.join(other, ["recording_id", "nx", "ny"]).where(_d2() <= eps * eps)
    found = near.groupBy("recording_id", "loc_id", "x", "y", "cx", "cy").agg(F.count(F.lit(1)).alias("k"))
    return dense.unionByName(found.where(F.col("k") >= min_samples).drop("k"))


def _boxes(core: DataFrame, side: float, level: int, tag: str) -> DataFrame:
    part = side / 2 ** level
    return core.groupBy(*CELL, cell("x", part).alias("sx"), cell("y", part).alias("sy")).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.count(F.lit(1)).alias("n")).select(
        "recording_id", *[F.col(c).alias(f"{c}_{tag}") for c in ("cx", "cy", "sx", "sy", "x0", "x1", "y0", "y1", "n")])


def touching_cells(core: DataFrame, eps: float, max_levels: int = 40) -> DataFrame:
    """Pairs of neighbouring cells with core points within eps of each other.

    Boxes around the points of a cell settle most pairs: too far apart, or close
    throughout. What is left is split into quarters, level by level, until the
    boxes are settled or hold few enough points to compare them directly, so two
    crowded cells never meet point by point.
    """
    side = eps / math.sqrt(2.0)
    half = [(i, j) for i, j in OFFSETS if (i, j) > (0, 0)]
    pair = ["recording_id", "cx_a", "cy_a", "cx_b", "cy_b"]
    places = cut_lineage(core.select(*CELL, "x", "y").distinct())
    found: list[DataFrame] = []
    a, b = _boxes(places, side, 0, "a"), _boxes(places, side, 0, "b")
    near = _around(a.withColumns({"cx": F.col("cx_a"), "cy": F.col("cy_a")}), half).drop("cx", "cy")
    open_ = near.join(b.withColumns({"nx": F.col("cx_b"), "ny": F.col("cy_b")}), ["recording_id", "nx", "ny"]).drop("nx", "ny")
    for level in range(max_levels):
        def apart(c):
            return F.greatest(F.col(f"{c}0_b") - F.col(f"{c}1_a"), F.col(f"{c}0_a") - F.col(f"{c}1_b"), F.lit(0.0))

        def across(c):
            return F.greatest(F.col(f"{c}1_b") - F.col(f"{c}0_a"), F.col(f"{c}1_a") - F.col(f"{c}0_b"))
        judged = cut_lineage(open_.where(F.pow(apart("x"), 2) + F.pow(apart("y"), 2) <= eps * eps)
                             .withColumn("_sure", F.pow(across("x"), 2) + F.pow(across("y"), 2) <= eps * eps))
        sure = judged.where("_sure").select(*pair).distinct()
        rest = judged.where("NOT _sure").join(sure, pair, "left_anti")
        small = rest.where(F.col("n_a") * F.col("n_b") <= SMALL)
        pts_part = side / 2 ** level
        pts = places.withColumns({"sx": cell("x", pts_part), "sy": cell("y", pts_part)})
        pa = pts.select("recording_id", *[F.col(c).alias(f"{c}_a") for c in ("cx", "cy", "sx", "sy")], "x", "y")
        pb = pts.select("recording_id", *[F.col(c).alias(f"{c}_b") for c in ("cx", "cy", "sx", "sy")],
                        F.col("x").alias("x2"), F.col("y").alias("y2"))
        direct = (small.select(*pair, "sx_a", "sy_a", "sx_b", "sy_b")
                  .join(pa, ["recording_id", "cx_a", "cy_a", "sx_a", "sy_a"])
                  .join(pb, ["recording_id", "cx_b", "cy_b", "sx_b", "sy_b"])
                  .where(_d2() <= eps * eps).select(*pair).distinct())
        hit = cut_lineage(sure.unionByName(direct).distinct())
        found.append(hit)
        big = cut_lineage(rest.where(F.col("n_a") * F.col("n_b") > SMALL).join(hit, pair, "left_anti")
                          .select(*pair, "sx_a", "sy_a", "sx_b", "sy_b"))
        if big.isEmpty():
            break

        def halves(tag):
            child = _boxes(places, side, level + 1, tag)
            return child.withColumns({f"px_{tag}": F.floor(F.col(f"sx_{tag}") / 2), f"py_{tag}": F.floor(F.col(f"sy_{tag}") / 2)})
        up = big.select(*pair, *[F.col(f"s{c}_{t}").alias(f"p{c}_{t}") for t in "ab" for c in "xy"])
        open_ = (up.join(halves("a"), ["recording_id", "cx_a", "cy_a", "px_a", "py_a"])
                 .join(halves("b"), ["recording_id", "cx_b", "cy_b", "px_b", "py_b"])
                 .drop("px_a", "py_a", "px_b", "py_b"))
    else:
        raise RuntimeError(f"cell pairs are still open after {max_levels} levels")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``(recording_id, loc_id, x, y, is_core, cluster)``; −1 is noise. Clusters
    are numbered by their smallest core id; a border point joins the lowest
    numbered cluster with a core point within eps."""
    cells = cut_lineage(_in_cells(points, eps))
    core = cut_lineage(core_points(cells, eps, min_samples))
    node = lambda s: F.struct("recording_id", F.col(f"cx{s}").alias("cx"), F.col(f"cy{s}").alias("cy"))
    links = touching_cells(core, eps).select(node("_a").alias("a"), node("_b").alias("b"))
    alone = core.select(F.struct(*CELL).alias("a")).distinct().select("a", F.col("a").alias("b"))
    comp = connected_components(links.unionByName(alone))
    labelled = core.join(comp.select(F.col("node.recording_id").alias("recording_id"), F.col("node.cx").alias("cx"),
                                     F.col("node.cy").alias("cy"), "component"), CELL)
    lowest = labelled.groupBy("component").agg(F.min("loc_id").alias("_first"))
    named = cut_lineage(dense_ids(labelled.join(lowest, "component"), ["recording_id"], "_first", "cluster")
                        .select("recording_id", "loc_id", "x", "y", "cx", "cy", "cluster"))
    rest = cells.join(named.select("recording_id", "loc_id"), ["recording_id", "loc_id"], "left_anti")
    other = named.select("recording_id", F.col("cx").alias("nx"), F.col("cy").alias("ny"),
                         F.col("x").alias("x2"), F.col("y").alias("y2"), "cluster")
    border = (_around(rest).join(other, ["recording_id", "nx", "ny"]).where(_d2() <= eps * eps)
              .groupBy("recording_id", "loc_id").agg(F.min("cluster").alias("cluster")))
    outside = rest.join(border, ["recording_id", "loc_id"], "left").select(
        "recording_id", "loc_id", "x", "y", F.lit(False).alias("is_core"), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return named.select("recording_id", "loc_id", "x", "y", F.lit(True).alias("is_core"), "cluster").unionByName(outside)


def _hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in order (monotone chain)."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def chain(seq):
        out: list = []
        for p in seq:
            while len(out) >= 2 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                     - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]
    return np.array(chain(pts) + chain(pts[::-1]))


def hull_area(labelled: DataFrame, by: Sequence[str] = ("recording_id", "cluster")) -> DataFrame:
    """Area of each cluster's convex hull; NULL below three corners. Partitions
    first reduce their points to hull corners, so few points are brought together."""
    by = list(by)

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, g in pdf.groupby(by, sort=False):
                h = _hull(g[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({**{k: v for k, v in zip(by, key)}, "x": h[:, 0], "y": h[:, 1]})

    def area(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hull(pdf[["x", "y"]].to_numpy(float))
        a = None
        if len(h) >= 3:
            x, y = h[:, 0], h[:, 1]
            a = 0.5 * abs(float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)))
        return pd.DataFrame([[*key, a]], columns=[*by, "area_um2"])
    types = {f.name: f.dataType.simpleString() for f in labelled.schema}
    head = ", ".join(f"`{c}` {types[c]}" for c in by)
    few = labelled.select(*by, "x", "y").mapInPandas(corners, f"{head}, x double, y double")
    return few.groupBy(*by).applyInPandas(area, f"{head}, area_um2 double")


def cluster_stats(labelled: DataFrame) -> DataFrame:
    """Size, area, density, radius of gyration and centroid of each cluster."""
    inside = labelled.where("cluster >= 0")
    m = inside.groupBy("recording_id", "cluster").agg(
        F.count(F.lit(1)).alias("n_locs"), F.avg("x").alias("centroid_x_um"), F.avg("y").alias("centroid_y_um"),
        F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("rg_um"))
    out = m.join(hull_area(inside), ["recording_id", "cluster"], "left")
    return out.withColumn("density_locs_per_um2", F.when(F.col("area_um2") > 0, F.col("n_locs") / F.col("area_um2")))


def suggest_eps(points: DataFrame, min_samples: int = 8, low: float = 0.005, high: float = 2.0) -> DataFrame:
    """Radius per recording at the elbow of the sorted distances to the
    min_samples-th point (itself counted): the largest deviation from the chord
    after trimming 2 % at either end."""
    kd = knn_distance(points, max(2, min_samples) - 1)
    d = cut_lineage(distribution(kd, ["recording_id"], "distance"))
    m = F.col("n_total")
    lo, hi = F.floor(m * 0.02), F.least(m - 1, F.floor(m * 0.98))
    last = F.col("n_below") + F.col("n_equal") - 1
    holds = lambda k: (F.col("n_below") <= k) & (k <= last)                       # noqa: E731
    ends = d.groupBy("recording_id").agg(
        F.max(F.when(holds(lo), F.col("value"))).alias("y0"), F.max(F.when(holds(hi), F.col("value"))).alias("y1"),
        F.max(lo).alias("lo"), F.max(hi).alias("hi"))
    run = d.join(ends, "recording_id").where((last >= F.col("lo")) & (F.col("n_below") <= F.col("hi")))
    # equal distances occupy a run of places; only its ends can be extreme
    places = F.array(F.greatest("n_below", "lo"), F.least(last, F.col("hi")))
    at = run.withColumn("i", F.explode(places)).withColumn("i", F.col("i") - F.col("lo"))
    span = F.col("hi") - F.col("lo")
    off = F.abs((F.col("y1") - F.col("y0")) * F.col("i") - span * F.col("value") + span * F.col("y0"))
    best = at.groupBy("recording_id").agg(
        F.max_by("value", F.struct(F.round(off, 12), -F.col("i"))).alias("eps"), F.max("n_total").alias("n_points"))
    return best.where("n_points >= 3 AND eps > 0").select(
        "recording_id", F.least(F.greatest("eps", F.lit(low)), F.lit(high)).alias("eps"))


def loc_motion(points: DataFrame, tracked: DataFrame, pixel_size: float) -> DataFrame:
    """Motion class of each localisation by its position in µm to four places;
    ``Unmatched`` where no tracked one lies there, the last one where several do.

    ``tracked(recording_id, loc_id, x, y, motion)``.
    """
    def at(c): return F.round(F.col(c) * float(pixel_size), 4)
    known = (tracked.groupBy("recording_id", at("x").alias("_x"), at("y").alias("_y"))
             .agg(F.max_by("motion", "loc_id").alias("motion")))
    return (points.withColumns({"_x": at("x"), "_y": at("y")})
            .join(known, ["recording_id", "_x", "_y"], "left").drop("_x", "_y")
            .withColumn("motion", F.coalesce("motion", F.lit("Unmatched"))))


def cluster_motion_mix(labelled: DataFrame) -> DataFrame:
    """Share of every motion class in each cluster, and the dominant one."""
    n = labelled.where("cluster >= 0").groupBy("recording_id", "cluster", "motion").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("recording_id", "cluster").agg(
        F.sum("n").alias("_t"), F.max_by("motion", F.struct("n", "motion")).alias("dominant"))
    return n.join(top, ["recording_id", "cluster"]).select(
        "recording_id", "cluster", "motion", "n", (F.col("n") / F.col("_t")).alias("share"),
        (F.col("motion") == F.col("dominant")).alias("is_dominant"))


def density_map(locs: DataFrame, pixel_size: float, sr_nm: float = 20.0) -> DataFrame:
    """Counts on a super-resolution grid from the corner of the bounding box. The map
    is sparse, so the grid keeps its step however large the field is."""
    step = sr_nm / 1000.0 / float(pixel_size)
    box = locs.groupBy("recording_id").agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    bin_ = F.lit(step)
    at = locs.join(box, "recording_id").select(
        "recording_id", F.floor((F.col("x") - F.col("_x0")) / bin_).alias("bx"),
        F.floor((F.col("y") - F.col("_y0")) / bin_).alias("by"))
    return at.groupBy("recording_id", "bx", "by").agg(F.count(F.lit(1)).alias("n"))


def blur_map(density: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Gaussian blur of a sparse map, one axis after the other."""
    reach = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(weights)
    kernel = F.array(*[F.struct(F.lit(k).alias("o"), F.lit(w / total).alias("w"))
                       for k, w in zip(range(-reach, reach + 1), weights)])
    out = density.select("recording_id", "bx", "by", F.col("n").cast("double").alias("v"))
    for axis, other in (("bx", "by"), ("by", "bx")):
        out = (out.withColumn("_k", F.explode(kernel))
               .groupBy("recording_id", other, (F.col(axis) + F.col("_k.o")).alias(axis))
               .agg(F.sum(F.col("v") * F.col("_k.w")).alias("v")))
    return out
