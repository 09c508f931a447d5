"""Range joins in the plane on a grid of cells.

The left side visits the cells its search disc can reach (at most four, with
cells twice the radius), the right side lives in one cell, so the join is an
equi-join on the cell and the distance is only computed inside it.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lociflow.session import cut_lineage, spread


def cell(v: Column | str, size: float) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) / F.lit(float(size)))


def reach(v: str, radius: float, size: float) -> Column:
    return F.sequence(cell(F.col(v) - radius, size), cell(F.col(v) + radius, size))


def near_pairs(left: DataFrame, right: DataFrame, radius: float, on: Sequence[str]) -> DataFrame:
    """Pairs of left and right rows that agree on ``on`` and lie within
    ``radius`` by ``(x, y)`` and ``(x2, y2)``; adds ``d2``. Columns other than
    ``on`` must differ between the sides."""
    size = 2.0 * radius
    a = (left.withColumn("_cx", F.explode(reach("x", radius, size)))
         .withColumn("_cy", F.explode(reach("y", radius, size))))
    b = right.withColumns({"_cx": cell("x2", size), "_cy": cell("y2", size)})
    d2 = F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2)
    return (a.join(spread(b), [*on, "_cx", "_cy"]).drop("_cx", "_cy").withColumn("d2", d2)
            .where(F.col("d2") <= float(radius) ** 2))


def eps_neighbours(points: DataFrame, eps: float) -> DataFrame:
    """Every pair of points of a recording within ``eps``, lower id first."""
    left = points.select("recording_id", F.col("loc_id").alias("i"), "x", "y")
    right = points.select("recording_id", F.col("loc_id").alias("j"),
                          F.col("x").alias("x2"), F.col("y").alias("y2"))
    return (near_pairs(left, right, eps, ["recording_id"]).where(F.col("i") < F.col("j"))
            .select("recording_id", "i", "j", F.sqrt("d2").alias("distance")))


COARSER, FINER, DEEPEST = 2, 4, 40           # levels counted around the mean density, and the finest of all
CROWDED = 32


def _leaf_levels(places: DataFrame, k: int, crowd_factor: int) -> DataFrame:
    """``(_group, x, y, _l)``: the finest level of the group's quadtree at which a place's square still holds more than k points.

    Levels around the group's mean density are counted at once. Only places whose finest counted square is crowded go
    on to finer ones, so a dense spot costs its own places a few more levels and the others nothing. A
    place without such a square has the whole group, level 0.
    """
    first, last, todo, parts = -COARSER, FINER, places, []
    while True:
        levels = F.sequence(F.greatest(F.lit(0), F.col("_l0") + first), F.least(F.col("_l0") + last, F.lit(DEEPEST)))
        each = todo.select("_group", "x", "y", "m", "_x0", "_y0", "_side", F.explode(levels).alias("_l")).select(
            "_group", "x", "y", "m", "_l", _square("x", "_x0", F.col("_l")).alias("_cx"), _square("y", "_y0", F.col("_l")).alias("_cy"))
        square = ["_group", "_l", "_cx", "_cy"]
        counts = each.groupBy(*square).agg(F.sum("m").alias("_c"), F.count(F.lit(1)).alias("_n")).where(F.col("_c") > k)
        settled = cut_lineage(each.join(spread(counts), square).groupBy("_group", "x", "y").agg(F.max("_l").alias("_l"), F.max_by("_n", "_l").alias("_n")))
        parts.append(settled.select("_group", "x", "y", "_l"))
        if last >= DEEPEST:
            break
        deeper = settled.where(F.col("_n") > crowd_factor * (k + 1)).join(spread(places), ["_group", "x", "y"]).where(
            (F.col("_l") == F.col("_l0") + last) & (F.col("_l") < DEEPEST)).drop("_l", "_n")
        if deeper.isEmpty():
            break
        first, last, todo = last + 1, last + 2 * COARSER + FINER, cut_lineage(deeper)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out if len(parts) == 1 else out.groupBy("_group", "x", "y").agg(F.max("_l").alias("_l"))


def _square(v: Column | str, low: str, level: Column) -> Column:
    return F.floor(((F.col(v) if isinstance(v, str) else v) - F.col(low)) / F.col("_side") * F.pow(F.lit(2.0), level))


def knn_distance(points: DataFrame, k: int, on: Sequence[str] = ("recording_id",),
                 crowd_factor: int = CROWDED) -> DataFrame:
    """``(on…, loc_id, distance)`` to the k-th nearest other point of the group;
    no row in groups of k or fewer.

    Coincident points count by multiplicity and are looked up once. A quadtree square that holds more than k
    points has the k-th neighbour of each within its diagonal, so the finest such square certifies a search radius, and one
    join over squares twice its size settles every place, however uneven the density is.
    """
    on = list(on)
    keyed = points.select(*on, "loc_id", "x", "y", F.struct(*on).alias("_group"))
    places = keyed.groupBy("_group", "x", "y").agg(F.count(F.lit(1)).alias("m"))
    side = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    boxes = places.groupBy("_group").agg(F.sum("m").alias("_size"), F.min("x").alias("_x0"), F.min("y").alias("_y0"),
                                         F.when(side > 0, side * 1.000001).otherwise(1.0).alias("_side")).where(F.col("_size") > k)
    level = F.greatest(F.lit(0), F.floor(F.log(F.col("_size") / (k + 1)) / F.log(F.lit(4.0)))).cast("int")
    places = cut_lineage(places.join(spread(boxes), "_group").withColumn("_l0", F.least(level, F.lit(DEEPEST - FINER))))
    own = places.join(spread(_leaf_levels(places, k, crowd_factor)), ["_group", "x", "y"], "left").withColumn("_l", F.coalesce("_l", F.lit(0)))
    # the diagonal, and a little for rounding at fine levels
    own = cut_lineage(own.withColumns({"_r": 1.415 * F.col("_side") / F.pow(F.lit(2.0), F.col("_l")), "_g": F.greatest(F.col("_l") - 1, F.lit(0))}))

    def reached(v: str, low: str) -> Column:
        return F.explode(F.sequence(_square(F.col(v) - F.col("_r"), low, F.col("_g")), _square(F.col(v) + F.col("_r"), low, F.col("_g"))))
    left = own.withColumn("_cx", reached("x", "_x0")).withColumn("_cy", reached("y", "_y0")).select("_group", "_g", "_cx", "_cy", "x", "y", "_r")
    used = own.select("_group", "_g").distinct()
    right = places.join(spread(used), "_group").select("_group", "_g", _square("x", "_x0", F.col("_g")).alias("_cx"), _square("y", "_y0", F.col("_g")).alias("_cy"),
                                               F.col("x").alias("x2"), F.col("y").alias("y2"), "m")
    d2 = F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2)
    near = left.join(spread(right), ["_group", "_g", "_cx", "_cy"]).withColumn("d2", d2).where(F.col("d2") <= F.col("_r") * F.col("_r"))
    if k == 1:                                             # a minimum combines before the shuffle
        other = F.when((F.col("d2") > 0) | (F.col("x2") != F.col("x")) | (F.col("y2") != F.col("y")) | (F.col("m") > 1), F.col("d2"))
        found = near.groupBy("_group", "x", "y").agg(F.sqrt(F.min(other)).alias("distance"))
    else:
        order = W.partitionBy("_group", "x", "y").orderBy("d2").rowsBetween(W.unboundedPreceding, 0)
        # the place itself is at distance zero and holds one point that is not "other"
        seen = near.withColumn("_seen", F.sum("m").over(order) - 1).where(F.col("_seen") >= k)
        found = seen.groupBy("_group", "x", "y").agg(F.sqrt(F.min("d2")).alias("distance"))
    return keyed.join(spread(found), ["_group", "x", "y"]).select(*on, "loc_id", "distance")


def nearest_spacing(locs: DataFrame) -> DataFrame:
    """Distance of each spot to the nearest other spot of its frame."""
    return knn_distance(locs, 1, ("recording_id", "frame"))
