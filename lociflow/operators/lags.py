"""Pairs of observations of one track at a given frame lag.

Rows are laid out by (recording, particle, block of frames); the first frames of
a block are copied to the block before it, so every look-ahead of up to
``horizon`` frames is answered inside one bounded group. A track of any length
therefore spreads over many tasks, and a row crosses the network about once
instead of once per lag.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lociflow.schema import TRACK_KEY, require_columns, require_gap_policy

BLOCK_FRAMES = 512


def look_ahead(tracks: DataFrame, horizon: int, payload: tuple[str, ...] = ("x", "y"),
               key: tuple[str, ...] = tuple(TRACK_KEY), block: int = BLOCK_FRAMES,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row plus ``ahead``: the observations 1…horizon frames later, in order."""
    require_columns(tracks, *key, "frame", *payload)
    block = max(block, 4 * horizon)
    home = F.floor(F.col("frame") / F.lit(block))
    placed = tracks.select(
        *key, "frame", *payload, *keep, home.alias("_home"),
        F.explode(F.when(F.pmod(F.col("frame"), F.lit(block)) < horizon,
                         F.array(home, home - 1)).otherwise(F.array(home))).alias("_block"))
    frame = (W.partitionBy(*key, "_block").orderBy("frame").rangeBetween(1, horizon))
    ahead = F.collect_list(F.struct("frame", *payload)).over(frame)
    return (placed.withColumn("ahead", ahead)
            .where(F.col("_home") == F.col("_block")).drop("_home", "_block"))


def lag_pairs(tracks: DataFrame, max_lag: int = 20, pixel_size: float = 1.0,
              gap_policy: str = "all_pairs") -> DataFrame:
    """``(recording_id, particle, frame, lag, dx, dy)`` for every pair of
    observations whose frame numbers differ by 1…max_lag. With ``contiguous``
    every frame in between must have been observed too."""
    require_gap_policy(gap_policy)
    pairs = (look_ahead(tracks, max_lag)
             .select(*TRACK_KEY, "frame", "x", "y", F.posexplode("ahead").alias("_pos", "_to"))
             .withColumn("lag", (F.col("_to.frame") - F.col("frame")).cast("int")))
    if gap_policy == "contiguous":
        pairs = pairs.where(F.col("_pos") + 1 == F.col("lag"))
    px = float(pixel_size)
    return pairs.select(*TRACK_KEY, "frame", "lag",
                        ((F.col("_to.x") - F.col("x")) * px).alias("dx"),
                        ((F.col("_to.y") - F.col("y")) * px).alias("dy"))


def unit_steps(tracks: DataFrame, pixel_size: float = 1.0) -> DataFrame:
    """Displacements between observations exactly one frame apart."""
    return lag_pairs(tracks, 1, pixel_size).drop("lag")


def adjacent_links(tracks: DataFrame, pixel_size: float = 1.0,
                   block: int = BLOCK_FRAMES) -> DataFrame:
    """Displacement from the previous observation of the track, whatever the gap:
    ``(recording_id, particle, frame, gap, dx, dy)``; no row for a track's first.

    Neighbours inside a block come from a window over the block; the first row of
    a block is compared with the last row of the block before it, of which there
    is one per block.
    """
    here = F.struct("frame", "x", "y")
    placed = tracks.select(*TRACK_KEY, "frame", "x", "y",
                           F.floor(F.col("frame") / block).alias("_block"))
    inside = W.partitionBy(*TRACK_KEY, "_block").orderBy("frame")
    rows = placed.withColumn("_prev", F.lag(here).over(inside))
    ends = (placed.groupBy(*TRACK_KEY, "_block")
            .agg(F.min("frame").alias("frame"), F.min_by("x", "frame").alias("x"), F.min_by("y", "frame").alias("y"),
                 F.max("frame").alias("_f"), F.max_by("x", "frame").alias("_x"), F.max_by("y", "frame").alias("_y")))
    last = F.struct(F.col("_f").alias("frame"), F.col("_x").alias("x"), F.col("_y").alias("y"))
    across = (ends.withColumn("_prev", F.lag(last).over(W.partitionBy(*TRACK_KEY).orderBy("_block")))
              .select(*TRACK_KEY, "frame", "x", "y", "_prev"))
    px = float(pixel_size)
    return (rows.drop("_block").unionByName(across).where(F.col("_prev").isNotNull())
            .select(*TRACK_KEY, "frame",
                    (F.col("frame") - F.col("_prev.frame")).alias("gap"),
                    ((F.col("x") - F.col("_prev.x")) * px).alias("dx"),
                    ((F.col("y") - F.col("_prev.y")) * px).alias("dy")))


def contiguous_runs(tracks: DataFrame, block: int = BLOCK_FRAMES) -> DataFrame:
    """Each observation with the first frame of its gap-free run: ``run_start``.

    A run that reaches across blocks takes its start from the block in which it
    began; one row per block carries that value forward.
    """
    placed = tracks.withColumn("_block", F.floor(F.col("frame") / block))
    inside = W.partitionBy(*TRACK_KEY, "_block").orderBy("frame")
    prev = F.lag("frame").over(inside)
    rows = placed.withColumn("_new", F.when(prev.isNull(), F.lit(None))
                             .when(F.col("frame") - prev != 1, F.col("frame")))
    rows = rows.withColumn("_local", F.last("_new", ignorenulls=True).over(
        inside.rowsBetween(W.unboundedPreceding, 0)))
    ends = (placed.groupBy(*TRACK_KEY, "_block")
            .agg(F.min("frame").alias("_first"), F.max("frame").alias("_last")))
    last_start = rows.groupBy(*TRACK_KEY, "_block").agg(F.max("_local").alias("_restart"))
    chain = W.partitionBy(*TRACK_KEY).orderBy("_block")
    opened = (ends.join(last_start, [*TRACK_KEY, "_block"])
              .withColumn("_opens", F.coalesce(
                  F.col("_first") - F.lag("_last").over(chain) != 1, F.lit(True)))
              .withColumn("_mark", F.coalesce(
                  F.col("_restart"), F.when(F.col("_opens"), F.col("_first")))))
    opened = opened.withColumn(
        "_carried", F.when(F.col("_opens"), F.col("_first")).otherwise(
            F.last("_mark", ignorenulls=True).over(chain.rowsBetween(W.unboundedPreceding, -1))))
    return (rows.join(opened.select(*TRACK_KEY, "_block", "_carried"), [*TRACK_KEY, "_block"])
            .withColumn("run_start", F.coalesce("_local", "_carried"))
            .drop("_block", "_new", "_local", "_carried"))
