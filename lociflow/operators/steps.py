"""Measures over the population of single-frame steps."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lociflow.functions.distribution import quantiles
from lociflow.operators.lags import lag_pairs, look_ahead, unit_steps
from lociflow.operators.tracks import is_immobile, is_mobile
from lociflow.schema import MOBILE_D_THRESHOLD, TRACK_KEY

def squared() -> Column:
    return F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")


def with_enough(df: DataFrame, minimum: int, by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Rows of the groups that have at least ``minimum`` of them."""
    big = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return df.join(big, list(by), "left_semi")


def jump_distances(tracks: DataFrame, pixel_size: float, minimum: int = 30) -> DataFrame:
    jumps = unit_steps(tracks, pixel_size).select(*TRACK_KEY, "frame", F.sqrt(squared()).alias("jump_um"))
    return with_enough(jumps, minimum)


def van_hove(tracks: DataFrame, pixel_size: float, lag: int = 1, minimum: int = 50) -> DataFrame:
    """Moments of the displacements over ``lag`` uninterrupted frames."""
    pairs = lag_pairs(tracks, lag, pixel_size, "contiguous").where(F.col("lag") == lag)
    m2, m4 = F.avg(squared()), F.avg(squared() * squared())
    # variance of dx and dy pooled, from one pass over the pairs
    mean = (F.avg("dx") + F.avg("dy")) / 2
    var = (F.var_pop("dx") + F.var_pop("dy")) / 2 + F.pow(F.avg("dx") - F.avg("dy"), 2) / 4
    return (pairs.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_displacements"), mean.alias("mean_um"),
        F.sqrt(var).alias("gaussian_sigma_um"),
        F.when(m2 > 0, m4 / (2 * m2 * m2) - 1).alias("non_gaussian_alpha2"))
        .where(F.col("n_displacements") >= minimum))


def van_hove_histogram(tracks: DataFrame, pixel_size: float, lag: int = 1, bins: int = 80,
                       minimum: int = 50) -> DataFrame:
    """Density of single-axis displacements on ±(99.5th percentile of their size)."""
    pairs = with_enough(lag_pairs(tracks, lag, pixel_size, "contiguous")
                        .where(F.col("lag") == lag), minimum)
    axis = pairs.select("recording_id", F.explode(F.array("dx", "dy")).alias("d"))
    sigma = axis.groupBy("recording_id").agg(F.stddev_pop("d").alias("_sd"))
    limit = (quantiles(axis.withColumn("d", F.abs("d")), ["recording_id"], "d", {"_q": 0.995})
             .join(sigma, "recording_id")
             .select("recording_id", F.when(F.col("_q") > 0, F.col("_q"))
                     .otherwise(F.greatest(F.col("_sd") * 4, F.lit(1e-3))).alias("limit_um")))
    width = F.col("limit_um") * 2 / bins
    inside = (axis.join(limit, "recording_id").where(F.abs("d") <= F.col("limit_um"))
              .withColumn("bin", F.least(F.floor((F.col("d") + F.col("limit_um")) / width),
                                         F.lit(bins - 1)).cast("int")))
    counts = inside.groupBy("recording_id", "limit_um", "bin").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("recording_id").agg(F.sum("n").alias("_total"))
    return (counts.join(total, "recording_id")
            .select("recording_id", "bin", "n",
                    (-F.col("limit_um") + (F.col("bin") + 0.5) * width).alias("bin_center_um"),
                    (F.col("n") / (F.col("_total") * width)).alias("density")))


def velocity_autocorrelation(tracks: DataFrame, pixel_size: float, frame_interval: float,
                             max_lag: int = 10, minimum: int = 20) -> DataFrame:
    """Mean dot product of step velocities by the difference of their start
    frames, relative to lag zero."""
    scale = float(pixel_size) / float(frame_interval)
    v = unit_steps(tracks).select(*TRACK_KEY, "frame", (F.col("dx") * scale).alias("vx"),
                                  (F.col("dy") * scale).alias("vy"))
    both = look_ahead(v, max_lag, ("vx", "vy"))
    pair = both.select("recording_id", "frame", "vx", "vy", F.explode(F.concat(
        F.array(F.struct("frame", "vx", "vy")), "ahead")).alias("_w"))
    dots = (pair.groupBy("recording_id", (F.col("_w.frame") - F.col("frame")).alias("lag"))
            .agg(F.avg(F.col("vx") * F.col("_w.vx") + F.col("vy") * F.col("_w.vy")).alias("mean_dot"),
                 F.count(F.lit(1)).alias("n_pairs")))
    zero = (dots.where("lag = 0").where((F.col("n_pairs") >= minimum) & (F.col("mean_dot") > 0))
            .select("recording_id", F.col("mean_dot").alias("_zero"), F.col("n_pairs").alias("n_velocities")))
    return (dots.join(zero, "recording_id")
            .select("recording_id", F.col("lag").cast("int").alias("lag_frame"),
                    (F.col("lag") * F.lit(float(frame_interval))).alias("lag_s"),
                    (F.col("mean_dot") / F.col("_zero")).alias("vacf"), "n_pairs", "n_velocities"))


def turning_angles(tracks: DataFrame) -> DataFrame:
    """Signed angle between two consecutive single-frame steps, in degrees."""
    three = look_ahead(tracks, 2).where(F.size("ahead") == 2)
    b, c = F.col("ahead")[0], F.col("ahead")[1]
    ux, uy = b["x"] - F.col("x"), b["y"] - F.col("y")
    vx, vy = c["x"] - b["x"], c["y"] - b["y"]
    moved = ((ux != 0) | (uy != 0)) & ((vx != 0) | (vy != 0))
    return three.where(moved).select(
        *TRACK_KEY, "frame",
        F.degrees(F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)).alias("turning_angle_deg"))


def mobile_fraction_over_time(tracks: DataFrame, diffusion: DataFrame, frame_interval: float,
                              window: int = 100, d_threshold: float = MOBILE_D_THRESHOLD,
                              minimum: int = 5, keep_tail: bool = False) -> DataFrame:
    """Share of mobile tracks per window of frames; a track counts in the window
    of its mean frame. The last window ends below the highest frame when that is
    a multiple of the width, unless ``keep_tail``."""
    ends = tracks.groupBy("recording_id").agg(F.max("frame").alias("_max"))
    centre = tracks.groupBy(*TRACK_KEY).agg(F.avg("frame").alias("_mean"))
    judged = diffusion.where(is_mobile(d_threshold) | is_immobile(d_threshold)).select(
        *TRACK_KEY, is_mobile(d_threshold).alias("_mobile"))
    placed = (centre.join(judged, TRACK_KEY).join(ends, "recording_id")
              .withColumn("_w", F.floor(F.col("_mean") / window)))
    if not keep_tail:
        placed = placed.where(F.col("_w") * window < F.col("_max"))
    return (placed.groupBy("recording_id", "_w")
            .agg(F.count(F.lit(1)).alias("n_tracks"), F.count_if("_mobile").alias("_m"))
            .where(F.col("n_tracks") >= minimum)
            .select("recording_id", ((F.col("_w") * window + window / 2) * float(frame_interval)).alias("time_s"),
                    (F.col("_m") / F.col("n_tracks")).alias("mobile_fraction"), "n_tracks"))


def dwell_times(tracks: DataFrame, diffusion: DataFrame, frame_interval: float,
                n_frames: DataFrame | None = None) -> DataFrame:
    """Time confined and immobile tracks stay; ``censored`` when still there at
    the last frame. ``n_frames(recording_id, n_frames)`` gives the movie length."""
    dt = float(frame_interval)
    held = diffusion.where(F.col("motion").isin("Confined", "Immobile"))
    if n_frames is None:
        end = tracks.groupBy("recording_id").agg(F.max("frame").alias("_end"))
    else:
        end = n_frames.select("recording_id", (F.col("n_frames") - 1).alias("_end"))
    span = tracks.groupBy(*TRACK_KEY).agg(
        F.min("frame").alias("_a"), F.max("frame").alias("_b"), F.count(F.lit(1)).alias("n_observations"))
    return (span.join(held, TRACK_KEY, "left_semi").join(end, "recording_id")
            .select(*TRACK_KEY, ((F.col("_b") - F.col("_a") + 1) * dt).alias("dwell_time_s"),
                    (F.col("n_observations") * dt).alias("dwell_time_observed_s"),
                    "n_observations", (F.col("_b") >= F.col("_end")).alias("censored")))


def dwell_tau(dwell: DataFrame, minimum: int = 10) -> DataFrame:
    """Mean residence time under right-censoring."""
    ended = F.count_if(~F.col("censored"))
    return dwell.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_dwell"), F.count_if("censored").alias("n_censored"),
        F.when((F.count(F.lit(1)) >= minimum) & (ended > 0),
               F.sum("dwell_time_s") / ended).alias("dwell_tau_s"))
