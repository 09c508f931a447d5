"""Validation, selection and identity of trajectories."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lociflow.functions.distribution import distribution
from lociflow.schema import (ALPHA_THRESHOLDS, D_FLOOR, MOBILE_D_THRESHOLD, TRACK_KEY,
                             ContractError, require_columns)


def duplicate_observations(tracks: DataFrame) -> DataFrame:
    """(recording, particle, frame) keys that occur more than once, with counts."""
    require_columns(tracks, *TRACK_KEY, "frame")
    return (tracks.groupBy(*TRACK_KEY, "frame").agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1"))


def canonical_tracks(tracks: DataFrame) -> DataFrame:
    """The input, or an error naming up to three branched observations. Order is
    not materialised: every operator orders by frame where it needs to."""
    require_columns(tracks, *TRACK_KEY, "frame", "x", "y")
    sample = duplicate_observations(tracks).limit(3).collect()
    if sample:
        named = ", ".join(f"({r.recording_id!r}, {r.particle!r}, {r.frame!r})" for r in sample)
        raise ContractError(f"several localisations share one particle and frame: {named}")
    return tracks


def valid_localisations(locs: DataFrame) -> DataFrame:
    require_columns(locs, "frame", "x", "y")
    return locs.where(F.col("frame") >= 0)


def track_lengths(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy(*TRACK_KEY).agg(F.count(F.lit(1)).alias("n_observations"))


def filter_track_length(tracks: DataFrame, min_len: int = 2,
                        max_len: int | None = None) -> DataFrame:
    n = F.col("n_observations")
    keep = n >= min_len if max_len is None else n.between(min_len, max_len)
    return tracks.join(track_lengths(tracks).where(keep).hint("merge"), TRACK_KEY, "left_semi")


def keep_tracks(tracks: DataFrame, keep: DataFrame) -> DataFrame:
    return tracks.join(keep, TRACK_KEY, "left_semi")


def drop_tracks(tracks: DataFrame, dropped: DataFrame) -> DataFrame:
    return tracks.join(dropped, TRACK_KEY, "left_anti")


def dense_ids(df: DataFrame, by: list[str], key: str, out: str) -> DataFrame:
    """Number the distinct values of ``key`` 0, 1, … inside each group."""
    ids = distribution(df.select(*by, key).distinct(), by, key)
    return df.join(ids.select(*by, F.col("value").alias(key), F.col("n_below").alias(out)).hint("merge"), [*by, key])


def accept_prelinked(locs: DataFrame, track_column: str = "track", min_len: int = 1,
                     max_len: int | None = None) -> DataFrame:
    """Take over the track ids of an imported table: rows without a track or with
    a negative one are unlinked and drop out; ids become dense per recording."""
    linked = (locs.withColumn("_track", F.col(track_column).cast("string").try_cast("double").cast("long"))
              .where(F.col("_track") >= 0))
    dense = dense_ids(linked, ["recording_id"], "_track", "particle").drop("_track")
    return filter_track_length(dense, min_len, max_len)


def filter_by_d(tracks: DataFrame, diffusion: DataFrame, d_min: float | None = None,
                d_max: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Tracks whose D lies in the range, and per recording what was excluded.
    Curves and fits have to be computed again on what is kept."""
    d = F.col("D")
    keep = d.isNotNull()
    if d_min is not None:
        keep = keep & (d >= d_min)
    if d_max is not None:
        keep = keep & (d <= d_max)
    audit = diffusion.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_tracks_before_d_filter"),
        F.count_if(~keep).alias("n_tracks_excluded_by_d_filter"),
        F.count_if(~keep & (F.col("fit_status") == "below_resolution"))
        .alias("n_below_resolution_excluded_by_d_filter"),
        F.count_if(~keep & (F.col("fit_status") == "nonpositive_slope"))
        .alias("n_nonpositive_slope_excluded_by_d_filter"))
    return keep_tracks(tracks, diffusion.where(keep)), audit


def classify_motion(alpha: Column, thresholds=ALPHA_THRESHOLDS) -> Column:
    immobile, confined, directed = thresholds
    return (F.when(alpha.isNull(), "Unknown").when(alpha < immobile, "Immobile")
            .when(alpha < confined, "Confined").when(alpha < directed, "Brownian")
            .otherwise("Directed"))


def is_mobile(d_threshold: float = MOBILE_D_THRESHOLD) -> Column:
    return F.coalesce((F.col("D") > 0) & (F.col("D") >= d_threshold), F.lit(False))


def is_immobile(d_threshold: float = MOBILE_D_THRESHOLD) -> Column:
    """Slower than the threshold, or no net rise of the curve at all."""
    return (F.coalesce((F.col("D") > 0) & (F.col("D") < d_threshold), F.lit(False))
            | F.coalesce(F.col("fit_status") == "nonpositive_slope", F.lit(False)))


def log_d_clip(d: Column, low: float = D_FLOOR, high: float = 100.0) -> Column:
    """log10 D held inside the range; NULL unless D is positive."""
    return F.when(d > 0, F.least(F.greatest(F.log10(d), F.log10(F.lit(low))), F.log10(F.lit(high))))


def explore_tracks(diffusion: DataFrame, length: tuple[int, int] | None = None,
                   d_range: tuple[float, float] | None = None,
                   alpha_range: tuple[float, float] | None = None,
                   motions: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The track table as a user narrows it; unknown D and alpha always pass.
    With ``limit``, its first rows by key."""
    out = diffusion
    if length:
        out = out.where(F.col("n_observations").between(*length))
    for name, bounds in (("D", d_range), ("alpha", alpha_range)):
        if bounds:
            out = out.where(F.col(name).isNull() | F.col(name).between(*bounds))
    if motions:
        out = out.where(F.col("motion").isin(motions))
    return out.orderBy(*TRACK_KEY).limit(limit) if limit else out
