"""The analysis of localisations, all recordings at once."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from lociflow.operators import (circular as C, clusters as U, detections as T, diffusion as D, drift as R, linking as L, roi as O,
                                states as H, steps as S, summary as M, tracks as K)
from lociflow.session import cut_lineage


@dataclass
class Params:
    """Settings of one analysis; calibration is required."""
    pixel_size: float
    frame_interval: float
    linker: str = L.DEFAULT_LINKER
    search_range: float = 5.0
    memory: int = 3
    min_len: int = 5
    max_len: int | None = None
    max_lag: int = 20
    n_fit: int = 5
    gap_policy: str = "all_pairs"
    d_threshold: float = 0.02
    d_range: tuple[float | None, float | None] | None = None
    drift: str | None = None
    cluster_eps_um: float | None = None
    cluster_min_samples: int = 5
    states: bool = False
    link_params: dict = field(default_factory=dict)


def run(locs: DataFrame, params: Params, rois: DataFrame | None = None) -> dict[str, DataFrame]:
    """Localisations → tracks → per-track, per-step and per-recording tables.

    Tracks and per-track curves are read many times, so they are written once to
    the shared folder; everything after them is lazy. ``locs`` that already carry
    ``particle`` are analysed as they are.
    """
    p, px, dt = params, params.pixel_size, params.frame_interval
    out: dict[str, DataFrame] = {}
    locs = K.valid_localisations(locs)
    if rois is not None:
        locs = O.roi_polygon_filter(locs, rois)
    if p.drift:
        locs, out["drift"] = R.correct_drift(locs, method=p.drift)
        locs = cut_lineage(locs)
    locs = T.attach_loc_sigma(locs, px) if "ep" in locs.columns else locs
    linked = K.filter_track_length(locs, p.min_len, p.max_len) if "particle" in locs.columns else L.link(
        locs, p.linker, p.search_range, p.memory, p.min_len, p.max_len, **p.link_params)
    tracks = cut_lineage(K.canonical_tracks(linked))
    msd = cut_lineage(D.track_msd(tracks, px, p.max_lag, p.gap_policy))
    diffusion = cut_lineage(D.diffusion_table(tracks, px, dt, p.max_lag, p.n_fit, p.gap_policy, msd=msd))
    if p.d_range:
        tracks, out["d_filter_audit"] = K.filter_by_d(tracks, diffusion, *p.d_range)
        tracks = cut_lineage(tracks)
        msd, diffusion = K.keep_tracks(msd, tracks), K.keep_tracks(diffusion, tracks)
    angles, jumps = S.turning_angles(tracks), S.jump_distances(tracks, px)
    dwell = S.dwell_times(tracks, diffusion, dt)
    qc = M.qc_metrics(tracks, diffusion, locs)
    if p.drift:
        qc = qc.join(R.drift_span_nm(out["drift"], px), "recording_id", "left")
    out |= {
        "tracks": tracks, "track_msd": msd, "diffusion": diffusion, "ensemble_msd": D.ensemble_from_tracks(msd, p.max_lag),
        "moment_scaling": D.moment_scaling(tracks, px, dt, gap_policy=p.gap_policy), "turning_angles": angles,
        "circular": C.circular_stats(angles), "jdd": H.jdd_fit(jumps, dt), "van_hove": S.van_hove(tracks, px),
        "vacf": S.velocity_autocorrelation(tracks, px, dt), "dwell": dwell, "dwell_tau": S.dwell_tau(dwell),
        "mobile_fraction": S.mobile_fraction_over_time(tracks, diffusion, dt, d_threshold=p.d_threshold),
        "summary": M.summary_metrics(tracks, diffusion, locs, dt, p.d_threshold), "qc": M.qc_flags(qc)}
    if p.states:
        out["states"] = cut_lineage(H.diffusive_states(tracks, px, dt))
    if p.cluster_eps_um:
        um = locs.select("recording_id", "loc_id", (F.col("x") * px).alias("x"), (F.col("y") * px).alias("y"))
        out["clusters"] = cut_lineage(U.dbscan(um, p.cluster_eps_um, p.cluster_min_samples))
        out["cluster_stats"] = U.cluster_stats(out["clusters"])
    out["replicates"] = M.replicate_table(tracks, diffusion, px, dt, p.d_threshold, out.get("states"))
    return out


def backfill_geometry(old: DataFrame, tracks: DataFrame, pixel_size: float, frame_interval: float) -> DataFrame:
    """Fill the geometry an earlier run lacks. Runs of the first schema took every
    observed link as a step."""
    new = D.track_geometry(tracks, pixel_size, frame_interval)
    names = [c for c in new.columns if c not in ("recording_id", "particle")]
    j = old.join(new.select("recording_id", "particle", *[F.col(c).alias(f"_{c}") for c in names]), ["recording_id", "particle"], "left")
    schema = F.col("metrics_schema_version") if "metrics_schema_version" in old.columns else F.lit(1)
    value = {c: F.col(f"_{c}") for c in names}
    value["mean_step_um"] = F.when(schema < 2, F.col("_mean_link_displacement_um")).otherwise(F.col("_mean_step_um"))
    return j.withColumns({c: F.coalesce(F.col(c), v) if c in old.columns else v for c, v in value.items()}).drop(*[f"_{c}" for c in names])


def interp_curve(curve: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """``(by…, x, y)`` of a curve on other abscissae, linear in between and held at
    the ends. A curve has a bounded number of lags or bins, so it travels as one
    array."""
    pts = F.array_sort(F.collect_list(F.when(F.col("y").isNotNull(), F.struct("x", "y"))))
    one = curve.groupBy(*by).agg(pts.alias("_p"))
    g = F.col("x")
    below = F.filter("_p", lambda s: s["x"] <= g)
    above = F.filter("_p", lambda s: s["x"] >= g)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    mixed = a["y"] + F.try_divide(g - a["x"], b["x"] - a["x"]) * (b["y"] - a["y"])
    return grid.join(one, by).select(*by, "x", F.when(a.isNull(), b["y"]).when(b.isNull() | (b["x"] == a["x"]), a["y"]).otherwise(mixed).alias("y"))


def reanalyse(saved: DataFrame, rois: DataFrame, params: Params) -> dict[str, DataFrame]:
    """A finished run again, on part of its localisations."""
    return run(saved.drop("particle"), params, rois)
