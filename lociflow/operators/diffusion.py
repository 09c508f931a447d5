"""Mean-squared displacement, diffusion fits and track geometry."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from lociflow.functions.distribution import medians
from lociflow.operators.lags import adjacent_links, lag_pairs
from lociflow.operators.tracks import classify_motion, is_immobile, is_mobile
from lociflow.schema import (ALPHA_LIMIT_TOL, ALPHA_THRESHOLDS, D_FLOOR, MOBILE_D_THRESHOLD,
                             MOTION_CLASSES, TRACK_KEY, require_positive)

def squared() -> Column:
    return F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")


def track_msd(tracks: DataFrame, pixel_size: float, max_lag: int = 20,
              gap_policy: str = "all_pairs") -> DataFrame:
    """``(recording_id, particle, lag, msd, n_pairs)``."""
    require_positive("pixel_size", pixel_size)
    return (lag_pairs(tracks, max_lag, pixel_size, gap_policy).groupBy(*TRACK_KEY, "lag")
            .agg(F.avg(squared()).alias("msd"), F.count(F.lit(1)).alias("n_pairs")))


def ensemble_msd(tracks: DataFrame, pixel_size: float, max_lag: int = 20,
                 gap_policy: str = "all_pairs") -> DataFrame:
    """Mean over every displacement pair of a recording, per lag; a lag nobody
    reached is present with a NULL."""
    require_positive("pixel_size", pixel_size)
    seen = (lag_pairs(tracks, max_lag, pixel_size, gap_policy).groupBy("recording_id", "lag")
            .agg(F.avg(squared()).alias("msd_um2"), F.count(F.lit(1)).alias("n_pairs")))
    return _complete_lags(seen, max_lag)


def ensemble_from_tracks(msd: DataFrame, max_lag: int = 20, weighted: bool = True) -> DataFrame:
    """The ensemble curve from per-track curves: weighted by pairs, or each track
    alike as imported curve files define it."""
    mean = (F.sum(F.col("msd") * F.col("n_pairs")) / F.sum("n_pairs")) if weighted else F.avg("msd")
    n = F.sum("n_pairs") if "n_pairs" in msd.columns else F.count(F.lit(1))
    return _complete_lags(msd.groupBy("recording_id", "lag")
                          .agg(mean.alias("msd_um2"), n.alias("n_pairs")), max_lag)


def _complete_lags(curve: DataFrame, max_lag: int) -> DataFrame:
    points = F.map_from_entries(F.collect_list(
        F.struct("lag", F.struct("msd_um2", "n_pairs"))))
    return (curve.groupBy("recording_id").agg(points.alias("_m"))
            .select("recording_id", "_m", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag_frame"))
            .select("recording_id", "lag_frame",
                    F.try_element_at("_m", F.col("lag_frame"))["msd_um2"].alias("msd_um2"),
                    F.coalesce(F.try_element_at("_m", F.col("lag_frame"))["n_pairs"], F.lit(0))
                    .alias("n_pairs")))


def msd_auc(curve: DataFrame, frame_interval: float, by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Trapezoid area under the lags that have a value; NULL for fewer than two."""
    order = W.partitionBy(*by).orderBy("lag_frame")
    t = F.col("lag_frame") * F.lit(float(frame_interval))
    have = curve.where(F.col("msd_um2").isNotNull())
    area = have.select(*by, ((t - F.lag(t).over(order))
                             * (F.col("msd_um2") + F.lag("msd_um2").over(order)) / 2).alias("_a"))
    return area.groupBy(*by).agg(F.sum("_a").alias("msd_auc"))


def fit_linear_d(msd: DataFrame, frame_interval: float, n_fit: int = 5) -> DataFrame:
    """D from the slope of the first ``n_fit`` lags with a free intercept.

    ``curve`` keeps those lags (a bounded array) for the anomalous fit. The sums of
    the fit run over it in order of lag, so they do not depend on partitioning; a
    slope within their rounding error of zero is none.
    """
    require_positive("frame_interval", frame_interval)
    early = (F.col("lag") <= n_fit) & F.col("msd").isNotNull()
    points = msd.groupBy(*TRACK_KEY).agg(
        F.max("msd").alias("_peak"),
        F.array_sort(F.collect_list(F.when(early, F.struct("lag", "msd")))).alias("_sorted"))
    n = F.size("_sorted")

    def total(value) -> Column:
        return F.aggregate("_sorted", F.lit(0.0), lambda s, p: s + value(p))

    def t(p) -> Column:
        return p["lag"] * F.lit(float(frame_interval))
    means = points.select(
        "*", n.alias("n_lags"), F.array_max(F.transform("_sorted", lambda p: p["msd"])).alias("_early_peak"),
        F.try_divide(total(t), n).alias("_t"), F.try_divide(total(lambda p: p["msd"]), n).alias("_m"))
    sums = means.select(
        "*", total(lambda p: F.pow(t(p) - F.col("_t"), 2)).alias("_sxx"),
        total(lambda p: (t(p) - F.col("_t")) * (p["msd"] - F.col("_m"))).alias("_sxy"),
        total(lambda p: F.pow(p["msd"] - F.col("_m"), 2)).alias("_syy"),
        F.map_from_entries("_sorted").alias("_points"))
    still = F.col("_peak") == 0
    fitted = ~still & (F.col("n_lags") >= 3) & (F.col("_early_peak") > 0)
    rounding = F.lit(64 * 2.0 ** -52) * F.sqrt(F.col("_sxx") * n) * F.col("_early_peak")
    sxy = F.when(F.abs("_sxy") > rounding, F.col("_sxy")).otherwise(0.0)
    slope = F.try_divide(sxy, F.col("_sxx"))
    raw = F.when(fitted, slope / 4)
    sse = F.greatest(F.col("_syy") - sxy * slope, F.lit(0.0))
    return sums.select(
        *TRACK_KEY, "n_lags",
        F.when(raw > 0, raw).alias("D"), raw.alias("D_linear_raw"),
        F.when(fitted, F.col("_m") - slope * F.col("_t")).alias("MSD0"),
        F.when(still, F.lit(0.0)).when(fitted, sse / F.col("n_lags")).alias("MSE"),
        F.when(still, "below_resolution").when(raw > 0, "fit").when(fitted, "nonpositive_slope")
        .otherwise("insufficient_lags").alias("fit_status"),
        F.transform(F.sequence(F.lit(1), F.lit(n_fit)),
                    lambda k: F.try_element_at("_points", k)).alias("curve"))


# Exponent grids: a coarse one over 0…4 and a fine one around its best point.
# Exponents above two only tell a ballistic track from one that ran into the bound.
COARSE_STEP, FINE_STEP = 0.05, 0.001

_ALPHA_FIT = T.StructType([
    T.StructField("alpha", T.DoubleType()), T.StructField("K_alpha", T.DoubleType()),
    T.StructField("alpha_MSD0", T.DoubleType()), T.StructField("alpha_MSE", T.DoubleType()),
    T.StructField("alpha_free", T.DoubleType())])


def _profile(curves: np.ndarray, seen: np.ndarray, powers: np.ndarray):
    """Least squares of msd on 4K·u + c for every exponent, u = t^alpha given as
    ``powers``: (exponent, lag) shared, or (track, exponent, lag). Returns the
    residual sum, K and c as (track, exponent)."""
    w = seen.astype(float)
    n = w.sum(1)[:, None]
    if powers.ndim == 2:
        su, suu, suy = w @ powers.T, w @ (powers ** 2).T, curves @ powers.T
    else:
        su = np.einsum("tl,tal->ta", w, powers)
        suu = np.einsum("tl,tal->ta", w, powers ** 2)
        suy = np.einsum("tl,tal->ta", curves, powers)
    sy = curves.sum(1)[:, None]
    cy = curves - (sy / n) * w
    var_u = suu - su ** 2 / n
    cov = suy - su * sy / n
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(var_u > 1e-14, cov / var_u, 0.0)
    slope = np.maximum(slope, 0.0)
    icpt = (sy - slope * su) / n
    sse = (cy ** 2).sum(1)[:, None] - 2 * slope * cov + slope ** 2 * var_u
    return np.maximum(sse, 0.0), slope / 4.0, icpt


def _best_exponent(curves, seen, t, low, high):
    coarse = np.round(np.arange(round(low / COARSE_STEP), round(high / COARSE_STEP) + 1) * COARSE_STEP, 6)
    sse, _, _ = _profile(curves, seen, t[None, :] ** coarse[:, None])
    centre = coarse[np.argmin(sse, axis=1)]
    reach = round(COARSE_STEP / FINE_STEP)
    fine = np.round(centre[:, None] + np.arange(-reach, reach + 1)[None, :] * FINE_STEP, 6)
    fine = np.clip(fine, low, high)
    sse, k, c = _profile(curves, seen, t[None, None, :] ** fine[:, :, None])
    pick = np.argmin(sse, axis=1)
    row = np.arange(len(curves))
    return fine[row, pick], k[row, pick], c[row, pick], sse[row, pick]


def fit_anomalous(fits: DataFrame, frame_interval: float,
                  thresholds=ALPHA_THRESHOLDS) -> DataFrame:
    """Add the exponent of ``4·K·t^alpha + c``, its status and the motion class.

    For a fixed exponent the model is linear, so each batch of tracks is profiled
    over an exponent grid with matrix products.
    """
    dt = float(frame_interval)

    @F.pandas_udf(_ALPHA_FIT)
    def fit(curve: pd.Series) -> pd.DataFrame:
        y = np.array([np.asarray(c, dtype=float) for c in curve], dtype=float)
        out = np.full((len(y), 5), np.nan)
        seen = np.isfinite(y)
        usable = seen.sum(1) >= 4
        if usable.any():
            t = np.arange(1, y.shape[1] + 1) * dt
            yy, ss = np.where(seen, y, 0.0)[usable], seen[usable]
            for lo in range(0, len(yy), 4096):
                part = slice(lo, lo + 4096)
                alpha, k, c, sse = _best_exponent(yy[part], ss[part], t, 0.0, 2.0)
                free = _best_exponent(yy[part], ss[part], t, 0.0, 4.0)[0]
                rows = np.flatnonzero(usable)[part]
                out[rows] = np.column_stack([alpha, k, c, sse / ss[part].sum(1), free])
        table = pd.DataFrame(out, columns=[f.name for f in _ALPHA_FIT])
        return table.astype(object).where(np.isfinite(out), None)

    tried = F.col("fit_status").isin("fit", "nonpositive_slope") & (F.col("n_lags") >= 4)
    seen = F.filter("curve", lambda v: v.isNotNull())
    lags_seen = F.filter(F.transform("curve", lambda v, i: F.when(v.isNotNull(), i + 1)),
                         lambda v: v.isNotNull())
    df = fits.withColumn("_a", F.when(tried, fit("curve")))
    alpha, k = F.col("_a.alpha"), F.col("_a.K_alpha")
    t0 = F.try_element_at(lags_seen, F.lit(1)) * dt
    t1 = F.try_element_at(lags_seen, F.lit(-1)) * dt
    rise = 4 * k * (F.pow(t1, alpha) - F.pow(t0, alpha))
    scale = F.greatest(F.array_max(F.transform(seen, F.abs)), F.lit(2.2250738585072014e-308))
    flat = rise / scale < 0.10
    stuck = (alpha < ALPHA_LIMIT_TOL) | ((alpha > 2 - ALPHA_LIMIT_TOL)
                                         & (F.col("_a.alpha_free") > 2 + ALPHA_LIMIT_TOL))
    status = (F.when(F.col("fit_status") == "below_resolution", "below_resolution")
              .when(~tried, "insufficient_lags").when(flat, "offset_dominated")
              .when(stuck, "at_limit").otherwise("descriptive_fit"))
    df = df.withColumn("alpha_fit_status", status)
    kept = F.when(F.col("alpha_fit_status") == "descriptive_fit", alpha)
    return (df.withColumn("alpha", kept)
            .withColumn("K_alpha", k).withColumn("alpha_MSD0", F.col("_a.alpha_MSD0"))
            .withColumn("alpha_MSE", F.col("_a.alpha_MSE"))
            .withColumn("motion", F.when(F.col("alpha_fit_status") == "offset_dominated", "Immobile")
                        .otherwise(classify_motion(F.col("alpha"), thresholds)))
            .drop("_a"))


def track_geometry(tracks: DataFrame, pixel_size: float, frame_interval: float) -> DataFrame:
    """Spread, path and duration of each track; NULL where one observation
    cannot tell."""
    px, dt = require_positive("pixel_size", pixel_size), require_positive("frame_interval", frame_interval)
    # one min_by/max_by per coordinate keeps the aggregation hashed
    whole = tracks.groupBy(*TRACK_KEY).agg(
        F.count(F.lit(1)).alias("n_observations"), F.avg("x").alias("_cx"), F.avg("y").alias("_cy"),
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.min_by("x", "frame").alias("_ax"), F.min_by("y", "frame").alias("_ay"),
        F.max_by("x", "frame").alias("_bx"), F.max_by("y", "frame").alias("_by"),
        (F.sqrt(F.var_pop("x") + F.var_pop("y")) * px).alias("radius_of_gyration_um"))
    d2 = (F.pow((F.col("x") - F.col("_cx")) * px, 2) + F.pow((F.col("y") - F.col("_cy")) * px, 2))
    spread = (tracks.join(whole.select(*TRACK_KEY, "_cx", "_cy"), TRACK_KEY)
              .groupBy(*TRACK_KEY)
              .agg(F.avg(F.sqrt(d2)).alias("mean_radial_displacement_um")))
    size, unit = F.sqrt(squared()), F.col("gap") == 1
    path = adjacent_links(tracks, px).groupBy(*TRACK_KEY).agg(
        F.sum(size).alias("path_length_um"), F.avg(size).alias("mean_link_displacement_um"),
        F.avg(size / (F.col("gap") * dt)).alias("mean_link_speed_um_s"),
        F.avg(F.when(unit, size)).alias("mean_step_um"),
        F.count_if(unit).alias("_units"))
    net = F.when(F.col("n_observations") >= 2, F.hypot((F.col("_bx") - F.col("_ax")) * px,
                                                       (F.col("_by") - F.col("_ay")) * px))
    return (whole.join(spread, TRACK_KEY).join(path, TRACK_KEY, "left").select(
        *TRACK_KEY, "n_observations", "first_frame", "last_frame",
        "mean_radial_displacement_um", "radius_of_gyration_um", "path_length_um",
        "mean_link_displacement_um", "mean_link_speed_um_s", "mean_step_um",
        F.coalesce("_units", F.lit(0)).alias("n_single_frame_steps"),
        ((F.col("last_frame") - F.col("first_frame")) * dt).alias("track_duration_s"),
        net.alias("net_displacement_um"),
        F.when(F.col("path_length_um") > 0, net / F.col("path_length_um"))
        .when(F.col("path_length_um") == 0, 0.0).alias("directionality_ratio")))


def track_precision(tracks: DataFrame, pixel_size: float) -> DataFrame:
    """Mean localisation precision per track, from whichever columns exist."""
    aggs = []
    if "ep" in tracks.columns:
        aggs.append((F.avg("ep") * pixel_size * 1000).alias("loc_precision_nm"))
    if {"loc_sigma_x_nm", "loc_sigma_y_nm"} <= set(tracks.columns):
        aggs.append(F.avg(F.hypot("loc_sigma_x_nm", "loc_sigma_y_nm") / F.sqrt(F.lit(2.0)))
                    .alias("loc_sigma_meas_nm"))
    if not aggs:
        return tracks.select(*TRACK_KEY).distinct()
    return tracks.groupBy(*TRACK_KEY).agg(*aggs)


def diffusion_table(tracks: DataFrame, pixel_size: float, frame_interval: float,
                    max_lag: int = 20, n_fit: int = 5, gap_policy: str = "all_pairs",
                    thresholds=ALPHA_THRESHOLDS, msd: DataFrame | None = None) -> DataFrame:
    """One row per track: fits, motion class, geometry, durations, precision."""
    n_fit = min(n_fit, max_lag)
    if msd is None:
        msd = track_msd(tracks, pixel_size, max_lag, gap_policy)
    fits = fit_anomalous(fit_linear_d(msd, frame_interval, n_fit), frame_interval, thresholds)
    out = (track_geometry(tracks, pixel_size, frame_interval)
           .join(fits.drop("n_lags", "curve"), TRACK_KEY, "left")
           .withColumn("fit_status", F.coalesce("fit_status", F.lit("insufficient_lags")))
           .withColumn("alpha_fit_status", F.coalesce("alpha_fit_status", F.lit("insufficient_lags")))
           .withColumn("motion", F.coalesce("motion", F.lit("Unknown")))
           .withColumn("msd_offset_scale_nm", F.when(F.col("MSD0") > 0, F.sqrt(F.col("MSD0") / 4) * 1000))
           .withColumn("loc_sigma_nm", F.lit(None).cast("double"))
           .withColumn("D_model", F.lit("linear_msd_with_intercept"))
           .withColumn("K_alpha_units", F.lit("um^2/s^alpha"))
           .withColumn("precision_status", F.lit("not_calibrated")))
    precision = track_precision(tracks, pixel_size)
    return out.join(precision, TRACK_KEY, "left") if len(precision.columns) > 2 else out


def track_durations(tracks: DataFrame, frame_interval: float) -> DataFrame:
    dt = require_positive("frame_interval", frame_interval)
    return tracks.groupBy(*TRACK_KEY).agg(
        ((F.max("frame") - F.min("frame")) * dt).alias("track_duration_s"),
        (F.count(F.lit(1)) * dt).alias("observed_time_s"))


def moment_scaling(tracks: DataFrame, pixel_size: float, frame_interval: float,
                   max_lag: int = 10, gap_policy: str = "all_pairs") -> DataFrame:
    """Slope of the moment scaling spectrum of every track with six or more
    observations and four or more usable lags."""
    r, orders = F.sqrt(squared()), (1, 2, 3, 4)
    moments = (lag_pairs(tracks, max_lag, pixel_size, gap_policy).groupBy(*TRACK_KEY, "lag")
               .agg(*[F.avg(F.pow(r, F.lit(float(q)))).alias(f"m{q}") for q in orders]))
    log_t = F.log(F.col("lag") * F.lit(float(frame_interval)))
    scaling = moments.groupBy(*TRACK_KEY).agg(
        F.count(F.lit(1)).alias("_lags"),
        *[F.regr_slope(F.log(F.col(f"m{q}") + 1e-15), log_t).alias(f"g{q}") for q in orders])
    slope = sum((F.col(f"g{q}") * (q - 2.5) for q in orders), F.lit(0.0)) / 5.0
    long_enough = tracks.groupBy(*TRACK_KEY).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 6")
    return (scaling.where("_lags >= 4").join(long_enough, TRACK_KEY, "left_semi")
            .select(*TRACK_KEY, slope.alias("mss_slope")))


def _pinned_d(floor: float = D_FLOOR) -> Column:
    return (F.when(F.col("fit_status") == "nonpositive_slope", F.lit(float(floor)))
            .when(F.col("D") > 0, F.greatest(F.col("D"), F.lit(float(floor)))))


def mobility_summary(diffusion: DataFrame, d_threshold: float = MOBILE_D_THRESHOLD,
                     floor: float = D_FLOOR) -> DataFrame:
    """Median D, mobile fraction and ratio, and shares of the four motion classes."""
    counts = diffusion.groupBy("recording_id").agg(
        F.count_if(is_mobile(d_threshold)).alias("n_mobile"),
        F.count_if(is_immobile(d_threshold)).alias("n_immobile"),
        *[F.count_if(F.col("motion") == m).alias(m) for m in MOTION_CLASSES])
    classified = sum((F.col(m) for m in MOTION_CLASSES), F.lit(0))
    mid = medians(diffusion, ["recording_id"], {"median_d": _pinned_d(floor), "median_alpha": F.col("alpha")})
    return counts.join(mid, "recording_id", "left").select(
        "recording_id", "median_d", "median_alpha", "n_mobile", "n_immobile",
        F.try_divide("n_mobile", F.col("n_mobile") + F.col("n_immobile")).alias("mobile_fraction"),
        F.try_divide("n_mobile", "n_immobile").alias("mob_immob_ratio"),
        *[F.try_divide(F.col(m), classified).alias(f"frac_{m.lower()}") for m in MOTION_CLASSES])
