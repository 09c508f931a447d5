"""Queries over trajectories: selection, lags, diffusion, steps."""
from __future__ import annotations

from pyspark.sql import functions as F

from lociflow import recipes as V
from lociflow.operators import diffusion as D, lags, steps as S, tracks as K
from lociflow.plans.catalog import query, r, rounded, rs
from lociflow.plans.sql_views import (ALPHA, DIFFUSION, FIT, GEOMETRY, MSD, PAIRS, STEPS)
from lociflow.recipes import FRAME_INTERVAL as DT, PIXEL_SIZE as PX, SQL_OBSERVATIONS, SQL_TRACKS


def diffusion(spark, d, **kw):
    return D.diffusion_table(V.stored_tracks(spark, d), PX, DT, **kw)


@query("ensemble_msd", f"""WITH {PAIRS}
SELECT rec.recording_id, CAST(l.lag AS INTEGER) AS lag_frame, {r('avg(dx*dx + dy*dy)')} AS msd_um2,
       count(dx) AS n_pairs
FROM (SELECT DISTINCT recording_id FROM pairs) rec CROSS JOIN (SELECT unnest(range(1, 21)) AS lag) l
LEFT JOIN pairs p ON p.recording_id = rec.recording_id AND p.lag = l.lag GROUP BY ALL""")
def ensemble_msd(spark, d):
    return rounded(D.ensemble_msd(V.tracks(spark, d), PX))


@query("track_msd", f"WITH {MSD} SELECT recording_id, particle, lag, {rs('msd')}, n_pairs FROM msd")
def track_msd(spark, d):
    return rounded(D.track_msd(V.tracks(spark, d), PX))


@query("track_msd_contiguous", f"""WITH {PAIRS},
numbered AS (SELECT recording_id, particle, frame, row_number() OVER (
               PARTITION BY recording_id, particle ORDER BY frame) AS rn FROM tracks),
kept AS (SELECT p.* FROM pairs p JOIN numbered a USING (recording_id, particle, frame)
         JOIN numbered b ON b.recording_id = p.recording_id AND b.particle = p.particle
                        AND b.frame = p.frame + p.lag WHERE b.rn - a.rn = p.lag)
SELECT recording_id, particle, lag, {r('avg(dx*dx + dy*dy)')} AS msd, count(*) AS n_pairs
FROM kept GROUP BY ALL""")
def track_msd_contiguous(spark, d):
    return rounded(D.track_msd(V.tracks(spark, d), PX, gap_policy="contiguous"))


@query("lag_pairs", f"WITH {PAIRS} SELECT recording_id, particle, frame, lag, {rs('dx', 'dy')} FROM pairs")
def lag_pairs(spark, d):
    return rounded(lags.lag_pairs(V.tracks(spark, d), 20, PX))


@query("fit_linear_d", f"""WITH {FIT} SELECT recording_id, particle, n_lags, fit_status,
{rs('D', 'D_linear_raw', 'MSD0', 'MSE')} FROM fit""")
def fit_linear_d(spark, d):
    fits = D.fit_linear_d(D.track_msd(V.tracks(spark, d), PX), DT)
    return rounded(fits.drop("curve"))


@query("fit_anomalous", f"""WITH {ALPHA} SELECT recording_id, particle, alpha_fit_status, motion,
{rs('alpha', digits=3)}, {rs('K_alpha', 'alpha_MSD0', 'alpha_MSE', digits=4)} FROM anomalous""")
def fit_anomalous(spark, d):
    fits = D.fit_anomalous(D.fit_linear_d(D.track_msd(V.tracks(spark, d), PX), DT), DT)
    out = fits.select("recording_id", "particle", "alpha_fit_status", "motion", "alpha",
                      "K_alpha", "alpha_MSD0", "alpha_MSE")
    return rounded(rounded(out, "alpha", digits=3), "K_alpha", "alpha_MSD0", "alpha_MSE", digits=4)


_GEO = ("mean_radial_displacement_um", "radius_of_gyration_um", "path_length_um",
        "mean_link_displacement_um", "mean_link_speed_um_s", "mean_step_um", "track_duration_s",
        "net_displacement_um", "directionality_ratio")


@query("track_geometry", f"""WITH {SQL_TRACKS}{GEOMETRY} SELECT recording_id, particle, n_observations,
first_frame, last_frame, n_single_frame_steps, {rs(*_GEO)} FROM geometry""")
def track_geometry(spark, d):
    return rounded(D.track_geometry(V.tracks(spark, d), PX, DT))


@query("diffusion_table", f"""WITH {DIFFUSION} SELECT recording_id, particle, n_observations, first_frame,
last_frame, n_single_frame_steps, fit_status, alpha_fit_status, motion, {rs(*_GEO)},
{rs('D', 'D_linear_raw', 'MSD0', 'MSE')}, {rs('alpha', digits=3)} FROM diffusion""")
def diffusion_table(spark, d):
    out = diffusion(spark, d).select(
        "recording_id", "particle", "n_observations", "first_frame", "last_frame",
        "n_single_frame_steps", "fit_status", "alpha_fit_status", "motion", *_GEO, "D",
        "D_linear_raw", "MSD0", "MSE", "alpha")
    return rounded(rounded(out, *_GEO, "D", "D_linear_raw", "MSD0", "MSE"), "alpha", digits=3)


@query("track_durations", f"""WITH {SQL_TRACKS} SELECT recording_id, particle,
CAST(max(frame) - min(frame) AS DOUBLE) AS track_duration_s, CAST(count(*) AS DOUBLE) AS observed_time_s
FROM tracks GROUP BY ALL""")
def track_durations(spark, d):
    return D.track_durations(V.tracks(spark, d), DT)


@query("track_precision", f"""WITH {SQL_TRACKS} SELECT recording_id, particle,
{r('avg(y / 100) * 0.01 * 1000')} AS loc_precision_nm,
{r('avg(sqrt(x * x + y * y) / sqrt(2))')} AS loc_sigma_meas_nm FROM tracks GROUP BY ALL""")
def track_precision(spark, d):
    t = V.tracks(spark, d).withColumns({
        "ep": F.col("y") / 100, "loc_sigma_x_nm": F.col("x"), "loc_sigma_y_nm": F.col("y")})
    return rounded(D.track_precision(t, PX))


@query("msd_auc", f"""WITH {PAIRS},
curve AS (SELECT recording_id, lag, avg(dx*dx + dy*dy) AS m FROM pairs GROUP BY ALL),
area AS (SELECT recording_id, (lag - lag(lag) OVER w) * (m + lag(m) OVER w) / 2 AS a FROM curve
         WINDOW w AS (PARTITION BY recording_id ORDER BY lag))
SELECT recording_id, {r('sum(a)')} AS msd_auc FROM area GROUP BY recording_id""")
def msd_auc(spark, d):
    return rounded(D.msd_auc(D.ensemble_msd(V.tracks(spark, d), PX), DT))


@query("moment_scaling", f"""WITH {PAIRS},
m AS (SELECT recording_id, particle, lag, unnest([1, 2, 3, 4]) AS q, sqrt(dx*dx + dy*dy) AS rr FROM pairs WHERE lag <= 10),
mom AS (SELECT recording_id, particle, lag, q, ln(avg(pow(rr, q)) + 1e-15) AS lm FROM m GROUP BY recording_id, particle, lag, q),
g AS (SELECT recording_id, particle, q, regr_slope(lm, ln(lag)) AS gamma, count(*) AS n FROM mom GROUP BY ALL),
n AS (SELECT recording_id, particle FROM tracks GROUP BY ALL HAVING count(*) >= 6)
SELECT recording_id, particle, {r('regr_slope(gamma, q)', 5)} AS mss_slope FROM g JOIN n USING (recording_id, particle)
WHERE g.n >= 4 GROUP BY recording_id, particle""")
def moment_scaling(spark, d):
    return rounded(D.moment_scaling(V.tracks(spark, d), PX, DT), digits=5)


@query("mobility_summary", f"""WITH {DIFFUSION}
SELECT recording_id, {r('quantile_cont(pinned, 0.5)')} AS median_d,
  {r('quantile_cont(round(alpha, 3), 0.5)', 4)} AS median_alpha,
  count(*) FILTER (mobile) AS n_mobile, count(*) FILTER (immobile) AS n_immobile,
  {r('count(*) FILTER (mobile) / nullif(count(*) FILTER (mobile OR immobile), 0)')} AS mobile_fraction,
  {r('count(*) FILTER (mobile) / nullif(count(*) FILTER (immobile), 0)')} AS mob_immob_ratio,
  {', '.join(r(f"count(*) FILTER (motion = '{m}') / nullif(count(*) FILTER (motion <> 'Unknown'), 0)") + f' AS frac_{m.lower()}'
             for m in ('Immobile', 'Confined', 'Brownian', 'Directed'))}
FROM judged GROUP BY recording_id""")
def mobility_summary(spark, d):
    return rounded(rounded(D.mobility_summary(diffusion(spark, d)), "median_alpha", digits=4),
                   "median_d", "mobile_fraction", "mob_immob_ratio", "frac_immobile",
                   "frac_confined", "frac_brownian", "frac_directed")


@query("mobility_masks", f"WITH {DIFFUSION} SELECT recording_id, particle, mobile, immobile FROM judged")
def mobility_masks(spark, d):
    return diffusion(spark, d).select("recording_id", "particle", K.is_mobile().alias("mobile"),
                                      K.is_immobile().alias("immobile"))


@query("classify_motion", f"""WITH {ALPHA} SELECT motion, count(*) AS n FROM anomalous GROUP BY motion""")
def classify_motion(spark, d):
    fits = D.fit_anomalous(D.fit_linear_d(D.track_msd(V.tracks(spark, d), PX), DT), DT)
    return fits.groupBy("motion").agg(F.count(F.lit(1)).alias("n"))


@query("log_d_clip", f"""WITH {FIT} SELECT recording_id, particle,
{r('CASE WHEN D > 0 THEN least(greatest(log10(D), -5), 2) END')} AS logD_clipped FROM fit""")
def log_d_clip(spark, d):
    fits = D.fit_linear_d(D.track_msd(V.tracks(spark, d), PX), DT)
    return rounded(fits.select("recording_id", "particle", K.log_d_clip(F.col("D")).alias("logD_clipped")))


@query("duplicate_observations", f"""WITH {SQL_OBSERVATIONS} SELECT recording_id, particle, frame, count(*) AS n
FROM observations GROUP BY recording_id, particle, frame HAVING count(*) > 1""")
def duplicate_observations(spark, d):
    return K.duplicate_observations(V.observations(spark, d))


@query("filter_track_length", f"""WITH {SQL_TRACKS} SELECT recording_id, particle, frame, x, y FROM tracks
QUALIFY count(*) OVER (PARTITION BY recording_id, particle) BETWEEN 60 AND 70""")
def filter_track_length(spark, d):
    return K.filter_track_length(V.tracks(spark, d), 60, 70).select("recording_id", "particle", "frame", "x", "y")


@query("filter_by_d", f"""WITH {FIT},
kept AS (SELECT recording_id, particle FROM fit WHERE D BETWEEN 0.001 AND 0.05)
SELECT recording_id, lag, {r('avg(dx*dx + dy*dy)')} AS msd_um2, count(*) AS n_pairs
FROM pairs SEMI JOIN kept USING (recording_id, particle) GROUP BY recording_id, lag""")
def filter_by_d(spark, d):
    t = V.tracks(spark, d)
    kept, _ = K.filter_by_d(t, D.fit_linear_d(D.track_msd(t, PX), DT), 0.001, 0.05)
    out = D.ensemble_msd(kept, PX).where("n_pairs > 0").withColumnRenamed("lag_frame", "lag")
    return rounded(out)


@query("filter_by_d_audit", f"""WITH {FIT}
SELECT recording_id, count(*) AS n_tracks_before_d_filter,
  count(*) FILTER (NOT coalesce(D BETWEEN 0.001 AND 0.05, false)) AS n_tracks_excluded_by_d_filter,
  count(*) FILTER (fit_status = 'below_resolution') AS n_below_resolution_excluded_by_d_filter,
  count(*) FILTER (fit_status = 'nonpositive_slope') AS n_nonpositive_slope_excluded_by_d_filter
FROM fit GROUP BY recording_id""")
def filter_by_d_audit(spark, d):
    t = V.tracks(spark, d)
    return K.filter_by_d(t, D.fit_linear_d(D.track_msd(t, PX), DT), 0.001, 0.05)[1]


@query("explore_tracks", f"""WITH {DIFFUSION} SELECT recording_id, particle, n_observations, motion,
{rs('D')} FROM diffusion WHERE n_observations BETWEEN 50 AND 80 AND (D IS NULL OR D BETWEEN 0.001 AND 1)
AND motion IN ('Immobile', 'Confined', 'Directed')""")
def explore_tracks(spark, d):
    out = K.explore_tracks(diffusion(spark, d), (50, 80), (0.001, 1.0),
                           motions=["Immobile", "Confined", "Directed"])
    return rounded(out.select("recording_id", "particle", "n_observations", "motion", "D"))


@query("accept_prelinked", f"""WITH {SQL_OBSERVATIONS},
linked AS (SELECT *, CASE WHEN particle % 7 = 0 THEN NULL WHEN particle % 11 = 0 THEN -1 ELSE particle * 3 END AS track FROM observations),
kept AS (SELECT *, dense_rank() OVER (PARTITION BY recording_id ORDER BY track) - 1 AS pid FROM linked WHERE track >= 0)
SELECT recording_id, event_id, pid AS particle FROM kept
QUALIFY count(*) OVER (PARTITION BY recording_id, pid) >= 60""")
def accept_prelinked(spark, d):
    track = (F.when(F.col("particle") % 7 == 0, None).when(F.col("particle") % 11 == 0, -1)
             .otherwise(F.col("particle") * 3))
    obs = V.observations(spark, d).withColumn("track", track).drop("particle")
    return K.accept_prelinked(obs, "track", 60).select("recording_id", "event_id", "particle")


@query("contiguous_runs", f"""WITH {SQL_TRACKS},
isl AS (SELECT recording_id, particle, frame, frame - row_number() OVER (
          PARTITION BY recording_id, particle ORDER BY frame) AS g FROM tracks)
SELECT recording_id, particle, min(frame) AS run_start, count(*) AS n_frames,
       max(frame) - min(frame) AS span FROM isl GROUP BY recording_id, particle, g""")
def contiguous_runs(spark, d):
    runs = lags.contiguous_runs(V.tracks(spark, d), block=32)
    return (runs.groupBy("recording_id", "particle", "run_start")
            .agg(F.count(F.lit(1)).alias("n_frames"),
                 (F.max("frame") - F.min("frame")).alias("span")))


@query("adjacent_links", f"""WITH {SQL_TRACKS}
SELECT recording_id, particle, frame, gap, {rs('dx', 'dy')} FROM (
  SELECT recording_id, particle, frame, frame - lag(frame) OVER p AS gap,
         (x - lag(x) OVER p) * 0.01 AS dx, (y - lag(y) OVER p) * 0.01 AS dy FROM tracks
  WINDOW p AS (PARTITION BY recording_id, particle ORDER BY frame)) WHERE gap IS NOT NULL""")
def adjacent_links(spark, d):
    return rounded(lags.adjacent_links(V.tracks(spark, d), PX, block=32))


@query("track_ends", f"""WITH {SQL_TRACKS} SELECT recording_id, particle, min(frame) AS first_frame,
max(frame) AS last_frame, arg_min(x, frame) AS start_x, arg_min(y, frame) AS start_y,
arg_max(x, frame) AS end_x, arg_max(y, frame) AS end_y FROM tracks GROUP BY ALL""")
def track_ends(spark, d):
    from lociflow.operators.linking import segment_ends
    return segment_ends(V.tracks(spark, d))


@query("jump_distances", f"""WITH {STEPS} SELECT recording_id, particle, frame, {r('sqrt(dx*dx + dy*dy)')} AS jump_um
FROM steps QUALIFY count(*) OVER (PARTITION BY recording_id) >= 30""")
def jump_distances(spark, d):
    return rounded(S.jump_distances(V.tracks(spark, d), PX))


@query("van_hove", f"""WITH {STEPS},
ax AS (SELECT recording_id, unnest([dx, dy]) AS d FROM steps),
sd AS (SELECT recording_id, avg(d) AS mean_um, stddev_pop(d) AS gaussian_sigma_um FROM ax GROUP BY ALL),
m AS (SELECT recording_id, count(*) AS n_displacements, avg(dx*dx + dy*dy) AS m2, avg((dx*dx + dy*dy) ** 2) AS m4
      FROM steps GROUP BY ALL HAVING count(*) >= 30)
SELECT recording_id, n_displacements, {rs('mean_um', 'gaussian_sigma_um')},
       {r('m4 / (2 * m2 * m2) - 1')} AS non_gaussian_alpha2 FROM m JOIN sd USING (recording_id)""")
def van_hove(spark, d):
    return rounded(S.van_hove(V.tracks(spark, d), PX, minimum=30))


@query("van_hove_histogram", f"""WITH {STEPS},
big AS (SELECT recording_id FROM steps GROUP BY ALL HAVING count(*) >= 30),
ax AS (SELECT recording_id, unnest([dx, dy]) AS d FROM steps SEMI JOIN big USING (recording_id)),
lim AS (SELECT recording_id, quantile_cont(abs(d), 0.995) AS l FROM ax GROUP BY ALL),
b AS (SELECT recording_id, l, CAST(least(floor((d + l) / (2 * l / 80)), 79) AS INTEGER) AS bin
      FROM ax JOIN lim USING (recording_id) WHERE abs(d) <= l),
c AS (SELECT recording_id, l, bin, count(*) AS n FROM b GROUP BY ALL)
SELECT recording_id, bin, n, {r('-l + (bin + 0.5) * 2 * l / 80')} AS bin_center_um,
       {r('n / (sum(n) OVER (PARTITION BY recording_id) * 2 * l / 80)')} AS density FROM c""")
def van_hove_histogram(spark, d):
    return rounded(S.van_hove_histogram(V.tracks(spark, d), PX, minimum=30))


@query("velocity_autocorrelation", f"""WITH {STEPS},
dots AS (SELECT a.recording_id, b.frame - a.frame AS lag, avg(a.dx*b.dx + a.dy*b.dy) AS m, count(*) AS n
  FROM steps a JOIN steps b ON a.recording_id = b.recording_id AND a.particle = b.particle
   AND b.frame BETWEEN a.frame AND a.frame + 10 GROUP BY ALL),
z AS (SELECT recording_id, m AS m0, n AS n_velocities FROM dots WHERE lag = 0 AND n >= 20 AND m > 0)
SELECT recording_id, CAST(lag AS INTEGER) AS lag_frame, CAST(lag AS DOUBLE) AS lag_s, {r('m / m0')} AS vacf,
       n AS n_pairs, n_velocities FROM dots JOIN z USING (recording_id)""")
def velocity_autocorrelation(spark, d):
    return rounded(S.velocity_autocorrelation(V.tracks(spark, d), PX, DT))


ANGLES = SQL_TRACKS + """,
angles AS (
  SELECT a.recording_id, a.particle, a.frame,
    degrees(atan2((b.x-a.x)*(c.y-b.y) - (b.y-a.y)*(c.x-b.x), (b.x-a.x)*(c.x-b.x) + (b.y-a.y)*(c.y-b.y))) AS turning_angle_deg
  FROM tracks a JOIN tracks b ON a.recording_id = b.recording_id AND a.particle = b.particle AND b.frame = a.frame + 1
  JOIN tracks c ON a.recording_id = c.recording_id AND a.particle = c.particle AND c.frame = a.frame + 2
  WHERE (b.x <> a.x OR b.y <> a.y) AND (c.x <> b.x OR c.y <> b.y))"""


@query("turning_angles", f"""WITH {ANGLES} SELECT recording_id, particle, frame,
{rs('turning_angle_deg')} FROM angles""")
def turning_angles(spark, d):
    return rounded(S.turning_angles(V.tracks(spark, d)))


@query("mobile_fraction_over_time", f"""WITH {DIFFUSION},
c AS (SELECT recording_id, particle, avg(frame) AS mf FROM tracks GROUP BY ALL),
e AS (SELECT recording_id, max(frame) AS mx FROM tracks GROUP BY ALL),
w AS (SELECT recording_id, floor(mf / 50) AS w, mobile FROM c JOIN judged j USING (recording_id, particle)
      JOIN e USING (recording_id) WHERE (mobile OR immobile) AND floor(mf / 50) * 50 < mx)
SELECT recording_id, {r('w * 50 + 25')} AS time_s,
 {r('count(*) FILTER (mobile) / count(*)')} AS mobile_fraction, count(*) AS n_tracks
FROM w GROUP BY recording_id, w HAVING count(*) >= 2""")
def mobile_fraction_over_time(spark, d):
    return rounded(S.mobile_fraction_over_time(
        V.tracks(spark, d), diffusion(spark, d), DT, 50, minimum=2))


DWELL = DIFFUSION + """,
mx AS (SELECT recording_id, max(frame) AS mx FROM tracks GROUP BY ALL),
dwell AS (SELECT recording_id, particle, CAST(last_frame - first_frame + 1 AS DOUBLE) AS dwell_time_s,
  CAST(n_observations AS DOUBLE) AS dwell_time_observed_s, n_observations, last_frame >= mx AS censored
  FROM diffusion JOIN mx USING (recording_id) WHERE motion IN ('Confined', 'Immobile'))"""


@query("dwell_times", f"WITH {DWELL} SELECT * FROM dwell")
def dwell_times(spark, d):
    return S.dwell_times(V.tracks(spark, d), diffusion(spark, d), DT)


@query("dwell_tau", f"""WITH {DWELL} SELECT recording_id, count(*) AS n_dwell, count(*) FILTER (censored) AS n_censored,
{r('CASE WHEN count(*) >= 3 AND count(*) FILTER (NOT censored) > 0 THEN sum(dwell_time_s) / count(*) FILTER (NOT censored) END')} AS dwell_tau_s
FROM dwell GROUP BY recording_id""")
def dwell_tau(spark, d):
    return rounded(S.dwell_tau(S.dwell_times(V.tracks(spark, d), diffusion(spark, d), DT), 3))
