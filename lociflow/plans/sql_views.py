"""Common table expressions of the SQL checks, written independently of the
DataFrame code: brute-force joins and plain aggregates."""
from lociflow.recipes import SQL_TRACKS

PAIRS = SQL_TRACKS + """,
pairs AS (
  SELECT a.recording_id, a.particle, a.frame, CAST(l.lag AS INTEGER) AS lag,
         (b.x - a.x) * 0.01 AS dx, (b.y - a.y) * 0.01 AS dy
  FROM tracks a CROSS JOIN (SELECT unnest(range(1, 21)) AS lag) l
  JOIN tracks b ON b.recording_id = a.recording_id AND b.particle = a.particle
               AND b.frame = a.frame + l.lag)"""
MSD = PAIRS + """,
msd AS (
  SELECT recording_id, particle, lag, avg(dx*dx + dy*dy) AS msd, count(*) AS n_pairs
  FROM pairs GROUP BY ALL)"""
FIT = MSD + """,
sums AS (
  SELECT recording_id, particle, count(*) FILTER (lag <= 5) AS n_lags, max(msd) AS peak,
         max(msd) FILTER (lag <= 5) AS early_peak,
         regr_slope(msd, lag) FILTER (lag <= 5) AS slope,
         regr_intercept(msd, lag) FILTER (lag <= 5) AS icpt
  FROM msd GROUP BY recording_id, particle),
fit0 AS (
  SELECT *, CASE WHEN peak = 0 THEN 'below_resolution'
                 WHEN n_lags >= 3 AND early_peak > 0 AND slope > 0 THEN 'fit'
                 WHEN n_lags >= 3 AND early_peak > 0 THEN 'nonpositive_slope'
                 ELSE 'insufficient_lags' END AS fit_status FROM sums),
resid AS (
  SELECT f.recording_id, f.particle, avg((m.msd - f.slope * m.lag - f.icpt) ** 2) AS mse
  FROM fit0 f JOIN msd m USING (recording_id, particle) WHERE m.lag <= 5 GROUP BY ALL),
fit AS (
  SELECT f.recording_id, f.particle, n_lags, fit_status,
         CASE WHEN fit_status = 'fit' THEN slope / 4 END AS D,
         CASE WHEN fit_status IN ('fit', 'nonpositive_slope') THEN slope / 4 END AS D_linear_raw,
         CASE WHEN fit_status IN ('fit', 'nonpositive_slope') THEN icpt END AS MSD0,
         CASE WHEN fit_status = 'below_resolution' THEN 0.0
              WHEN fit_status IN ('fit', 'nonpositive_slope') THEN r.mse END AS MSE
  FROM fit0 f LEFT JOIN resid r USING (recording_id, particle))"""


def _profile(name: str, exponents: str) -> str:
    """Best exponent per track of the relation ``exponents(recording_id, particle, a)``."""
    return f""",
{name}_fits AS (
  SELECT e.recording_id, e.particle, e.a, regr_sxx(p.msd, pow(p.lag, e.a)) AS sxx,
         regr_sxy(p.msd, pow(p.lag, e.a)) AS sxy, regr_syy(p.msd, pow(p.lag, e.a)) AS syy,
         avg(p.msd) AS my, avg(pow(p.lag, e.a)) AS mu
  FROM ({exponents}) e JOIN early p USING (recording_id, particle) GROUP BY ALL),
{name}_slopes AS (
  SELECT *, CASE WHEN sxx > 1e-14 THEN greatest(sxy / sxx, 0) ELSE 0 END AS b FROM {name}_fits),
{name} AS (
  SELECT recording_id, particle, a, b / 4 AS k, my - b * mu AS c,
         greatest(syy - 2 * b * sxy + b * b * sxx, 0) AS sse FROM {name}_slopes
  QUALIFY row_number() OVER (PARTITION BY recording_id, particle
            ORDER BY greatest(syy - 2 * b * sxy + b * b * sxx, 0), a) = 1)"""


def _grid(low: float, high: float, tag: str) -> str:
    coarse = (f"SELECT recording_id, particle, CAST(round(i * 0.05, 6) AS DOUBLE) AS a FROM tried CROSS JOIN "
              f"(SELECT unnest(range({round(low / 0.05)}, {round(high / 0.05) + 1})) AS i)")
    fine = (f"SELECT DISTINCT recording_id, particle, "
            f"CAST(least(greatest(round(a + i * 0.001, 6), {low}), {high}) AS DOUBLE) AS a FROM {tag}_coarse "
            f"CROSS JOIN (SELECT unnest(range(-50, 51)) AS i)")
    return _profile(f"{tag}_coarse", coarse) + _profile(f"{tag}_fine", fine)


ALPHA = FIT + """,
tried AS (SELECT recording_id, particle FROM fit
          WHERE fit_status IN ('fit', 'nonpositive_slope') AND n_lags >= 4),
early AS (SELECT m.* FROM msd m JOIN tried USING (recording_id, particle) WHERE lag <= 5)
""" + _grid(0.0, 2.0, "box") + _grid(0.0, 4.0, "free") + """,
ends AS (SELECT recording_id, particle, min(lag) AS t0, max(lag) AS t1, max(abs(msd)) AS peak,
                count(*) AS n FROM early GROUP BY ALL),
alpha0 AS (
  SELECT b.recording_id, b.particle, b.a, b.k, b.c, b.sse / e.n AS mse,
         CASE WHEN 4 * b.k * (pow(e.t1, b.a) - pow(e.t0, b.a)) / e.peak < 0.10 THEN 'offset_dominated'
              WHEN b.a < 0.01 OR (b.a > 1.99 AND f.a > 2.01) THEN 'at_limit'
              ELSE 'descriptive_fit' END AS alpha_fit_status
  FROM box_fine b JOIN ends e USING (recording_id, particle) JOIN free_fine f USING (recording_id, particle)),
anomalous AS (
  SELECT f.recording_id, f.particle,
         CASE WHEN a.alpha_fit_status = 'descriptive_fit' THEN a.a END AS alpha,
         a.k AS K_alpha, a.c AS alpha_MSD0, a.mse AS alpha_MSE,
         CASE WHEN f.fit_status = 'below_resolution' THEN 'below_resolution'
              ELSE coalesce(a.alpha_fit_status, 'insufficient_lags') END AS alpha_fit_status,
         CASE WHEN a.alpha_fit_status = 'offset_dominated' THEN 'Immobile'
              WHEN a.alpha_fit_status = 'descriptive_fit' THEN
                CASE WHEN a.a < 0.5 THEN 'Immobile' WHEN a.a < 0.9 THEN 'Confined'
                     WHEN a.a < 1.1 THEN 'Brownian' ELSE 'Directed' END
              ELSE 'Unknown' END AS motion
  FROM fit f LEFT JOIN alpha0 a USING (recording_id, particle))"""
GEOMETRY = """,
whole AS (
  SELECT recording_id, particle, count(*) AS n_observations, avg(x) AS cx, avg(y) AS cy,
         min(frame) AS first_frame, max(frame) AS last_frame,
         arg_min(x, frame) AS ax, arg_min(y, frame) AS ay,
         arg_max(x, frame) AS bx, arg_max(y, frame) AS by_ FROM tracks GROUP BY ALL),
spread AS (
  SELECT t.recording_id, t.particle,
         avg(sqrt(((t.x - w.cx) * 0.01) ** 2 + ((t.y - w.cy) * 0.01) ** 2)) AS mean_radial_displacement_um,
         sqrt(avg(((t.x - w.cx) * 0.01) ** 2 + ((t.y - w.cy) * 0.01) ** 2)) AS radius_of_gyration_um
  FROM tracks t JOIN whole w USING (recording_id, particle) GROUP BY ALL),
links AS (
  SELECT recording_id, particle, frame - lag(frame) OVER p AS gap,
         sqrt(((x - lag(x) OVER p) * 0.01) ** 2 + ((y - lag(y) OVER p) * 0.01) ** 2) AS size
  FROM tracks WINDOW p AS (PARTITION BY recording_id, particle ORDER BY frame)),
path AS (
  SELECT recording_id, particle, sum(size) AS path_length_um, avg(size) AS mean_link_displacement_um,
         avg(size / gap) AS mean_link_speed_um_s, avg(size) FILTER (gap = 1) AS mean_step_um,
         count(*) FILTER (gap = 1) AS n_single_frame_steps FROM links WHERE gap IS NOT NULL GROUP BY ALL),
geometry AS (
  SELECT w.recording_id, w.particle, n_observations, first_frame, last_frame,
         mean_radial_displacement_um, radius_of_gyration_um, path_length_um,
         mean_link_displacement_um, mean_link_speed_um_s, mean_step_um,
         coalesce(n_single_frame_steps, 0) AS n_single_frame_steps,
         CAST(last_frame - first_frame AS DOUBLE) AS track_duration_s,
         CASE WHEN n_observations >= 2 THEN sqrt(((bx - ax) * 0.01) ** 2 + ((by_ - ay) * 0.01) ** 2) END AS net_displacement_um,
         CASE WHEN path_length_um > 0 THEN sqrt(((bx - ax) * 0.01) ** 2 + ((by_ - ay) * 0.01) ** 2) / path_length_um
              WHEN path_length_um = 0 THEN 0.0 END AS directionality_ratio
  FROM whole w JOIN spread USING (recording_id, particle) LEFT JOIN path USING (recording_id, particle))"""
DIFFUSION = ALPHA + GEOMETRY + """,
diffusion AS (
  SELECT g.*, coalesce(f.fit_status, 'insufficient_lags') AS fit_status, f.D, f.D_linear_raw, f.MSD0, f.MSE,
         a.alpha, a.K_alpha, a.alpha_MSD0, a.alpha_MSE,
         coalesce(a.alpha_fit_status, 'insufficient_lags') AS alpha_fit_status,
         coalesce(a.motion, 'Unknown') AS motion
  FROM geometry g LEFT JOIN fit f USING (recording_id, particle)
  LEFT JOIN anomalous a USING (recording_id, particle)),
judged AS (
  SELECT *, coalesce(D >= 0.02, false) AS mobile,
         coalesce(D < 0.02, false) OR fit_status = 'nonpositive_slope' AS immobile,
         CASE WHEN fit_status = 'nonpositive_slope' THEN 1e-5 WHEN D > 0 THEN greatest(D, 1e-5) END AS pinned
  FROM diffusion)"""
STEPS = SQL_TRACKS + """,
steps AS (
  SELECT a.recording_id, a.particle, a.frame, (b.x - a.x) * 0.01 AS dx, (b.y - a.y) * 0.01 AS dy
  FROM tracks a JOIN tracks b ON b.recording_id = a.recording_id AND b.particle = a.particle
                             AND b.frame = a.frame + 1)"""
