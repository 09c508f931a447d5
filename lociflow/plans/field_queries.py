"""Queries over steps' states, drift, regions, detections and pixels."""
from __future__ import annotations

from pyspark.sql import functions as F

from lociflow import recipes as V
from lociflow.operators import detections as T, drift as R, pixels as X, roi as O, states as H, steps as S
from lociflow.plans.catalog import query, r, rounded, rs
from lociflow.plans.sql_views import STEPS
from lociflow.recipes import FRAME_INTERVAL as DT, PIXEL_SIZE as PX, SQL_LOCS, SQL_OBSERVATIONS, SQL_PIXELS, SQL_TRACKS

# ---- states -----------------------------------------------------------------------


@query("step_segments", f"""WITH {STEPS},
isl AS (SELECT recording_id, particle, frame, frame - row_number() OVER (PARTITION BY recording_id, particle ORDER BY frame) AS g FROM tracks),
st AS (SELECT recording_id, particle, frame, min(frame) OVER (PARTITION BY recording_id, particle, g) AS run_start FROM isl),
j AS (SELECT s.*, run_start, (s.frame - run_start) // 3 AS piece FROM steps s JOIN st USING (recording_id, particle, frame))
SELECT recording_id, particle, run_start, CAST(piece AS BIGINT) AS piece, count(*) AS n_steps, {r('sum(dx*dx+dy*dy)')} AS total,
  {r('arg_min(dx*dx+dy*dy, frame)')} AS first_r2 FROM j GROUP BY ALL""")
def step_segments(spark, d):
    s = H.step_segments(V.tracks(spark, d), PX, piece=3)
    return rounded(s.select("recording_id", "particle", "run_start", "piece", F.size("r2").cast("long").alias("n_steps"),
                            F.aggregate("r2", F.lit(0.0), lambda a, x: a + x).alias("total"), F.col("r2")[0].alias("first_r2")))


@query("fit_hmm")
def fit_hmm(spark, d):
    segs = H.step_segments(V.tracks(spark, d), PX)
    out = H.fit_hmm(segs, DT, states=(1, 2, 3))
    return rounded(out.select("recording_id", "n_states", "n_steps", "n_segments", "iterations", "settled", "loglik", "bic",
                              F.get("D", F.lit(0)).alias("slowest_d")), digits=4)


# One round of two states from fixed parameters: forward and backward along every piece, then the sums.
HMM_D, HMM_A, HMM_PI = (0.05, 0.6), (0.9, 0.1, 0.2, 0.8), (0.7, 0.3)
HMM_SQL = STEPS + f""",
isl AS (SELECT recording_id, particle, frame, frame - row_number() OVER (PARTITION BY recording_id, particle ORDER BY frame) AS g FROM tracks),
st AS (SELECT recording_id, particle, frame, min(frame) OVER (PARTITION BY recording_id, particle, g) AS run_start FROM isl),
obs AS (SELECT recording_id, particle, run_start, (s.frame - run_start) // 64 AS piece, row_number() OVER (PARTITION BY recording_id, particle, run_start, (s.frame - run_start) // 64 ORDER BY s.frame) AS t,
          count(*) OVER (PARTITION BY recording_id, particle, run_start, (s.frame - run_start) // 64) AS n, dx*dx + dy*dy AS r2 FROM steps s JOIN st USING (recording_id, particle, frame)),
em AS (SELECT *, exp(-r2/{4 * HMM_D[0] * DT})/(4*pi()*{HMM_D[0] * DT}) AS e0, exp(-r2/{4 * HMM_D[1] * DT})/(4*pi()*{HMM_D[1] * DT}) AS e1 FROM obs),
fw(recording_id, particle, run_start, piece, t, f0, f1, c) AS (
  SELECT recording_id, particle, run_start, piece, t, {HMM_PI[0]}*e0/({HMM_PI[0]}*e0 + {HMM_PI[1]}*e1), {HMM_PI[1]}*e1/({HMM_PI[0]}*e0 + {HMM_PI[1]}*e1), {HMM_PI[0]}*e0 + {HMM_PI[1]}*e1 FROM em WHERE t = 1
  UNION ALL
  SELECT recording_id, particle, run_start, piece, t, a/(a + b), b/(a + b), a + b FROM (
    SELECT e.*, (f0*{HMM_A[0]} + f1*{HMM_A[2]})*e0 AS a, (f0*{HMM_A[1]} + f1*{HMM_A[3]})*e1 AS b FROM (SELECT * EXCLUDE (t), t + 1 AS t FROM fw) JOIN em e USING (recording_id, particle, run_start, piece, t))),
bw(recording_id, particle, run_start, piece, t, b0, b1) AS (
  SELECT recording_id, particle, run_start, piece, t, 1.0::double, 1.0::double FROM em WHERE t = n
  UNION ALL
  SELECT recording_id, particle, run_start, piece, t - 1, ({HMM_A[0]}*e0*b0 + {HMM_A[1]}*e1*b1)/c, ({HMM_A[2]}*e0*b0 + {HMM_A[3]}*e1*b1)/c
  FROM bw JOIN em USING (recording_id, particle, run_start, piece, t) JOIN fw USING (recording_id, particle, run_start, piece, t) WHERE t > 1),
occ AS (SELECT *, f0*b0 AS g0, f1*b1 AS g1 FROM em JOIN fw USING (recording_id, particle, run_start, piece, t) JOIN bw USING (recording_id, particle, run_start, piece, t)),
mv AS (SELECT p.recording_id, sum(p.f0*{HMM_A[0]}*q.e0*q.b0/q.c) AS t00, sum(p.f0*{HMM_A[1]}*q.e1*q.b1/q.c) AS t01, sum(p.f1*{HMM_A[2]}*q.e0*q.b0/q.c) AS t10, sum(p.f1*{HMM_A[3]}*q.e1*q.b1/q.c) AS t11
       FROM occ p JOIN occ q ON (p.recording_id, p.particle, p.run_start, p.piece, p.t + 1) = (q.recording_id, q.particle, q.run_start, q.piece, q.t) GROUP BY ALL)"""


@query("hmm_em_step", f"""WITH RECURSIVE {HMM_SQL},
s AS (SELECT recording_id, sum(ln(c)) AS ll, sum(g0*r2)/sum(4*{DT}*g0) AS d0, sum(g1*r2)/sum(4*{DT}*g1) AS d1, sum(g0) FILTER (t = 1)/count(*) FILTER (t = 1) AS p0 FROM occ GROUP BY ALL)
SELECT recording_id, {rs('ll', 'd0', 'd1', 'p0')}, {r('coalesce(t00/(t00 + t01), 0.5)')} AS stay_slow, {r('coalesce(t11/(t10 + t11), 0.5)')} AS stay_fast FROM s LEFT JOIN mv USING (recording_id)""")
def hmm_em_step(spark, d):
    segs = H.step_segments(V.tracks(spark, d), PX)
    fits = segs.select("recording_id").distinct().select("recording_id", F.lit(2).alias("k"), F.array(*map(F.lit, HMM_D + HMM_A + HMM_PI)).alias("theta"))
    return rounded(H.em_step(segs, fits, DT).select(
        "recording_id", F.col("loglik").alias("ll"), F.col("theta")[0].alias("d0"), F.col("theta")[1].alias("d1"), F.col("theta")[6].alias("p0"),
        F.col("theta")[2].alias("stay_slow"), F.col("theta")[5].alias("stay_fast")))


@query("diffusive_states")
def diffusive_states(spark, d):
    return rounded(H.diffusive_states(V.tracks(spark, d), PX, DT, min_steps=20), digits=4)


@query("jdd_curve", f"""WITH {STEPS}, j AS (SELECT recording_id, round(sqrt(dx*dx+dy*dy), 9) AS v FROM steps),
c AS (SELECT DISTINCT recording_id, v, count(*) OVER (PARTITION BY recording_id, v) AS weight, count(*) OVER (PARTITION BY recording_id) AS n_jumps,
        rank() OVER (PARTITION BY recording_id ORDER BY v) - 1 AS below FROM j)
SELECT recording_id, {r('v')} AS r, {r('(below + (weight + 1)/2.0)/n_jumps')} AS cdf, weight, n_jumps FROM c WHERE n_jumps >= 30""")
def jdd_curve(spark, d):
    j = S.jump_distances(V.tracks(spark, d), PX).withColumn("jump_um", F.round("jump_um", 9))
    return rounded(H.jdd_curve(j))


@query("jdd_fit")
def jdd_fit(spark, d):
    f = H.jdd_fit(S.jump_distances(V.tracks(spark, d), PX), DT, 2)
    return rounded(f.select("recording_id", "n_components", "n_jumps", F.col("D")[0].alias("d_slow"), F.col("D")[1].alias("d_fast"),
                            F.col("fraction")[0].alias("f_slow"), "r_squared", "rmse", "fit_status"), digits=4)


@query("jdd_density")
def jdd_density(spark, d):
    j = S.jump_distances(V.tracks(spark, d), PX)
    return rounded(H.jdd_density(H.jdd_fit(j, DT, 2), j, DT).select("recording_id", "r", "pdf_total"), digits=4)


@query("static_offset", f"""WITH {SQL_TRACKS} SELECT recording_id,
{r('4 * quantile_cont(0.5*((x/1000)**2 + (y/1000)**2), 0.5)', 8)} AS offset_um2 FROM tracks WHERE 0.5*((x/1000)**2 + (y/1000)**2) > 0 GROUP BY recording_id""")
def static_offset(spark, d):
    t = V.tracks(spark, d).withColumns({"loc_sigma_x_nm": F.col("x"), "loc_sigma_y_nm": F.col("y")})
    return rounded(H.static_offset(t), digits=8)


# ---- drift --------------------------------------------------------------------------
SEGMENTS = SQL_TRACKS + """,
nf AS (SELECT recording_id, max(frame)+1 AS nf FROM tracks GROUP BY ALL),
seg AS (SELECT recording_id, CAST(s AS INTEGER) AS segment, CAST(s*100 AS INTEGER) AS st, CAST(least((s+1)*100, nf) AS INTEGER) AS en
        FROM nf CROSS JOIN (SELECT unnest(range(0, 64)) AS s) WHERE s*100 < nf),
segs AS (SELECT g.recording_id, segment, st, en, (st+en-1)/2.0 AS center, (SELECT count(*) FROM tracks t WHERE t.recording_id=g.recording_id AND t.frame>=st AND t.frame<en) AS n_locs FROM seg g)"""


@query("drift_segments", f"""WITH {SEGMENTS} SELECT recording_id, segment, st AS "start", en AS "end", center::DOUBLE AS center, n_locs FROM segs""")
def drift_segments(spark, d):
    return R.drift_segments(V.tracks(spark, d), 100)


@query("drift_segments_adaptive", f"""WITH RECURSIVE {SQL_TRACKS},
c AS (SELECT recording_id, frame, count(*) AS n FROM tracks GROUP BY ALL),
u AS (SELECT recording_id, frame+1 AS e, sum(n) OVER (PARTITION BY recording_id ORDER BY frame) AS held FROM c),
nf AS (SELECT recording_id, max(e) AS nf, greatest(ceil(max(e)/64.0), 25)::BIGINT AS narrow, greatest(ceil(max(e)/64.0), 400)::BIGINT AS wide FROM u GROUP BY ALL),
b AS (SELECT recording_id, unnest(range(0, nf+1)) AS pos FROM nf),
h AS (SELECT b.recording_id, b.pos, coalesce(max(u.held) OVER (PARTITION BY b.recording_id ORDER BY b.pos), 0) AS held
      FROM b LEFT JOIN u ON b.recording_id=u.recording_id AND b.pos=u.e),
hn AS (SELECT h.*, nf, narrow, wide FROM h JOIN nf USING (recording_id)),
nx AS (SELECT h.recording_id, h.pos, nf, least(nf, h.pos+wide, greatest(h.pos+narrow, coalesce(min(g.e), nf))) AS nx
       FROM hn h LEFT JOIN u g ON h.recording_id=g.recording_id AND h.held+50<=g.held GROUP BY h.recording_id, h.pos, nf, wide, narrow),
walk(recording_id, k, pos) AS (SELECT recording_id, 0, 0::BIGINT FROM nf
  UNION ALL SELECT w.recording_id, k+1, nx::BIGINT FROM walk w JOIN nx ON w.recording_id=nx.recording_id AND w.pos=nx.pos WHERE w.pos<nf),
cuts AS (SELECT w.recording_id, k, w.pos, held, narrow, wide, max(k) OVER (PARTITION BY w.recording_id) - k AS back FROM walk w JOIN hn USING (recording_id, pos)),
poor AS (SELECT recording_id FROM cuts GROUP BY recording_id HAVING max(pos) FILTER (back=0) - max(pos) FILTER (back=2) <= max(wide)
   AND (max(pos) FILTER (back=0) - max(pos) FILTER (back=1) < max(narrow) OR max(held) FILTER (back=0) - max(held) FILTER (back=1) < 50)),
kept AS (SELECT recording_id, pos, held FROM cuts WHERE back<>1 OR recording_id NOT IN (FROM poor)),
s AS (SELECT recording_id, row_number() OVER w - 1 AS segment, pos AS a, lead(pos) OVER w AS b, lead(held) OVER w - held AS n FROM kept WINDOW w AS (PARTITION BY recording_id ORDER BY pos))
SELECT recording_id, segment::INTEGER AS segment, a::INTEGER AS "start", b::INTEGER AS "end", (a+b-1)/2.0::DOUBLE AS center, n::BIGINT AS n_locs FROM s WHERE b IS NOT NULL""")
def drift_segments_adaptive(spark, d):
    return R.drift_segments(V.tracks(spark, d), 100, adaptive=True, min_locs=50)


@query("segment_pairs", f"""WITH {SEGMENTS} SELECT a.recording_id, a.segment AS i, b.segment AS j, a.n_locs AS n_i, b.n_locs AS n_j
FROM segs a JOIN segs b ON a.recording_id=b.recording_id AND a.segment<b.segment""")
def segment_pairs(spark, d):
    return R.segment_pairs(R.drift_segments(V.tracks(spark, d), 100))


BEADS = SEGMENTS + """,
o AS (SELECT t.recording_id, segment, particle, frame, x, y, center, st, en, frame - lag(frame) OVER (PARTITION BY t.recording_id, segment, particle ORDER BY frame) AS gap
      FROM tracks t JOIN segs s ON t.recording_id=s.recording_id AND frame>=st AND frame<en),
w AS (SELECT recording_id, segment, particle, count(*) AS n, max(gap) AS wide, any_value(center) AS c, any_value(en-st) AS len,
        max(frame) FILTER (frame<=center) AS fa, min(frame) FILTER (frame>=center) AS fb,
        arg_max(x, frame) FILTER (frame<=center) AS xa, arg_max(y, frame) FILTER (frame<=center) AS ya,
        arg_min(x, frame) FILTER (frame>=center) AS xb, arg_min(y, frame) FILTER (frame>=center) AS yb FROM o GROUP BY ALL),
pos AS (SELECT recording_id, segment, particle, xa + coalesce((c-fa)/nullif(fb-fa, 0), 0)*(xb-xa) AS x, ya + coalesce((c-fa)/nullif(fb-fa, 0), 0)*(yb-ya) AS y
        FROM w WHERE n>=3 AND fa IS NOT NULL AND fb IS NOT NULL AND coalesce(wide, 0) <= greatest(2, len/4.0))"""


@query("fiducial_positions", f"WITH {BEADS} SELECT recording_id, segment, particle, {rs('x', 'y')} FROM pos")
def fiducial_positions(spark, d):
    t = V.tracks(spark, d)
    return rounded(R.fiducial_positions(t, R.drift_segments(t, 100)))


@query("fiducial_shifts", f"""WITH {BEADS},
mv AS (SELECT a.recording_id, a.segment AS i, b.segment AS j, b.x-a.x AS sx, b.y-a.y AS sy FROM pos a JOIN pos b USING (recording_id, particle) WHERE a.segment<b.segment),
md AS (SELECT recording_id, i, j, count(*) AS n, quantile_cont(sx, 0.5) AS mx, quantile_cont(sy, 0.5) AS my FROM mv GROUP BY ALL),
gd AS (SELECT recording_id, i, j, count(*) AS k, quantile_cont(sx, 0.5) AS dx, quantile_cont(sy, 0.5) AS dy FROM mv JOIN md USING (recording_id, i, j)
       WHERE sqrt((sx-mx)**2+(sy-my)**2) <= 40 GROUP BY ALL),
al AS (SELECT a.recording_id, a.segment AS i, b.segment AS j FROM segs a JOIN segs b ON a.recording_id=b.recording_id AND a.segment<b.segment)
SELECT recording_id, i, j, {r('CASE WHEN n>=3 AND k>=3 THEN dx ELSE 0 END')} AS dx, {r('CASE WHEN n>=3 AND k>=3 THEN dy ELSE 0 END')} AS dy,
 {r('CASE WHEN n>=3 AND k>=3 THEN k ELSE 0 END')} AS weight, coalesce(n>=3 AND k>=3, false) AS accepted,
 CASE WHEN n>=3 AND k>=3 THEN 'accepted' WHEN n>=3 THEN 'fiducials_disagree' ELSE 'too_few_shared_fiducials' END AS reason,
 coalesce(CASE WHEN n>=3 AND k>=3 THEN k ELSE n END, 0) AS n_fiducials FROM al LEFT JOIN md USING (recording_id, i, j) LEFT JOIN gd USING (recording_id, i, j)""")
def fiducial_shifts(spark, d):
    t = V.tracks(spark, d)
    seg = R.drift_segments(t, 100)
    return rounded(R.fiducial_shifts(R.fiducial_positions(t, seg), seg, 3, 40.0))


@query("apply_drift", f"""WITH {SQL_TRACKS}, c AS (SELECT recording_id, frame, avg(x)/100 AS dx, avg(y)/100 AS dy FROM tracks WHERE frame % 5 > 0 GROUP BY ALL)
SELECT t.recording_id, particle, t.frame, {r('x - coalesce(dx, 0)')} AS x, {r('y - coalesce(dy, 0)')} AS y FROM tracks t LEFT JOIN c USING (recording_id, frame)""")
def apply_drift(spark, d):
    t = V.tracks(spark, d)
    c = t.where("frame % 5 > 0").groupBy("recording_id", "frame").agg((F.avg("x") / 100).alias("dx"), (F.avg("y") / 100).alias("dy"))
    return rounded(R.apply_drift(t, c).select("recording_id", "particle", "frame", "x", "y"))


@query("rcc_shifts")
def rcc_shifts(spark, d):
    locs = V.localisations(spark, d)
    return rounded(R.rcc_shifts(locs, R.drift_segments(locs, 50), upsampling=0.5, min_locs=50, min_correlation=0.0, min_psr=1.0), digits=4)


@query("drift_curve")
def drift_curve(spark, d):
    t = V.tracks(spark, d)
    seg = R.drift_segments(t, 100)
    pairs = R.fiducial_shifts(R.fiducial_positions(t, seg), seg, 3, 60.0)
    return rounded(R.drift_curve(seg, pairs, tolerance=40.0), digits=4)


@query("reference_rect", f"""WITH {SQL_LOCS} SELECT recording_id, loc_id FROM locs WHERE x >= 50 AND x < 250 AND y >= 100 AND y < 300""")
def reference_rect(spark, d):
    return R.reference_rect(V.localisations(spark, d), (50, 100, 200, 200)).select("recording_id", "loc_id")


# ---- regions ----------------------------------------------------------------------
_RINGS = {0: ("cell", [(50, 50), (300, 80), (250, 300), (120, 400)]), 1: ("cell", [(300, 300), (450, 320), (380, 480)]),
          2: ("edge", [(-10, -10), (60, 0), (40, 90)])}


def rois(spark, d):
    """The same three outlines for every recording that has localisations."""
    rec = V.localisations(spark, d).select("recording_id").distinct()
    shape = F.array(*[F.struct(F.lit(k).alias("roi_id"), F.lit(lab).alias("label"), F.array(*[
        F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring]).alias("vertices"))
        for k, (lab, ring) in _RINGS.items()])
    return rec.select("recording_id", F.inline(shape))


def _edges_sql(rings):
    rows = []
    for k, (lab, ring) in rings.items():
        for e, (x0, y0) in enumerate(ring):
            x1, y1 = ring[(e + 1) % len(ring)]
            rows.append(f"({k}, '{lab}', {e}, {x0}.0::DOUBLE, {y0}.0::DOUBLE, {x1}.0::DOUBLE, {y1}.0::DOUBLE)")
    return f"edges(roi_id, label, edge, x0, y0, x1, y1) AS (VALUES {', '.join(rows)})"


EDGES = SQL_LOCS + ", " + _edges_sql(_RINGS) + """,
hits AS (SELECT recording_id, loc_id, roi_id, label FROM locs CROSS JOIN edges
         WHERE (y0 > y) <> (y1 > y) AND x < (x1-x0)*(y-y0)/(y1-y0) + x0 GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query("roi_polygon_filter", f"WITH {EDGES} SELECT DISTINCT recording_id, loc_id FROM hits")
def roi_polygon_filter(spark, d):
    return O.roi_polygon_filter(V.localisations(spark, d), rois(spark, d)).select("recording_id", "loc_id")


@query("roi_replicates", f"""WITH {EDGES} SELECT concat(recording_id, '_', label, CASE WHEN roi_id = 1 THEN '_2' ELSE '' END) AS recording_id, loc_id FROM hits""")
def roi_replicates(spark, d):
    return O.roi_replicates(V.localisations(spark, d), rois(spark, d)).select("recording_id", "loc_id")


@query("roi_growth_check", f"""WITH {EDGES},
b AS (SELECT recording_id, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_ FROM locs GROUP BY ALL),
p AS (SELECT roi_id, min(x0) AS ax, max(x0) AS bx, min(y0) AS ay, max(y0) AS by_ FROM edges GROUP BY ALL)
SELECT recording_id, roi_id, (p.ax < b.ax OR p.bx > b.bx OR p.ay < b.ay OR p.by_ > b.by_) AS grows FROM b CROSS JOIN p""")
def roi_growth_check(spark, d):
    return O.roi_growth_check(V.localisations(spark, d), rois(spark, d))


@query("polygon_edges", f"""WITH {EDGES} SELECT recording_id, roi_id, CAST(edge AS INTEGER) AS edge, x0, y0, x1, y1 FROM edges
CROSS JOIN (SELECT DISTINCT recording_id FROM locs)""")
def polygon_edges(spark, d):
    return O.polygon_edges(rois(spark, d))


MASK = SQL_LOCS + """,
mask AS (SELECT DISTINCT recording_id, y::INT AS y, CAST(floor(x) AS INT) AS x FROM locs WHERE mass > 200000 UNION
         SELECT DISTINCT recording_id, y::INT AS y, CAST(floor(x) AS INT) + 1 AS x FROM locs WHERE mass < 150000)"""


def mask(spark, d):
    locs = V.localisations(spark, d)
    one = locs.where("mass > 200000").select("recording_id", F.col("y").cast("int").alias("y"), F.floor("x").cast("int").alias("x"))
    two = locs.where("mass < 150000").select("recording_id", F.col("y").cast("int").alias("y"), (F.floor("x") + 1).cast("int").alias("x"))
    return O.mask_union(one, two)


@query("mask_union", f"WITH {MASK} SELECT recording_id, y, x FROM mask")
def mask_union(spark, d):
    return mask(spark, d)


@query("roi_mask_filter", f"""WITH {MASK} SELECT recording_id, loc_id FROM locs l WHERE EXISTS (SELECT 1 FROM mask m WHERE m.recording_id=l.recording_id
AND m.y=least(greatest(floor(l.y+0.5), 0), 511) AND m.x=least(greatest(floor(l.x+0.5), 0), 399))""")
def roi_mask_filter(spark, d):
    return O.roi_mask_filter(V.localisations(spark, d), mask(spark, d), 512, 400).select("recording_id", "loc_id")


# ---- detections ---------------------------------------------------------------------
def detections(spark, d):
    return V.localisations(spark, d).withColumns({
        "size": F.col("loc_id") % 11, "ecc": (F.col("loc_id") % 13) / 13.0, "ep": (F.col("loc_id") % 17) / 2.0})


@query("quality_pregate", f"""WITH {SQL_LOCS},
q AS (SELECT *, loc_id % 11 BETWEEN 0.5 AND 7 AND (loc_id % 13)/13.0 <= 0.9 AND (loc_id % 17)/2.0 <= 7 AS ok FROM locs),
n AS (SELECT recording_id, count(*) FILTER (ok) >= greatest(50, 0.05*count(*)) AS strict FROM q GROUP BY ALL)
SELECT recording_id, loc_id FROM q JOIN n USING (recording_id) WHERE ok OR NOT strict""")
def quality_pregate(spark, d):
    return T.quality_pregate(detections(spark, d)).select("recording_id", "loc_id")


@query("drop_coincident", f"""WITH {SQL_OBSERVATIONS} SELECT recording_id, frame, min(event_id) AS loc_id FROM observations
GROUP BY recording_id, frame, round(x), round(y)""")
def drop_coincident(spark, d):
    obs = V.observations(spark, d).withColumnRenamed("event_id", "loc_id").withColumns({"x": F.col("x") / 100, "y": F.col("y") / 100})
    return T.drop_coincident(obs).select("recording_id", "frame", "loc_id")


@query("suppress_close")
def suppress_close(spark, d):
    return T.suppress_close(V.localisations(spark, d), 20.0).select("recording_id", "frame", "loc_id")


@query("attach_loc_sigma", f"""WITH {SQL_LOCS}, p AS (SELECT *, mass*0.5/0.9 AS ph FROM locs)
SELECT loc_id, {r('sqrt((3.0625+1/12.0)/ph*(1+4*(2*pi()*(3.0625+1/12.0)*10/ph)+sqrt(2*(2*pi()*(3.0625+1/12.0)*10/ph)/(1+4*(2*pi()*(3.0625+1/12.0)*10/ph)))))*0.01*1000')} AS loc_sigma_x_nm FROM p""")
def attach_loc_sigma(spark, d):
    return rounded(T.attach_loc_sigma(V.localisations(spark, d), PX, gain=0.5, qe=0.9, background=10.0).select("loc_id", "loc_sigma_x_nm"))


N_FRAMES = SQL_LOCS + ", nfr AS (SELECT recording_id, max(frame)+1 AS n_frames FROM locs GROUP BY ALL)"


def n_frames(spark, d):
    return V.localisations(spark, d).groupBy("recording_id").agg((F.max("frame") + 1).alias("n_frames"))


@query("sample_windows", f"""WITH {N_FRAMES} SELECT recording_id, CAST(k AS INTEGER) AS window_id, CAST(floor(k*(n_frames-40)/3.0) AS INTEGER) AS "start",
CAST(floor(k*(n_frames-40)/3.0)+40 AS INTEGER) AS "end" FROM nfr CROSS JOIN (SELECT unnest(range(4)) AS k)""")
def sample_windows(spark, d):
    return T.sample_windows(n_frames(spark, d), 4, 40)


@query("chunk_ranges", f"""WITH {N_FRAMES} SELECT recording_id, CAST(k AS INTEGER) AS chunk, CAST(k*(n_frames//7) + least(k, n_frames%7) AS INTEGER) AS "start",
CAST((k+1)*(n_frames//7) + least(k+1, n_frames%7) AS INTEGER) AS "end" FROM nfr CROSS JOIN (SELECT unnest(range(7)) AS k)""")
def chunk_ranges(spark, d):
    return T.chunk_ranges(n_frames(spark, d), 7)


@query("brightest_per_frame", f"""WITH {SQL_LOCS} SELECT recording_id, frame, loc_id FROM locs
QUALIFY row_number() OVER (PARTITION BY recording_id, frame ORDER BY mass DESC, loc_id) <= 5""")
def brightest_per_frame(spark, d):
    return T.brightest_per_frame(V.localisations(spark, d), 5).select("recording_id", "frame", "loc_id")


@query("knee", f"""WITH {SQL_LOCS}, m AS (SELECT recording_id, log10(1e9/mass) AS lm FROM locs WHERE mass > 0),
e AS (SELECT recording_id, min(lm) AS lo, max(lm) AS hi, count(*) AS n FROM m GROUP BY ALL),
g AS (SELECT e.*, k, lo + k*((hi-lo)/59) AS cut FROM e CROSS JOIN (SELECT unnest(range(60)) AS k)),
s AS (SELECT g.recording_id, k, cut, count(*) FILTER (lm >= cut)::DOUBLE/any_value(n) AS y FROM g JOIN m USING (recording_id) GROUP BY ALL),
f AS (SELECT recording_id, max(y) FILTER (k=0) AS y0, max(y) FILTER (k=59) AS y1 FROM s GROUP BY ALL)
SELECT recording_id, {r('arg_max(cut, (round(y0+(y1-y0)*k/59.0-y, 12), -k))')} AS knee_log10 FROM s JOIN f USING (recording_id) GROUP BY recording_id""")
def knee(spark, d):
    locs = V.localisations(spark, d).withColumn("mass", 1e9 / F.col("mass"))
    return rounded(T.knee(locs).drop("knee"))


@query("threshold_guidance", f"""WITH {N_FRAMES} SELECT recording_id, count(*) AS n_candidates, count(*) FILTER (mass >= 250000) AS n_kept,
{r('count(*) FILTER (mass >= 250000)/count(*)')} AS kept_fraction, {r('count(*)/any_value(n_frames)')} AS per_frame_all,
{r('count(*) FILTER (mass >= 250000)/any_value(n_frames)')} AS per_frame_kept, '' AS warning FROM locs JOIN nfr USING (recording_id) GROUP BY recording_id""")
def threshold_guidance(spark, d):
    return rounded(T.threshold_guidance(V.localisations(spark, d), 250000.0, n_frames(spark, d)))


@query("log_mass_histogram", f"""WITH {SQL_LOCS}, m AS (SELECT recording_id, log10(mass) AS lm FROM locs WHERE mass > 0),
e AS (SELECT recording_id, min(lm) AS lo, max(lm) AS hi FROM m GROUP BY ALL)
SELECT recording_id, CAST(least(floor((lm-lo)/((hi-lo)/64)), 63) AS INTEGER) AS bin, {r('any_value(lo) + least(floor((lm-lo)/((hi-lo)/64)), 63)*any_value((hi-lo)/64)')} AS edge,
count(*) AS n FROM m JOIN e USING (recording_id) GROUP BY recording_id, least(floor((lm-lo)/((hi-lo)/64)), 63)""")
def log_mass_histogram(spark, d):
    return rounded(T.log_mass_histogram(V.localisations(spark, d)))


@query("density_matched", f"""WITH {N_FRAMES} SELECT recording_id, {r('quantile_cont(mass, 1 - 4.0*200/12.0/1000)')} AS minmass FROM locs WHERE false GROUP BY ALL
UNION ALL SELECT recording_id, {r('lo + (pos - floor(pos))*(hi - lo)')} FROM (
 SELECT recording_id, any_value(pos) AS pos, max(mass) FILTER (rn = floor(pos)) AS lo, max(mass) FILTER (rn = ceil(pos)) AS hi FROM (
  SELECT recording_id, mass, row_number() OVER (PARTITION BY recording_id ORDER BY mass) - 1 AS rn,
   (1 - 4.0::DOUBLE*n_frames/count(*) OVER (PARTITION BY recording_id))*(count(*) OVER (PARTITION BY recording_id)-1) AS pos FROM locs JOIN nfr USING (recording_id)) GROUP BY recording_id)""")
def density_matched(spark, d):
    return rounded(T.density_matched(V.localisations(spark, d), 4.0, n_frames(spark, d)).select("recording_id", "minmass"))


@query("gmm2_log_mass")
def gmm2_log_mass(spark, d):
    return rounded(T.gmm2_log_mass(V.localisations(spark, d)), digits=4)


@query("noise_floor")
def noise_floor(spark, d):
    return rounded(T.noise_floor(V.localisations(spark, d)))


@query("linkability_sweep")
def linkability_sweep(spark, d):
    locs = V.localisations(spark, d)
    return rounded(T.linkability_sweep(locs, T.threshold_grid(locs, steps=6), 20.0, min_len=2, linker="nn"))


@query("pick_threshold")
def pick_threshold(spark, d):
    locs = V.localisations(spark, d)
    sweep = T.linkability_sweep(locs, T.threshold_grid(locs), 30.0, min_len=2, linker="nn")
    floors = locs.select("recording_id").distinct().withColumn("noise_floor", F.lit(1000.0))
    return rounded(T.pick_threshold(sweep, floors))


@query("static_minmass")
def static_minmass(spark, d):
    return rounded(T.static_minmass(V.localisations(spark, d)))


@query("estimate_minmass")
def estimate_minmass(spark, d):
    return rounded(T.estimate_minmass(V.localisations(spark, d), n_frames(spark, d), 20.0, min_len=2, linker="nn"))


# ---- pixels ---------------------------------------------------------------------------
def frames(spark, d):
    return V.table(spark, d, "embeddings").select(
        F.lit(0).cast("long").alias("recording_id"), F.col("vec_id").cast("int").alias("frame"), F.lit(8).alias("h"),
        F.lit(8).alias("w"), F.col("embedding").alias("px"))


@query("pixel_rows", f"WITH {SQL_PIXELS} SELECT 0::BIGINT AS recording_id, frame, y, x, {rs('v')} FROM pixels")
def pixel_rows(spark, d):
    return rounded(X.pixel_rows(frames(spark, d)))


@query("project_stack", f"""WITH {SQL_PIXELS}, s AS (SELECT y, x, avg(v) AS mean, max(v) AS mx, stddev_pop(v) AS sd FROM pixels GROUP BY ALL)
SELECT 0::BIGINT AS recording_id, y, x, {r('any_value(mean)')} AS mean, {r('any_value(mx)')} AS max, count(*) FILTER (v > mean + 2*sd) AS blinks
FROM pixels JOIN s USING (y, x) GROUP BY y, x""")
def project_stack(spark, d):
    return rounded(X.project_stack(V.pixels(spark, d), 2.0))


B3SQL = """, k(o, w) AS (VALUES (-2, 1/16.0::DOUBLE), (-1, 4/16.0::DOUBLE), (0, 6/16.0::DOUBLE), (1, 4/16.0::DOUBLE), (2, 1/16.0::DOUBLE)),
a1 AS (SELECT t.frame, t.y, t.x, sum(p.v*ky.w*kx.w) AS v FROM pixels t CROSS JOIN k ky CROSS JOIN k kx
       JOIN pixels p ON p.frame=t.frame AND p.y=least(greatest(t.y+ky.o, 0), 7) AND p.x=least(greatest(t.x+kx.o, 0), 7) GROUP BY ALL),
a2 AS (SELECT t.frame, t.y, t.x, sum(p.v*ky.w*kx.w) AS v FROM a1 t CROSS JOIN k ky CROSS JOIN k kx
       JOIN a1 p ON p.frame=t.frame AND p.y=least(greatest(t.y+2*ky.o, 0), 7) AND p.x=least(greatest(t.x+2*kx.o, 0), 7) GROUP BY ALL),
w2 AS (SELECT a1.frame, a1.y, a1.x, a1.v - a2.v AS v FROM a1 JOIN a2 USING (frame, y, x))"""


@query("wavelet_w2", f"WITH {SQL_PIXELS}{B3SQL} SELECT 0::BIGINT AS recording_id, frame, y, x, {rs('v')} FROM w2")
def wavelet_w2(spark, d):
    return rounded(X.pixel_rows(X.wavelet_w2(frames(spark, d))))


@query("wavelet_noise", f"""WITH {SQL_PIXELS}{B3SQL},
m AS (SELECT frame, quantile_cont(v, 0.5) AS m FROM w2 GROUP BY ALL),
s AS (SELECT frame, 1.4826*quantile_cont(abs(v-m), 0.5) AS s FROM w2 JOIN m USING (frame) GROUP BY ALL)
SELECT 0::BIGINT AS recording_id, {r('quantile_cont(s, 0.5)')} AS sigma, count(*) AS n_frames, {r('greatest(5.0, 5*round(4.4*quantile_cont(s, 0.5)/5))')} AS threshold FROM s""")
def wavelet_noise(spark, d):
    return rounded(X.recommend_threshold(X.wavelet_noise(X.wavelet_w2(frames(spark, d)))))


@query("subtract_background", f"""WITH {SQL_PIXELS},
o AS (SELECT unnest(range(-2, 3)) AS o), i AS (SELECT unnest(range(0, 8)) AS i),
mir AS (SELECT i, o, CASE WHEN i+o < 0 THEN -1-(i+o) WHEN i+o > 7 THEN 15-(i+o) ELSE i+o END AS s FROM i CROSS JOIN o),
bg AS (SELECT p.frame, a.i AS y, b.i AS x, avg(p.v) AS m FROM mir a CROSS JOIN mir b JOIN pixels p ON p.y=a.s AND p.x=b.s GROUP BY ALL),
fl AS (SELECT p.frame, p.y, p.x, greatest(p.v - m, 0) AS v FROM pixels p JOIN bg USING (frame, y, x)),
k AS (SELECT o, exp(-0.5*o*o)/sum(exp(-0.5*o*o)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS o)),
sm AS (SELECT t.frame, t.y, t.x, sum(p.v*ky.w*kx.w) AS v FROM fl t CROSS JOIN k ky CROSS JOIN k kx
       JOIN fl p ON p.frame=t.frame AND p.y=least(greatest(t.y+ky.o, 0), 7) AND p.x=least(greatest(t.x+kx.o, 0), 7) GROUP BY ALL)
SELECT 0::BIGINT AS recording_id, frame, y, x, {r('(v - min(v) OVER f)/(max(v) OVER f - min(v) OVER f)')} AS v FROM sm WINDOW f AS (PARTITION BY frame)""")
def subtract_background(spark, d):
    return rounded(X.pixel_rows(X.subtract_background(frames(spark, d), radius=2)))


@query("detect_basins")
def detect_basins(spark, d):
    return rounded(X.detect_basins(X.pixel_rows(X.wavelet_w2(frames(spark, d))), 0.02, 2))


@query("local_maxima")
def local_maxima(spark, d):
    return rounded(X.local_maxima(X.pixel_rows(frames(spark, d)).withColumn("v", F.greatest("v", F.lit(0.0))), 3, moves=3))


@query("raw_contrast", f"""WITH {SQL_PIXELS},
l AS (SELECT frame*100 + y*10 + x AS loc_id, frame, y, x FROM pixels WHERE (y + x) % 2 = 0),
r AS (SELECT l.loc_id, p.v, abs(p.y-l.y) <= 1 AND abs(p.x-l.x) <= 1 AS core, (p.y-l.y)**2 + (p.x-l.x)**2 BETWEEN 2.25 AND 9 AS ring
      FROM l JOIN pixels p ON p.frame=l.frame AND abs(p.y-l.y) <= 3 AND abs(p.x-l.x) <= 3 WHERE l.y BETWEEN 3 AND 4 AND l.x BETWEEN 3 AND 4),
m AS (SELECT loc_id, quantile_cont(v, 0.5) FILTER (ring) AS m, avg(v) FILTER (core) AS c FROM r GROUP BY ALL),
s AS (SELECT loc_id, any_value(m) AS m, any_value(c) AS c, 1.4826*quantile_cont(abs(v-m), 0.5) AS s FROM r JOIN m USING (loc_id) WHERE ring GROUP BY ALL)
SELECT l.loc_id, {r('(c-m)/s')} AS raw_cnr FROM l LEFT JOIN s USING (loc_id)""")
def raw_contrast(spark, d):
    rows = V.pixels(spark, d)
    locs = rows.where("(y + x) % 2 = 0").select("recording_id", "frame", (F.col("frame") * 100 + F.col("y") * 10 + F.col("x")).alias("loc_id"), "x", "y")
    return rounded(X.raw_contrast(locs, rows, 8, 8, 3).select("loc_id", "raw_cnr"))


IMG = SQL_PIXELS + """,
e AS (SELECT min(v) AS lo, max(v) AS hi FROM pixels),
c AS (SELECT CAST(least(floor((v-lo)/((hi-lo)/256)), 255) AS INTEGER) AS bin, count(*) AS n FROM pixels CROSS JOIN e GROUP BY ALL),
h AS (SELECT CAST(b AS INTEGER) AS bin, lo + (b+0.5)*((hi-lo)/256) AS center, coalesce(n, 0) AS n FROM (SELECT unnest(range(256)) AS b) CROSS JOIN e LEFT JOIN c ON c.bin=b)"""


@query("image_histogram", f"WITH {IMG} SELECT 0::BIGINT AS recording_id, bin, {rs('center')}, n FROM h")
def image_histogram(spark, d):
    return rounded(X.image_histogram(V.pixels(spark, d)))


@query("otsu", f"""WITH {IMG},
t AS (SELECT bin, center, sum(n) OVER u AS w1, sum(n) OVER dn AS w2, sum(n*center) OVER u AS s1, sum(n*center) OVER dn AS s2 FROM h
      WINDOW u AS (ORDER BY bin), dn AS (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT 0::BIGINT AS recording_id, {r('arg_max(center, (round(w1*w2*(s1/w1 - s2/w2)**2, 9), -bin))')} AS threshold FROM t WHERE w2 > 0""")
def otsu(spark, d):
    return rounded(X.otsu(X.image_histogram(V.pixels(spark, d))))


@query("triangle", f"""WITH {IMG},
p AS (SELECT arg_max(bin, (n, -bin)) AS pk, max(n) AS top, min(bin) FILTER (n>0) AS lo, max(bin) FILTER (n>0) AS hi FROM h),
q AS (SELECT *, (pk-lo) < (hi-pk) AS flip FROM p),
j AS (SELECT center, n, CASE WHEN flip THEN 255-bin - (255-hi) ELSE bin - lo END AS d, CASE WHEN flip THEN (255-pk) - (255-hi) ELSE pk - lo END AS w, top FROM h CROSS JOIN q)
SELECT 0::BIGINT AS recording_id, {r('arg_max(center, (round(top/sqrt(top*top+w*w)*d - w/sqrt(top*top+w*w)*n, 9), -d))')} AS threshold FROM j WHERE d >= 0 AND d < w""")
def triangle(spark, d):
    return rounded(X.triangle(X.image_histogram(V.pixels(spark, d))))


@query("li_threshold")
def li_threshold(spark, d):
    return rounded(X.li(V.pixels(spark, d)))


@query("threshold_mask", f"""WITH {SQL_PIXELS}, m AS (SELECT y, x, max(v) AS v FROM pixels GROUP BY ALL)
SELECT 0::BIGINT AS recording_id, y, x FROM m WHERE v > (SELECT avg(v) FROM m)""")
def threshold_mask(spark, d):
    img = V.pixels(spark, d).groupBy("recording_id", "y", "x").agg(F.max("v").alias("v"))
    return X.threshold_mask(img, img.groupBy("recording_id").agg(F.avg("v").alias("threshold")))


@query("closed_mask_components")
def closed_mask_components(spark, d):
    img = V.pixels(spark, d).groupBy("recording_id", "y", "x").agg(F.max("v").alias("v"))
    m = X.threshold_mask(img, img.groupBy("recording_id").agg(F.avg("v").alias("threshold")), closing=1)
    return X.mask_components(m, 2).select("recording_id", "y", "x", F.col("component.y").alias("part_y"), F.col("component.x").alias("part_x"))
