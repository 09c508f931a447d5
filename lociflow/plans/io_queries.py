"""Queries over names, imported text, exchange forms and streams. Text inputs are
written from the test tables, so their number grows with them."""
from __future__ import annotations

from pyspark.sql import functions as F

from lociflow import recipes as V
from lociflow.functions import text as N
from lociflow.operators import diffusion as D
from lociflow.plans.catalog import query, r, rounded, rs
from lociflow.plans.link_queries import CHAIN, NEAR1, greedy_sql
from lociflow.plans.sql_views import FIT, MSD
from lociflow.recipes import FRAME_INTERVAL as DT, PIXEL_SIZE as PX, SQL_LOCS, SQL_OBSERVATIONS, SQL_TRACKS
from lociflow.sources import sinks as W, tables as S
from lociflow.streaming import live as L

# ---- imported localisation tables -----------------------------------------------------
RAW = """
raw AS (SELECT o_custkey % 6 AS recording_id, o_orderkey AS loc_id,
  CASE WHEN o_orderkey % 17 = 0 THEN 'NA' WHEN o_orderkey % 29 = 0 THEN '' ELSE CAST(o_orderkey % 200 AS VARCHAR) END AS frame,
  CASE WHEN o_orderkey % 31 = 0 THEN 'x?' ELSE CAST(o_custkey * 7 AS VARCHAR) END AS x, CAST(o_custkey % 512 AS VARCHAR) AS y,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS mass FROM orders),
parsed AS (SELECT *, TRY_CAST(frame AS DOUBLE) AS f, TRY_CAST(x AS DOUBLE) AS dx, TRY_CAST(y AS DOUBLE) AS dy,
  CASE WHEN frame = '' THEN 'blank' WHEN TRY_CAST(frame AS DOUBLE) IS NULL OR TRY_CAST(x AS DOUBLE) IS NULL THEN 'not a number'
       WHEN TRY_CAST(frame AS DOUBLE) - 1 < 0 THEN 'negative frame' END AS reason FROM raw)"""


def raw(spark, d):
    o = V.table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") % 6).alias("recording_id"), k.alias("loc_id"),
        F.when(k % 17 == 0, "NA").when(k % 29 == 0, "").otherwise((k % 200).cast("string")).alias("frame"),
        F.when(k % 31 == 0, "x?").otherwise((F.col("o_custkey") * 7).cast("string")).alias("x"),
        (F.col("o_custkey") % 512).cast("string").alias("y"),
        F.when(k % 5 != 0, F.col("o_custkey").cast("string")).alias("mass"))


@query("normalise_units", f"""WITH {RAW} SELECT recording_id, loc_id, CAST(f - 1 AS INTEGER) AS frame, {r('dx/100')} AS x, {r('dy/100')} AS y,
{r('coalesce(TRY_CAST(mass AS DOUBLE), 1.0)')} AS mass FROM parsed WHERE reason IS NULL""")
def normalise_units(spark, d):
    t = raw(spark, d).withColumns({"offset": F.lit(-1.0), "unit": F.lit("nm")})
    return rounded(S.normalise_units(t, pixel_size_um=0.1)[0])


@query("rejected_rows", f"WITH {RAW} SELECT recording_id, reason, count(*) AS n FROM parsed WHERE reason IS NOT NULL GROUP BY ALL")
def rejected_rows(spark, d):
    t = raw(spark, d).withColumns({"offset": F.lit(-1.0), "unit": F.lit("nm")})
    return S.normalise_units(t, pixel_size_um=0.1)[1].groupBy("recording_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("parse_localisations", f"""WITH {RAW} SELECT CAST(recording_id AS VARCHAR) AS recording_id, CAST(f - 1 AS INTEGER) AS frame, {r('dx')} AS x, {r('dy')} AS y,
{r('coalesce(TRY_CAST(mass AS DOUBLE), 1.0)')} AS mass FROM parsed WHERE reason IS NULL""")
def parse_localisations(spark, d):
    lines = raw(spark, d).select(
        F.concat(F.lit("/data/"), F.col("recording_id").cast("string"), F.lit(".txt")).alias("file"),
        F.concat_ws("\t", "frame", "x", "y", F.coalesce("mass", F.lit(""))).alias("value"))
    _, at = S.detect_preset(["Plane", "CentroidX(px)", "CentroidY(px)", "Integrated_Intensity"])
    layout = lines.select("file").distinct().select(
        "file", F.lit("\\\t").alias("sep"), F.lit(4).alias("n_columns"), F.array(F.lit("Plane\tX\tY")).alias("skip"),
        *[F.lit(at.get(role)).cast("int").alias(f"i_{role}") for role in S.ROLES], F.lit(-1.0).alias("offset"), F.lit("px").alias("unit"))
    return rounded(S.parse_localisations(lines, layout)[0].drop("track"))


@query("parse_native_d", """SELECT o_custkey % 6 AS recording_id, o_orderkey AS particle, o_totalprice AS D, (o_custkey * 2)::DOUBLE AS MSD0,
CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 9)::DOUBLE END AS MSE FROM orders WHERE o_orderkey % 11 > 0""")
def parse_native_d(spark, d):
    o = V.table(spark, d, "orders")
    k = F.col("o_orderkey")
    line = F.concat_ws(" ", F.lit("1"), k.cast("string"), F.col("o_totalprice").cast("string"), (F.col("o_custkey") * 2).cast("string"),
                       F.when(k % 3 == 0, "NA").otherwise((k % 9).cast("string")))
    lines = o.select((F.col("o_custkey") % 6).alias("recording_id"), F.when(k % 11 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    return S.parse_native_d(lines).drop("logD")


@query("parse_native_msd", f"""WITH {MSD} SELECT recording_id, particle, CAST(row_number() OVER (PARTITION BY recording_id, particle ORDER BY lag) AS INTEGER) AS lag,
{rs('msd', digits=4)} FROM msd""")
def parse_native_msd(spark, d):
    m = D.track_msd(V.tracks(spark, d), PX)
    lines = m.groupBy("recording_id", "particle").agg(F.array_sort(F.collect_list(F.struct("lag", "msd"))).alias("_v")).select(
        "recording_id", F.concat_ws(" ", F.lit("1"), F.col("particle").cast("string"),
                                    F.array_join(F.transform("_v", lambda s: s["msd"].cast("string")), " ")).alias("value"))
    return rounded(S.parse_native_msd(lines), digits=4)


@query("native_ensemble_msd", f"""WITH {MSD}, rec AS (SELECT DISTINCT recording_id FROM msd)
SELECT rec.recording_id, CAST(l.lag AS INTEGER) AS lag_frame, {r('avg(msd)')} AS msd_um2 FROM rec CROSS JOIN (SELECT unnest(range(1, 21)) AS lag) l
LEFT JOIN msd m ON m.recording_id = rec.recording_id AND m.lag = l.lag GROUP BY ALL""")
def native_ensemble_msd(spark, d):
    m = D.track_msd(V.tracks(spark, d), PX).drop("n_pairs")
    return rounded(D.ensemble_from_tracks(m, weighted=False).drop("n_pairs"))


@query("overlay_native_d", f"""WITH {FIT} SELECT recording_id, particle, {r('CASE WHEN particle % 2 = 0 THEN particle / 1000.0 ELSE D END')} AS D,
{r('CASE WHEN particle % 2 = 0 THEN coalesce(CASE WHEN particle % 4 = 0 THEN 0.5 END, MSE) ELSE MSE END')} AS MSE, fit_status FROM fit""")
def overlay_native_d(spark, d):
    own = D.fit_linear_d(D.track_msd(V.tracks(spark, d), PX), DT).select("recording_id", "particle", "D", "MSE", "fit_status")
    native = own.where("particle % 2 = 0").select("recording_id", "particle", (F.col("particle") / 1000.0).alias("D"),
                                                  F.when(F.col("particle") % 4 == 0, 0.5).alias("MSE"))
    return rounded(S.overlay_native_d(own, native))


@query("backfill_geometry", f"""WITH {SQL_TRACKS}, g AS (SELECT recording_id, particle, max(frame) - min(frame) AS dur, count(*) AS n FROM tracks GROUP BY ALL)
SELECT recording_id, particle, CASE WHEN particle % 3 = 0 THEN -1.0::DOUBLE ELSE dur::DOUBLE END AS track_duration_s, n AS n_observations FROM g""")
def backfill_geometry(spark, d):
    from lociflow.plans.analyse import backfill_geometry as fill
    t = V.tracks(spark, d)
    old = t.select("recording_id", "particle").distinct().withColumns({
        "track_duration_s": F.when(F.col("particle") % 3 == 0, -1.0), "metrics_schema_version": F.lit(3)})
    return fill(old, t, PX, DT).select("recording_id", "particle", "track_duration_s", "n_observations")


@query("interp_curve", f"""WITH {MSD}, c AS (SELECT recording_id, lag::DOUBLE AS x, avg(msd) AS y FROM msd WHERE lag % 3 = 1 GROUP BY ALL),
g AS (SELECT DISTINCT recording_id, i * 0.5 AS gx FROM c CROSS JOIN (SELECT unnest(range(0, 45)) AS i)),
b AS (SELECT g.recording_id, gx, max(x) FILTER (x <= gx) AS x0, arg_max(y, x) FILTER (x <= gx) AS y0, min(x) FILTER (x >= gx) AS x1,
        arg_min(y, x) FILTER (x >= gx) AS y1 FROM g JOIN c USING (recording_id) GROUP BY ALL)
SELECT recording_id, {r('gx')} AS x, {r('CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (gx-x0)/(x1-x0)*(y1-y0) END')} AS y FROM b""")
def interp_curve(spark, d):
    from lociflow.plans.analyse import interp_curve as interp
    m = D.track_msd(V.tracks(spark, d), PX).where("lag % 3 = 1")
    c = m.groupBy("recording_id", F.col("lag").cast("double").alias("x")).agg(F.avg("msd").alias("y"))
    grid = c.select("recording_id").distinct().select("recording_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(44)), lambda i: i * 0.5)).alias("x"))
    return rounded(interp(c, grid, ["recording_id"]))


@query("run_summary_rows", f"""WITH {FIT}, g AS (SELECT recording_id, count(*) AS n_tracks, count(*) FILTER (fit_status = 'fit') AS n_directed FROM fit GROUP BY ALL)
SELECT recording_id, n_tracks, 0::BIGINT AS n_immobile, 0::BIGINT AS n_confined, 0::BIGINT AS n_brownian, n_directed, 0::BIGINT AS n_unknown,
 n_tracks / 2.0::DOUBLE AS qc_half, CASE WHEN n_tracks > 6 THEN 1 ELSE 0 END AS n_qc_flags, 'group' || (recording_id % 3) AS "group" FROM g""")
def run_summary_rows(spark, d):
    fits = D.fit_linear_d(D.track_msd(V.tracks(spark, d), PX), DT)
    g = fits.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_tracks"), F.count_if(F.col("fit_status") == "fit").alias("_f"))
    flag = F.struct(F.lit("warn").alias("level"), F.lit("many").alias("msg"))
    nested = g.select("recording_id", "n_tracks", F.create_map(F.lit("Directed"), F.col("_f")).alias("motion_counts"), F.struct(
        (F.col("n_tracks") / 2.0).alias("half"), F.when(F.col("n_tracks") > 6, F.array(flag)).otherwise(F.array().cast("array<struct<level:string,msg:string>>")).alias("flags")).alias("qc"))
    file = F.concat(F.lit("/runs/group"), (F.col("recording_id") % 3).cast("string"), F.lit("/rec"), F.col("recording_id").cast("string"), F.lit("/a_summary_metrics.json"))
    return S.run_summary_rows(nested, file)


@query("resolve_calibration", f"""WITH {SQL_TRACKS}, g AS (SELECT DISTINCT recording_id FROM tracks)
SELECT recording_id, CASE WHEN recording_id % 2 = 0 THEN 0.1 ELSE 0.106 END::DOUBLE AS px_um, CASE WHEN recording_id % 3 = 0 THEN 0.05 ELSE 0.02 END::DOUBLE AS fi_s,
 (recording_id % 2 <> 0 OR recording_id % 3 <> 0) AS calibration_defaulted FROM g""")
def resolve_calibration(spark, d):
    g = V.tracks(spark, d).select("recording_id").distinct()
    k = F.col("recording_id")
    return S.resolve_calibration(g.withColumns({"px_um": F.when(k % 2 == 0, 0.1), "fi_s": F.when(k % 3 == 0, 0.05)}))


@query("concatenate_series", """WITH f AS (SELECT label AS recording_id, CAST(vec_id % 3 AS INTEGER) AS part,
  CAST(row_number() OVER (PARTITION BY label, vec_id % 3 ORDER BY vec_id) - 1 AS INTEGER) AS frame, vec_id FROM embeddings),
o AS (SELECT recording_id, part, sum(count(*)) OVER (PARTITION BY recording_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM f GROUP BY recording_id, part)
SELECT recording_id, CAST(frame + coalesce(off, 0) AS INTEGER) AS frame, vec_id FROM f JOIN o USING (recording_id, part) WHERE frame + coalesce(off, 0) BETWEEN 5 AND 19""")
def concatenate_series(spark, d):
    from pyspark.sql import Window
    e = V.table(spark, d, "embeddings").select(F.col("label").alias("recording_id"), (F.col("vec_id") % 3).cast("int").alias("part"), "vec_id")
    f = e.withColumn("frame", F.row_number().over(Window.partitionBy("recording_id", "part").orderBy("vec_id")) - 1)
    return S.read_frames(S.concatenate_series(f), 5, 20).select("recording_id", "frame", "vec_id")


# ---- names ------------------------------------------------------------------------------
PATHS = """
paths AS (SELECT c_custkey AS id, concat('N=', c_nationkey, ' MB', c_nationkey, 'a-X', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat(' ', 1 + c_custkey % 30, 'July') END,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(' ', c_mktsegment) END, '/Fly-', c_custkey % 7, '-', CASE WHEN c_custkey % 2 = 0 THEN 'L' ELSE 'r' END, 'Side rec', c_custkey // 40,
  CASE c_custkey % 5 WHEN 0 THEN '_green' WHEN 1 THEN '-file2' WHEN 2 THEN '(3)' ELSE '' END, CASE c_custkey % 6 WHEN 0 THEN '.czi' WHEN 1 THEN '.csv' WHEN 2 THEN '.md' ELSE '.tif' END) AS path FROM customer)"""


def paths(spark, d):
    c = V.table(spark, d, "customer")
    k = F.col("c_custkey")
    s = lambda v: v.cast("string")                                                  # noqa: E731
    return c.select(k.alias("id"), F.concat(
        F.lit("N="), s(F.col("c_nationkey")), F.lit(" MB"), s(F.col("c_nationkey")), F.lit("a-X"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(" "), s(1 + k % 30), F.lit("July"))),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" "), "c_mktsegment")), F.lit("/Fly-"), s(k % 7), F.lit("-"),
        F.when(k % 2 == 0, "L").otherwise("r"), F.lit("Side rec"), s(F.floor(k / 40)),
        F.when(k % 5 == 0, "_green").when(k % 5 == 1, "-file2").when(k % 5 == 2, "(3)").otherwise(""),
        F.when(k % 6 == 0, ".czi").when(k % 6 == 1, ".csv").when(k % 6 == 2, ".md").otherwise(".tif")).alias("path"))


@query("experiment_path", f"""WITH {PATHS} SELECT id, CASE WHEN NOT m THEN '' WHEN rest = '' THEN 'Control' ELSE rest END AS condition,
 upper(regexp_extract(path, '(?i)\\b(MB\\d+[A-Z])\\b', 1)) AS genotype, 'Fly-' || regexp_extract(path, '(?i)\\bfly[\\s_-]*(\\d+)\\b', 1) AS animal,
 upper(regexp_extract(path, '(?i)\\b([LR])[\\s_-]*side\\b', 1)) || 'Side' AS side, CASE WHEN m THEN regexp_extract(path, '(\\d+)July', 1) || 'Jul' ELSE '' END AS date, m AS matched
FROM (SELECT *, path LIKE '%July%' AS m, trim(regexp_extract(path, 'July([^/]*)', 1)) AS rest FROM paths)""")
def experiment_path(spark, d):
    p = paths(spark, d)
    return p.select("id", *[c.alias(k) for k, c in N.experiment_path(F.col("path")).items()])


@query("filter_input_paths", f"""WITH {PATHS} SELECT id, CASE WHEN path LIKE '%.csv' THEN 'external_loc' ELSE 'image' END AS kind FROM paths WHERE path NOT LIKE '%.md'""")
def filter_input_paths(spark, d):
    return S.filter_input_paths(paths(spark, d)).select("id", "kind")


@query("catalogue_inputs", f"""WITH {PATHS},
a AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '[^/]*$') AS leaf, CASE WHEN path LIKE '%.csv' THEN 'external_loc' ELSE 'image' END AS kind FROM paths WHERE path NOT LIKE '%.md'),
b AS (SELECT *, regexp_replace(leaf, '\\.[^.]*$', '') AS stem, CASE WHEN kind = 'image' THEN regexp_replace(regexp_replace(regexp_replace(leaf, '\\.[^.]*$', ''), '-file\\d+$', ''), '\\(\\d+\\)$', '') ELSE regexp_replace(leaf, '\\.[^.]*$', '') END AS series,
   leaf LIKE '%.czi' AS czi FROM a),
c AS (SELECT * FROM b x WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.kind = 'image' AND o.folder = x.folder AND lower(o.stem) || '_green' = lower(x.stem))),
e AS (SELECT *, max(czi) OVER (PARTITION BY folder, kind, series) AS mc FROM c)
SELECT folder, kind, series, count(*)::INTEGER AS n_parts FROM e WHERE czi = mc OR kind <> 'image' GROUP BY ALL""")
def catalogue_inputs(spark, d):
    c = S.catalogue_inputs(paths(spark, d).drop("id"))
    return c.select("folder", "kind", "series", "n_parts")


@query("series_key", f"""WITH {PATHS}, l AS (SELECT id, regexp_extract(path, '[^/]*$') AS leaf FROM paths)
SELECT id, regexp_replace(regexp_replace(regexp_replace(leaf, '\\.[^.]*$', ''), '-file\\d+$', ''), '\\(\\d+\\)$', '') AS series,
 CASE WHEN leaf LIKE '%-file2.%' THEN 2 WHEN leaf LIKE '%(3).%' THEN 3 ELSE -1 END AS part FROM l""")
def series_key(spark, d):
    leaf = F.element_at(F.split("path", "/"), -1)
    return paths(spark, d).select("id", N.series_key(leaf).alias("series"), N.part_number(leaf).alias("part"))


@query("subject_key", """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 2 THEN c_name ELSE concat(c_mktsegment, '_D', c_custkey) END AS subject FROM customer""")
def subject_key(spark, d):
    c = V.table(spark, d, "customer")
    k = F.col("c_custkey")
    core = F.concat("c_mktsegment", F.lit("_D"), k.cast("string"))
    stem = F.when(k % 3 == 0, F.concat(core, F.lit("_Post"))).when(k % 3 == 1, F.concat(F.lit("PRE - "), core)).otherwise(F.col("c_name"))
    return c.select(k.alias("id"), N.subject_key(stem, ["Pre", "Post"]).alias("subject"))


@query("number_text", """SELECT o_orderkey AS id, CASE WHEN p < 0.001 THEN 'p < 0.001' ELSE 'p = ' || printf('%.3f', p) END AS p_text,
 CASE WHEN p >= 0.05 THEN 'ns' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' ELSE '*' END AS stars,
 CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect,
 CASE WHEN n < 1024 THEN CAST(floor(n) AS BIGINT) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n/1024.0) ELSE printf('%.1f MB', n/1048576.0) END AS size
FROM (SELECT *, (o_orderkey % 1999)/10000.0::DOUBLE + 1e-6 AS p, (o_custkey % 200 - 100)/100.0 AS d, o_custkey * o_custkey + 0.3::DOUBLE AS n FROM orders)""")
def number_text(spark, d):
    from lociflow.operators.group_stats import stars
    o = V.table(spark, d, "orders")
    p, e = (F.col("o_orderkey") % 1999) / 10000.0 + 1e-6, (F.col("o_custkey") % 200 - 100) / 100.0
    n = F.col("o_custkey") * F.col("o_custkey") + 0.3
    return o.select(F.col("o_orderkey").alias("id"), N.format_p(p).alias("p_text"), stars(p).alias("stars"),
                    N.effect_word(e).alias("effect"), N.human_size(n).alias("size"))


@query("parse_option", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'simple_lap' WHEN 1 THEN 'subnet' WHEN 2 THEN 'kalman' ELSE 'subnet' END AS linker,
CASE o_orderkey % 3 WHEN 0 THEN 'contiguous' ELSE 'all_pairs' END AS gap_policy FROM orders""")
def parse_option(spark, d):
    o = V.table(spark, d, "orders")
    k = F.col("o_orderkey")
    a = F.when(k % 4 == 0, " LAP ").when(k % 4 == 1, "trackpy").when(k % 4 == 2, "Kalman").otherwise(F.col("o_orderpriority"))
    b = F.when(k % 3 == 0, "legacy").when(k % 3 == 1, "ALL").otherwise("?")
    return o.select(k.alias("id"), N.parse_option(a, "linker").alias("linker"), N.parse_option(b, "gap_policy").alias("gap_policy"))


@query("iso_day", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def iso_day(spark, d):
    o = V.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), N.iso_day(F.concat(F.col("o_orderdate").cast("string"), F.lit("Z"))).cast("string").alias("day"))


# ---- exchange forms -----------------------------------------------------------------------
@query("palmtracer_tracks", f"""WITH {SQL_TRACKS} SELECT recording_id, dense_rank() OVER (PARTITION BY recording_id ORDER BY particle) AS "Track", frame + 1 AS "Plane",
 x AS "CentroidX(px)", y AS "CentroidY(px)", -1.0::DOUBLE AS "CentroidZ(um)", mass AS "Integrated_Intensity", 0 AS id, -1.0::DOUBLE AS "Pair_Distance" FROM tracks""")
def palmtracer_tracks(spark, d):
    return W.palmtracer_tracks(V.tracks(spark, d))


@query("palmtracer_d", f"""WITH {FIT}, n AS (SELECT *, dense_rank() OVER (PARTITION BY recording_id ORDER BY particle) AS tr,
  CASE WHEN fit_status = 'nonpositive_slope' THEN 1e-5 ELSE D END AS dd FROM fit)
SELECT recording_id, 1 AS "ROI", tr AS "Trace", {r('dd')} AS "D", {r('MSD0')} AS "MSD(0)", {rs('MSE')}, {r('least(greatest(log10(dd), -5), 2)')} AS "LogD" FROM n""")
def palmtracer_d(spark, d):
    return rounded(W.palmtracer_d(D.fit_linear_d(D.track_msd(V.tracks(spark, d), PX), DT)))


@query("palmtracer_msd", f"""WITH {MSD}, n AS (SELECT recording_id, dense_rank() OVER (PARTITION BY recording_id ORDER BY particle) AS tr, count(*) OVER (PARTITION BY recording_id, particle) AS c FROM msd)
SELECT DISTINCT recording_id, tr AS trace, c + 2 AS n_fields FROM n""")
def palmtracer_msd(spark, d):
    m = W.palmtracer_msd(D.track_msd(V.tracks(spark, d), PX))
    c = F.split("value", " ")
    return m.select("recording_id", c[1].cast("long").alias("trace"), F.size(c).cast("long").alias("n_fields"))


@query("palmtracer_ratio", f"""WITH {FIT} SELECT recording_id, count(*) FILTER (D >= 0.02) AS n_mobile, count(*) FILTER (D < 0.02) AS n_immobile,
{r('count(*) FILTER (D >= 0.02) / nullif(count(*) FILTER (D < 0.02), 0)')} AS ratio FROM fit WHERE D > 0 GROUP BY recording_id""")
def palmtracer_ratio(spark, d):
    return rounded(W.palmtracer_ratio(D.fit_linear_d(D.track_msd(V.tracks(spark, d), PX), DT), 0.02))


@query("json_lines", f"""WITH {FIT} SELECT concat('{{"recording_id":', recording_id, ',"particle":', particle, ',"fit_status":"', fit_status, '","bad":null}}') AS value FROM fit""")
def json_lines(spark, d):
    fits = D.fit_linear_d(D.track_msd(V.tracks(spark, d), PX), DT)
    return W.json_lines(fits.select("recording_id", "particle", "fit_status", F.when(F.col("particle") >= 0, float("nan")).alias("bad")))


# ---- streams ------------------------------------------------------------------------------
def stamp(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def ts(expr):
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"
COUNTS = """c AS (SELECT date_trunc('hour', ts) AS s, CAST(floor(value/10) AS BIGINT) AS mass_bin, count(*) AS n FROM events GROUP BY ALL)"""


@query("live_counts", f"WITH {COUNTS} SELECT {ts('s')} AS start, {ts('s + INTERVAL 1 HOUR')} AS \"end\", mass_bin, n FROM c")
def live_counts(spark, d):
    return stamp(L.live_counts(L.observed(V.table(spark, d, "events"))), "start", "end")


@query("stream_live_counts", f"WITH {COUNTS} SELECT {ts('s')} AS start, {ts('s + INTERVAL 1 HOUR')} AS \"end\", mass_bin, n FROM c WHERE s + INTERVAL 1 HOUR <= {CLOSED}")
def stream_live_counts(spark, d):
    return stamp(L.drain(L.live_counts(L.event_stream(spark, d))), "start", "end")


MOB = """m AS (SELECT s, count(*) AS n_tracks, count(*) FILTER (value >= 50) AS k FROM (
  SELECT value, date_trunc('day', ts) - to_days(CAST(o AS INTEGER)) * 0 + INTERVAL 12 HOUR * h AS s, ts FROM events CROSS JOIN (SELECT 0 AS o) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS h))
  WHERE ts >= s AND ts < s + INTERVAL 1 DAY GROUP BY s HAVING count(*) >= 5)"""


@query("live_mobility_sliding", f"WITH {MOB} SELECT {ts('s')} AS start, {ts('s + INTERVAL 1 DAY')} AS \"end\", n_tracks, {r('k/n_tracks')} AS mobile_fraction FROM m")
def live_mobility_sliding(spark, d):
    return rounded(stamp(L.live_mobility(L.observed(V.table(spark, d, "events")), F.col("mass") >= 50, slide="12 hours"), "start", "end"))


@query("stream_live_mobility", f"""WITH m AS (SELECT date_trunc('day', ts) AS s, count(*) AS n_tracks, count(*) FILTER (value >= 50) AS k FROM events GROUP BY ALL HAVING count(*) >= 5)
SELECT {ts('s')} AS start, {ts('s + INTERVAL 1 DAY')} AS "end", n_tracks, {r('k/n_tracks')} AS mobile_fraction FROM m WHERE s + INTERVAL 1 DAY <= {CLOSED}""")
def stream_live_mobility(spark, d):
    return rounded(stamp(L.drain(L.live_mobility(L.event_stream(spark, d), F.col("mass") >= 50)), "start", "end"))


SESSION = """b AS (SELECT user_id AS particle, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY particle ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b),
s AS (SELECT particle, count(*) AS n, min(ts) AS f, max(ts) AS l FROM g GROUP BY particle, k)"""


@query("session_dwell", f"WITH {SESSION} SELECT particle, n, {ts('f')} AS first, {ts('l')} AS last, {r('epoch_us(l)/1e6 - epoch_us(f)/1e6', 3)} AS dwell_s FROM s")
def session_dwell(spark, d):
    return rounded(stamp(L.stream_dwell(L.observed(V.table(spark, d, "events"))), "first", "last"), digits=3)


@query("stream_dwell", f"WITH {SESSION} SELECT particle, n, {ts('f')} AS first, {ts('l')} AS last, {r('epoch_us(l)/1e6 - epoch_us(f)/1e6', 3)} AS dwell_s FROM s WHERE l + INTERVAL 6 HOUR <= {CLOSED}")
def stream_dwell(spark, d):
    return rounded(stamp(L.drain(L.stream_dwell(L.event_stream(spark, d))), "first", "last"), digits=3)


@query("stream_dedup", f"SELECT DISTINCT user_id AS particle, {ts('date_trunc($$hour$$, ts)')} AS frame FROM events")
def stream_dedup(spark, d):
    return stamp(L.drain(L.stream_dedup(L.event_stream(spark, d))).select("particle", "frame"), "frame")


@query("stream_link", f"""WITH RECURSIVE {NEAR1}, {greedy_sql('e1')}, {CHAIN}
SELECT CAST(l.recording_id AS VARCHAR) AS recording_id, loc_id, frame, root AS track FROM chain JOIN locs l ON loc_id = id
WHERE frame <= (SELECT max(frame) FROM locs) - 3""")
def stream_link(spark, d):
    schema = V.table(spark, d, "orders").schema
    o = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    locs = o.select((F.col("o_custkey") % 6).alias("recording_id"), F.col("o_orderkey").alias("loc_id"), (F.col("o_orderkey") % 200).cast("int").alias("frame"),
                    (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") % 512).cast("double").alias("y"))
    return L.drain(L.stream_link(locs, 30.0))
