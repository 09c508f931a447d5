import json

import pytest

from pyspark.sql import functions as F

from lociflow.operators import linking as L
from lociflow.plans.analyse import Params, run
from lociflow.plans.compare import compare
from lociflow.sources import sinks as W, tables as S
from lociflow.streaming import live as V


def test_tables_of_different_tools_read_together(spark, tmp_path):
    (tmp_path / "a_locPALMTracer.txt").write_text(
        "Width\tHeight\nnb\t512\nid\tPlane\tCentroidX(px)\tCentroidY(px)\tIntegrated_Intensity\n"
        "1\t1\t10.5\t3\t200\n2\t2\tNA\t3\t100\n\n3\t0\t1\t1\t5\n4\t3\t11\t4\t\n5\t9\n")
    (tmp_path / "b.csv").write_text('"frame","x [nm]","y [nm]","intensity [photon]"\n1,1000,500,7\n2,2000,500,8\n')
    (tmp_path / "c.csv").write_text("Label,TRACK_ID,POSITION_X,POSITION_Y,FRAME,QUALITY\nLabel,Track ID,X,Y,Frame,Quality\n"
                                    "(um),(),(um),(um),(),()\ns,3,0.2,0.4,0,9\ns,None,0.1,0.1,1,9\n")
    locs, bad = S.read_localisations(spark, str(tmp_path), pixel_size_um=0.1)
    got = sorted((r.recording_id, r.frame, round(r.x, 6), round(r.y, 6), r.mass) for r in locs.collect())
    assert got == [("a_locPALMTracer", 0, 10.5, 3.0, 200.0), ("a_locPALMTracer", 2, 11.0, 4.0, 1.0), ("b", 0, 10.0, 5.0, 7.0),
                   ("b", 1, 20.0, 5.0, 8.0), ("c", 0, 2.0, 4.0, 9.0), ("c", 1, 1.0, 1.0, 9.0)]
    assert sorted(r.reason for r in bad.where("file like '%PALM%'").collect()) == ["blank", "negative frame", "not a number", "not a number"] \
        or bad.where("file like '%PALM%'").count() == 4
    tracked = locs.where("track is not null and recording_id = 'c'")
    assert [r.track for r in tracked.orderBy("frame").collect()] == ["3", "None"]


def test_custom_columns_and_unknown_layout(spark, tmp_path):
    (tmp_path / "z.csv").write_text("when;px;py\n0;1;2\n")
    assert S.read_localisations(spark, str(tmp_path))[0].count() == 0
    locs, _ = S.read_localisations(spark, str(tmp_path), column_map={"frame": "when", "x": "px", "y": "py"})
    assert [(r.frame, r.x, r.y) for r in locs.collect()] == [(0, 1.0, 2.0)]


def test_probe(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("a\nb\n")
    (tmp_path / "bin.txt").write_bytes(b"\0" * 90 + b"\n" * 10)
    (tmp_path / "flat.txt").write_text("abc")
    (tmp_path / "empty.txt").write_text("")           # Spark lists no empty files
    got = {r.file.rsplit("/", 1)[1]: r.problem for r in S.probe_table(spark, str(tmp_path)).collect()}
    assert got == {"ok.txt": None, "bin.txt": "binary", "flat.txt": "no line breaks"}


def test_exchange_tables_round_trip(spark, tmp_path):
    rows = "\n".join(f"{i}\t5\t{i + 1}\t{i}.5\t2\t9" for i in range(10))
    (tmp_path / "r1_trcPALMTracer.txt").write_text(f"Width\tHeight\n512\t256\nid\tTrack\tPlane\tCentroidX(px)\tCentroidY(px)\tIntegrated_Intensity\n{rows}\n10\t6\t1\t0\t0\t1\n")
    tracks, meta = S.read_palmtracer(spark, str(tmp_path))
    assert {(r.particle, r.frame) for r in tracks.collect()} == {(5, f) for f in range(10)}
    assert meta.first().metadata == {"Width": "512", "Height": "256"}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "q-D.txt").write_text("# c\n1 7 0.5 0.1 0.01 -0.3\n1 8 bad 1 1\n")
    (tmp_path / "d2").mkdir()
    (tmp_path / "d2" / "q-MSD.txt").write_text("1 7 0.1 0.2 0.4\n1 8 0.3\n")
    assert [(r.particle, r.D, r.logD) for r in S.read_native(spark, str(tmp_path / "d"), "D").collect()] == [(7, 0.5, -0.3)]
    assert sorted((r.particle, r.lag, r.msd) for r in S.read_native(spark, str(tmp_path / "d2"), "MSD").collect()) == [
        (7, 1, 0.1), (7, 2, 0.2), (7, 3, 0.4), (8, 1, 0.3)]


def walks(spark, n=8):
    import numpy as np
    rng = np.random.default_rng(0)
    rows, k = [], 0
    for rec in range(n):
        for p in range(4):
            xy = np.cumsum(rng.normal(0, 0.5 + 0.5 * (rec % 2), (25, 2)), 0) + 40 * p
            for f, (x, y) in enumerate(xy):
                rows.append((str(rec), k, f, float(x), float(y), 3.0))
                k += 1
    return spark.createDataFrame(rows, "recording_id string, loc_id long, frame int, x double, y double, mass double")


def test_whole_analysis_comparison_and_run_folder(spark, tmp_path):
    out = run(walks(spark), Params(0.1, 0.02, search_range=6.0, memory=0, min_len=8, cluster_eps_um=0.2))
    s = out["summary"].collect()
    assert len(s) == 8 and all(r.n_tracks >= 4 and r.median_d > 0 for r in s)
    assert {f["level"] for r in out["qc"].collect() for f in r.flags} <= {"warn", "info"}
    root = str(tmp_path / "run")
    W.write_run_tables({"summary": out["summary"].drop("motion_counts", "fit_status_counts"), "tracks": out["tracks"]}, root)
    back = S.read_run(spark, root, ["3"])
    assert set(back) == {"summary", "tracks"} and back["summary"].count() == 1
    W.write_run_tables({"tracks": out["tracks"].where("recording_id = '3'").limit(5)}, root)
    n = {r.recording_id: r.n for r in S.read_run(spark, root)["tracks"].groupBy(F.col("recording_id").cast("string").alias("recording_id")).agg(F.count("*").alias("n")).collect()}
    assert n["3"] == 5 and n["2"] > 90                      # only the partition written was replaced
    rec = out["replicates"].select("recording_id").withColumns({
        "group": F.col("recording_id").cast("int") % 2, "timepoint": F.floor(F.col("recording_id").cast("int") / 2) % 2,
        "cell": F.floor(F.col("recording_id").cast("int") / 4)})
    res = compare(out["replicates"].withColumn("metrics_schema_version", F.lit(3)), rec, {"parametric_strategy": "force_parametric"})
    p = {r.metric: r for r in res["pairwise"].collect()}
    assert p["median_d"].mean_i < p["median_d"].mean_j and p["median_d"].p < 0.05
    W.export_stats(res["pairwise"], out["summary"].drop("motion_counts", "fit_status_counts"), str(tmp_path / "stats"))
    assert all("p" in json.loads(r.value) for r in spark.read.text(str(tmp_path / "stats" / "stats.json")).collect())


def test_summaries_are_gathered(spark, tmp_path):
    for g, n in (("ctrl", 4), ("drug", 6)):
        d = tmp_path / g / "rec1"
        d.mkdir(parents=True)
        (d / "x_summary_metrics.json").write_text(json.dumps({
            "stem": "x", "n_tracks": n, "motion_counts": {"Immobile": 1, "Directed": n}, "qc": {"link_ratio": 0.5, "flags": [{"level": "warn", "msg": "m"}]}}))
    r = {x.group: x for x in S.aggregate_run_summaries(spark, str(tmp_path)).collect()}
    assert (r["drug"].n_tracks, r["drug"].n_directed, r["ctrl"].n_confined, r["ctrl"].n_qc_flags, r["ctrl"].qc_link_ratio) == (6, 6, 0, 1, 0.5)


def test_manifest_skips_finished_recordings(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\n")
    h = W.input_hashes(spark, str(tmp_path / "in"))
    assert h.first().sha256 == "73cb3858a687a8494ca3323053016282f3dad39d42cf62ca4e79dda2aac7d9ac"
    W.append_run(spark, {"r": 1}, h, str(tmp_path))
    runs = spark.read.parquet(str(tmp_path / "runs"))
    recs = spark.createDataFrame([("a",), ("b",)], "recording_id string")
    assert [r.recording_id for r in W.not_yet_done(recs, runs, {"r": 1}).collect()] == ["b"]
    assert W.not_yet_done(recs, runs, {"r": 2}).count() == 2


@pytest.mark.parametrize("cut", ["frame < 9", "frame < 9 OR frame = 12 AND loc_id % 2 = 0", "loc_id % 3 = 0"])
def test_stream_link_equals_batch_under_any_split(spark, tmp_path, cut):
    """Rows arrive in two files, frames split between them; open tracks live on between micro-batches."""
    locs = walks(spark, 3).drop("mass")
    for k, part in enumerate((locs.where(cut), locs.where(f"NOT ({cut})"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(locs.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    got = V.drain(V.stream_link(stream, 6.0, late=40)).collect()
    assert got == []                                        # every frame may still grow
    end = spark.createDataFrame([("end", 10 ** 6, 1000, 0.0, 0.0)], locs.schema)
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(locs.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    got = V.drain(V.stream_link(stream, 6.0, late=40)).collect()
    batch = L.link_nn(locs, 6.0).collect()
    groups = lambda rows, k: sorted(sorted(x.loc_id for x in rows if (x.recording_id, x[k]) == g) for g in {(x.recording_id, x[k]) for x in rows})
    assert groups(got, "track") == groups(batch, "particle")


def test_progress_records_failures(spark, tmp_path):
    walks(spark, 2).select("recording_id").distinct().coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("recording_id string").parquet(str(tmp_path / "in"))

    def broken(batch):
        raise ValueError("no frames")
    V.run_progress(stream, broken, str(tmp_path / "runs"), str(tmp_path / "ck")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "runs")).collect()
    assert len(rows) == 2 and {r.status for r in rows} == {"error"} and "no frames" in rows[0].message


def test_progress_marks_only_the_recording_at_fault(spark, tmp_path):
    walks(spark, 4).select("recording_id").distinct().coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("recording_id string").parquet(str(tmp_path / "in"))

    def strict(batch):
        if batch.where("recording_id = '2'").count():
            raise ValueError("bad recording")
    V.run_progress(stream, strict, str(tmp_path / "runs"), str(tmp_path / "ck")).awaitTermination()
    rows = {r.recording_id: r.status for r in spark.read.parquet(str(tmp_path / "runs")).collect()}
    assert rows == {"0": "done", "1": "done", "2": "error", "3": "done"}


def test_analysis_carries_states_and_drift_into_its_tables(spark):
    import numpy as np
    r = np.random.default_rng(5)
    rows, k = [], 0
    for rec in range(2):
        beads = r.uniform(5, 60, (12, 2))
        for f in range(400):
            for b in beads + [0.02 * f, -0.01 * f] + r.normal(0, 0.02, beads.shape):
                rows.append((str(rec), k, f, float(b[0]), float(b[1]), 3.0))
                k += 1
    locs = spark.createDataFrame(rows, "recording_id string, loc_id long, frame int, x double, y double, mass double")
    out = run(locs, Params(0.16, 0.02, search_range=3.0, memory=0, min_len=8, drift="rcc", states=True))
    assert out["drift"].where("status = 'applied'").count() > 0
    assert {f["msg"].split(":")[0] for q in out["qc"].collect() for f in q.flags} >= {"stage moved"}
    table = out["replicates"].collect()
    assert len(table) == 2 and all(row.state_best_n is not None and row.state_D_slow is not None for row in table)
