"""Writers: run tables, exchange tables, statistics, and the run manifest."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lociflow.functions.text import json_safe
from lociflow.operators.tracks import dense_ids, log_d_clip
from lociflow.schema import D_FLOOR


def write_run_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as Parquet partitioned by recording. Only the recordings written
    are replaced; the file commit makes each replacement all or nothing."""
    for name, df in tables.items():
        w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (w.partitionBy("recording_id") if "recording_id" in df.columns else w).parquet(f"{root}/{name}")


def palmtracer_tracks(tracks: DataFrame) -> DataFrame:
    """Track rows in exchange form: ids renumbered from 1, planes from 1, and
    sentinels where the form asks for columns we have no value for."""
    numbered = dense_ids(tracks, ["recording_id"], "particle", "_id")
    return numbered.select("recording_id", (F.col("_id") + 1).alias("Track"), (F.col("frame") + 1).alias("Plane"),
                           F.col("x").alias("CentroidX(px)"), F.col("y").alias("CentroidY(px)"),
                           F.lit(-1.0).alias("CentroidZ(um)"), F.col("mass").alias("Integrated_Intensity"),
                           F.lit(0).alias("id"), F.lit(-1.0).alias("Pair_Distance"))


def palmtracer_d(diffusion: DataFrame, low: float = D_FLOOR, high: float = 100.0) -> DataFrame:
    """D table in exchange form: tracks that did not move sit at the floor; tracks
    without a usable D have blank values."""
    d = F.when(F.col("fit_status") == "nonpositive_slope", F.lit(low)).otherwise(F.col("D"))
    numbered = dense_ids(diffusion, ["recording_id"], "particle", "_id").withColumn("_d", d)
    return numbered.select("recording_id", F.lit(1).alias("ROI"), (F.col("_id") + 1).alias("Trace"), F.col("_d").alias("D"),
                           F.col("MSD0").alias("MSD(0)"), "MSE", log_d_clip(F.col("_d"), low, high).alias("LogD"))


def palmtracer_msd(msd: DataFrame) -> DataFrame:
    """One jagged line per track: region, trace, and its values by lag."""
    numbered = dense_ids(msd, ["recording_id"], "particle", "_id")
    values = F.transform(F.array_sort(F.collect_list(F.struct("lag", "msd"))), lambda s: F.format_string("%.6f", s["msd"]))
    return numbered.groupBy("recording_id", "_id").agg(values.alias("_v")).select(
        "recording_id", F.concat_ws(" ", F.lit("1"), (F.col("_id") + 1).cast("string"), F.array_join("_v", " ")).alias("value"))


def palmtracer_ratio(diffusion: DataFrame, d_threshold: float) -> DataFrame:
    """Mobile to immobile by measured D alone, as the exchange form defines it."""
    n = diffusion.where("D > 0").groupBy("recording_id").agg(
        F.count_if(F.col("D") >= d_threshold).alias("n_mobile"), F.count_if(F.col("D") < d_threshold).alias("n_immobile"))
    return n.withColumn("ratio", F.try_divide("n_mobile", "n_immobile"))


def export_palmtracer(tracks: DataFrame, diffusion: DataFrame, msd: DataFrame, root: str, d_threshold: float = 0.02) -> None:
    for name, df in (("trc", palmtracer_tracks(tracks)), ("D", palmtracer_d(diffusion)), ("ratio", palmtracer_ratio(diffusion, d_threshold))):
        df.write.mode("overwrite").partitionBy("recording_id").option("header", "true").option("sep", "\t").csv(f"{root}/{name}")
    palmtracer_msd(msd).write.mode("overwrite").partitionBy("recording_id").text(f"{root}/MSD")


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON with NULL for numbers JSON cannot carry, nulls written out."""
    return json_safe(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def export_stats(stats: DataFrame, summary: DataFrame, root: str) -> None:
    for name, df in (("stats", stats), ("summary", summary)):
        df.write.mode("overwrite").option("header", "true").csv(f"{root}/{name}.csv")
    json_lines(stats).write.mode("overwrite").text(f"{root}/stats.json")


def input_hashes(spark: SparkSession, path) -> DataFrame:
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def append_run(spark: SparkSession, params: dict, inputs: DataFrame, root: str) -> str:
    """Record a run: its parameters, versions and input hashes; returns its id.

    The recording of an input is its ``recording_id`` where ``inputs`` has that column, else its file's name
    without the ending, as the readers name recordings."""
    run_id = uuid.uuid4().hex
    text = json.dumps(params, sort_keys=True)
    named = F.col("recording_id") if "recording_id" in inputs.columns else F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    rows = inputs.select(F.lit(run_id).alias("run_id"), named.alias("recording_id"), "file", "length", "sha256", F.lit(text).alias("params"),
                         F.sha2(F.lit(text), 256).alias("params_hash"), F.lit(spark.version).alias("spark_version"),
                         F.current_timestamp().alias("at"))
    rows.write.mode("append").parquet(f"{root}/runs")
    return run_id


def not_yet_done(recordings: DataFrame, runs: DataFrame, params: dict) -> DataFrame:
    """Recordings without a run under the same parameters."""
    h = F.sha2(F.lit(json.dumps(params, sort_keys=True)), 256)
    return recordings.join(runs.where(F.col("params_hash") == h).select("recording_id"), "recording_id", "left_anti")
