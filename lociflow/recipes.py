"""Localisation and track views over the test tables (see FIXTURES.md)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lociflow.session import cut_lineage

PIXEL_SIZE = 0.01
FRAME_INTERVAL = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as observations of tracks, duplicates still in."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", (F.col("user_id") % 24).alias("recording_id"),
        F.col("user_id").alias("particle"),
        F.expr("cast(timestampdiff(HOUR, timestamp_ntz'2024-01-01', ts) as int)").alias("frame"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.col("value").alias("mass"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per (particle, frame): the earliest event."""
    return (observations(spark, sf_dir).groupBy("recording_id", "particle", "frame")
            .agg(*[F.min_by(c, "event_id").alias(c) for c in ("x", "y", "mass")]))


def stored_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks written once, for plans that read them several times."""
    return cut_lineage(tracks(spark, sf_dir))


def localisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as localisations: six recordings of two hundred frames."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % 6).alias("recording_id"), F.col("o_orderkey").alias("loc_id"),
        (F.col("o_orderkey") % 200).cast("int").alias("frame"),
        (F.col("o_totalprice") / 1000).alias("x"),
        (F.col("o_custkey") % 512).cast("double").alias("y"),
        F.col("o_totalprice").alias("mass"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("recording_id"),
                    F.col("vec_id").alias("loc_id"),
                    F.col("embedding")[0].cast("double").alias("x"),
                    F.col("embedding")[1].cast("double").alias("y"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as 8×8 frames, one row per pixel."""
    e = table(spark, sf_dir, "embeddings")
    return (e.select(F.col("vec_id").cast("int").alias("frame"), F.posexplode("embedding").alias("_p", "_v"))
            .select(F.lit(0).cast("long").alias("recording_id"), "frame", F.floor(F.col("_p") / 8).cast("int").alias("y"),
                    (F.col("_p") % 8).cast("int").alias("x"), F.col("_v").cast("double").alias("v")))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, time point and cell of each recording that has tracks."""
    r = table(spark, sf_dir, "events").select((F.col("user_id") % 24).alias("recording_id")).distinct()
    return r.select("recording_id", (F.col("recording_id") % 3).alias("group"),
                    (F.floor(F.col("recording_id") / 3) % 2).alias("timepoint"),
                    F.floor(F.col("recording_id") / 6).alias("cell"))


# The same views for the SQL check.
SQL_OBSERVATIONS = """
observations AS (
  SELECT event_id, user_id % 24 AS recording_id, user_id AS particle,
         CAST(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS INTEGER) AS frame,
         value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, value AS mass
  FROM events)"""
SQL_TRACKS = SQL_OBSERVATIONS + """,
tracks AS (
  SELECT recording_id, particle, frame, arg_min(x, event_id) AS x,
         arg_min(y, event_id) AS y, arg_min(mass, event_id) AS mass
  FROM observations GROUP BY recording_id, particle, frame)"""
SQL_LOCS = """
locs AS (
  SELECT o_custkey % 6 AS recording_id, o_orderkey AS loc_id,
         CAST(o_orderkey % 200 AS INTEGER) AS frame, o_totalprice / 1000 AS x,
         CAST(o_custkey % 512 AS DOUBLE) AS y, o_totalprice AS mass FROM orders)"""
SQL_POINTS = """
points AS (
  SELECT CAST(label AS BIGINT) AS recording_id, vec_id AS loc_id, CAST(embedding[1] AS DOUBLE) AS x,
         CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"""
SQL_PIXELS = """
pixels AS (
  SELECT CAST(vec_id AS INTEGER) AS frame, CAST((i - 1) // 8 AS INTEGER) AS y,
         CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""
SQL_ASSIGN = """
assignments AS (
  SELECT DISTINCT user_id % 24 AS recording_id, (user_id % 24) % 3 AS "group",
         ((user_id % 24) // 3) % 2 AS timepoint, (user_id % 24) // 6 AS cell FROM events)"""
