"""Readers of localisation and track tables written by other tools, and of runs."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lociflow.functions.text import part_number, series_key
from lociflow.operators.tracks import filter_track_length
from lociflow.schema import ContractError
from lociflow.session import cut_lineage

# Column names of the tools whose tables are read, most specific
# first; the frame number their first frame has; and the unit of positions.
PRESETS: dict[str, dict] = {
    "PALM-Tracer": {
        "frame": ("Plane", "Frame", "frame", "Slice", "T", "t"), "frame_offset": -1,
        "x": ("CentroidX(px)", "Centroid X", "Centroid_X", "X", "x", "Position X"),
        "y": ("CentroidY(px)", "Centroid Y", "Centroid_Y", "Y", "y", "Position Y"), "unit": "px",
        "mass": ("Integrated_Intensity", "IntegratedIntensity", "Integrated Intensity", "Mass", "Amp", "Amplitude", "Intensity", "mass"),
        "track": ("Track", "track", "Trajectory", "trajectory")},
    "ThunderSTORM": {
        "frame": ("frame", "Frame"), "frame_offset": -1, "x": ("x [nm]", "x_nm", "x"), "y": ("y [nm]", "y_nm", "y"), "unit": "nm",
        "mass": ("intensity [photon]", "intensity", "photons")},
    "Picasso": {
        "frame": ("frame",), "frame_offset": 0, "x": ("x", "x_pix"), "y": ("y", "y_pix"), "unit": "px",
        "mass": ("photons", "photon", "intensity")},
    "TrackMate": {
        "frame": ("FRAME", "frame", "Frame"), "frame_offset": 0, "x": ("POSITION_X", "Position X", "X", "x"),
        "y": ("POSITION_Y", "Position Y", "Y", "y"), "unit": "um",
        "mass": ("MEAN_INTENSITY_CH1", "TOTAL_INTENSITY_CH1", "Mean intensity ch1", "Sum intensity ch1", "QUALITY", "Quality"),
        "track": ("TRACK_ID", "Track ID")},
}
ROLES = ("frame", "x", "y", "mass", "track")
SEPARATORS = ("\t", ",", ";")
HEAD_LINES = 20


def detect_preset(columns: list[str], presets: dict[str, dict] = PRESETS) -> tuple[str, dict[str, int]] | None:
    """First tool whose frame, x and y columns are all there, with the position of
    each known column."""
    at = {c: i for i, c in reversed(list(enumerate(columns)))}
    for name, spec in presets.items():
        found = {role: next((at[a] for a in spec.get(role, ()) if a in at), None) for role in ROLES}
        if all(found[r] is not None for r in ("frame", "x", "y")):
            return name, {k: v for k, v in found.items() if v is not None}
    return None


def text_lines(spark: SparkSession, path) -> DataFrame:
    """``(file, first_block, value)`` of every line."""
    t = spark.read.option("recursiveFileLookup", "true").text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("first_block"), "value")


def sniff_layouts(lines: DataFrame, preset: str | None = None, column_map: dict[str, str] | None = None) -> DataFrame:
    """Layout of every file from its first lines: header, separator, tool and the
    place of each column; ``skip`` holds the lines up to and including the header.
    Lines of a file's first block arrive in order."""
    presets = dict(PRESETS)
    if column_map:
        spec = {role: (c,) for role, c in column_map.items() if role in ROLES}
        presets = {"Custom": {"frame_offset": 0, "unit": "px", **spec}}
    elif preset:
        if preset not in presets:
            raise ContractError(f"unknown preset {preset!r}")
        presets = {preset: presets[preset]}

    def layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[str]] = {}
        done: set[str] = set()
        for pdf in batches:
            out = []
            for file, value in zip(pdf["file"], pdf["value"]):
                if file in done or len(seen.setdefault(file, [])) >= HEAD_LINES:
                    continue
                seen[file].append(value)
                for sep in (*SEPARATORS, None):
                    columns = [c.strip().strip('"') for c in (value.split(sep) if sep else value.split())]
                    hit = detect_preset(columns, presets) if len(columns) >= 3 else None
                    if hit:
                        name, at = hit
                        out.append([file, name, re.escape(sep) if sep else r"\s+", len(columns), list(seen[file]),
                                    *[at.get(role) for role in ROLES], float(presets[name]["frame_offset"]), presets[name]["unit"]])
                        done.add(file)
                        break
            if out:
                frame = pd.DataFrame(out, columns=["file", "preset", "sep", "n_columns", "skip", *[f"i_{r}" for r in ROLES], "offset", "unit"])
                yield frame.astype({f"i_{r}": "object" for r in ROLES})
    places = ", ".join(f"i_{r} int" for r in ROLES)
    return lines.where("first_block").select("file", "value").mapInPandas(
        layouts, f"file string, preset string, sep string, n_columns int, skip array<string>, {places}, offset double, unit string")


def recording_name(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def parse_localisations(lines: DataFrame, layouts: DataFrame, pixel_size_um: float | None = None,
                        frame_offset: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(localisations, rejected lines). Extra header rows, blank and ragged lines
    and bad numbers are rejected one by one with a reason."""
    j = lines.select("file", "value").join(layouts, "file").where(~F.array_contains("skip", F.col("value")))
    # the separator is one of four known patterns, so each split stays a literal
    cells = F.lit(None)
    for pattern in (*[re.escape(s) for s in SEPARATORS], r"\s+"):
        cells = F.when(F.col("sep") == pattern, F.split(F.trim("value") if pattern == r"\s+" else F.col("value"), pattern)).otherwise(cells)
    j = j.withColumn("_c", cells)
    raw = {role: F.trim(F.get("_c", F.col(f"i_{role}"))) for role in ROLES}
    j = j.select("file", "value", "unit", "offset", "i_mass", "i_track", F.size("_c").alias("_n"), "n_columns", *[c.alias(k) for k, c in raw.items()])
    loc, bad = normalise_units(j.withColumn("recording_id", recording_name(F.col("file"))), pixel_size_um, frame_offset)
    return loc, bad.select("file", "value", "reason")


def normalise_units(raw: DataFrame, pixel_size_um: float | None = None,
                    frame_offset: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Text columns frame, x, y, mass, track with ``offset`` and ``unit`` → the
    canonical types. Missing mass becomes 1; rows without a number, or before the
    first frame, are returned apart with the reason."""
    num = lambda c: F.col(c).try_cast("double")                                   # noqa: E731
    off = F.lit(float(frame_offset)) if frame_offset is not None else F.col("offset")
    px = F.lit(None if pixel_size_um is None else float(pixel_size_um)).cast("double")
    per_px = F.when(F.col("unit") == "nm", px * 1000).when(F.col("unit") == "um", px).otherwise(1.0)
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    t = raw.withColumns({"_f": num("frame"), "_x": num("x"), "_y": num("y"), "_m": num("mass"), "_per": per_px})
    reason = (F.when(F.trim(F.coalesce("frame", F.lit(""))) == "", "blank").when(~(good("_f") & good("_x") & good("_y")), "not a number")
              .when(F.col("_per").isNull(), "pixel size needed").when(F.col("_f") + off < 0, "negative frame"))
    t = t.withColumn("reason", reason)
    track = [F.col("track").alias("track")] if "track" in raw.columns else []
    extra = [c for c in ("loc_id",) if c in raw.columns]
    ok = t.where("reason IS NULL").select(
        "recording_id", *extra, (F.col("_f") + off).cast("int").alias("frame"), (F.col("_x") / F.col("_per")).alias("x"),
        (F.col("_y") / F.col("_per")).alias("y"), F.coalesce(F.when(~F.isnan("_m"), F.col("_m")), F.lit(1.0)).alias("mass"), *track)
    return ok, t.where("reason IS NOT NULL").drop("_f", "_x", "_y", "_m", "_per")


def read_localisations(spark: SparkSession, path, preset: str | None = None, pixel_size_um: float | None = None,
                       column_map: dict[str, str] | None = None, frame_offset: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(localisations, rejected lines) of all files below a path, each in the
    layout of its own tool."""
    lines = text_lines(spark, path)
    return parse_localisations(lines, sniff_layouts(lines, preset, column_map), pixel_size_um, frame_offset)


def probe_table(spark: SparkSession, path) -> DataFrame:
    """Which files look like text tables, judged by their first 64 KB."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.decode(F.substring("content", 1, 65536), "ISO-8859-1")
    nul = F.length(F.regexp_replace(head, "[^\\x00]", "")) / F.length(head)
    problem = (F.when(F.col("length") == 0, "empty").when(nul > 0.25, "binary").when(~F.contains(head, F.lit("\n")), "no line breaks"))
    return f.select(F.col("path").alias("file"), "length", problem.alias("problem"), problem.isNull().alias("usable"))


def read_palmtracer(spark: SparkSession, path, min_len: int = 8) -> tuple[DataFrame, DataFrame]:
    """(tracks or localisations, recordings) of tables with two metadata lines
    (names, values) before the header. Tables with tracks keep those of at least
    ``min_len`` observations."""
    lines = text_lines(spark, path)
    layouts = sniff_layouts(lines, "PALM-Tracer")
    locs, _ = parse_localisations(lines, layouts)
    names, values = F.split(F.get("skip", F.lit(0)), "\t"), F.split(F.get("skip", F.lit(1)), "\t")
    meta = layouts.where(F.size("skip") >= 3).select(recording_name(F.col("file")).alias("recording_id"),
                                                    F.map_from_entries(F.arrays_zip(names.alias("k"), values.alias("v"))).alias("metadata"))
    tracked = locs.where(F.col("track").isNotNull())
    out = locs.drop("track") if tracked.isEmpty() else filter_track_length(
        tracked.withColumn("particle", F.col("track").try_cast("double").cast("long")).where("particle >= 0").drop("track"), min_len)
    return out, meta


def parse_native_d(lines: DataFrame) -> DataFrame:
    """``(recording_id, particle, D, MSD0, MSE, logD)`` from whitespace tables of
    region, trace, D, MSD(0), MSE and perhaps log D; comments skipped."""
    c = lines.withColumn("_c", F.split(F.trim("value"), r"\s+")).where(~F.startswith(F.ltrim("value"), F.lit("#")))
    n = lambda i: F.get("_c", F.lit(i)).try_cast("double")                         # noqa: E731
    return c.where((F.size("_c") >= 5) & n(1).isNotNull() & n(2).isNotNull()).select(
        "recording_id", n(1).cast("long").alias("particle"), n(2).alias("D"), n(3).alias("MSD0"), n(4).alias("MSE"), n(5).alias("logD"))


def parse_native_msd(lines: DataFrame) -> DataFrame:
    """``(recording_id, particle, lag, msd)`` from rows of region, trace and as many
    values as the track has lags."""
    c = lines.where(~F.startswith(F.ltrim("value"), F.lit("#"))).withColumn("_c", F.split(F.trim("value"), r"\s+"))
    c = c.where((F.size("_c") >= 3) & F.get("_c", F.lit(1)).try_cast("double").isNotNull())
    return c.select("recording_id", F.get("_c", F.lit(1)).try_cast("double").cast("long").alias("particle"),
                    F.posexplode(F.slice("_c", F.lit(3), F.size("_c") - 2)).alias("_p", "_v")).select(
        "recording_id", "particle", (F.col("_p") + 1).alias("lag"), F.col("_v").try_cast("double").alias("msd")).where("msd IS NOT NULL")


def read_native(spark: SparkSession, path, kind: str) -> DataFrame:
    lines = text_lines(spark, path).withColumn("recording_id", recording_name(F.col("file")))
    return {"D": parse_native_d, "MSD": parse_native_msd}[kind](lines)


def overlay_native_d(own: DataFrame, native: DataFrame) -> DataFrame:
    """Imported D, MSD0, MSE and log D where there are any; alpha and motion stay."""
    names = [c for c in ("D", "MSD0", "MSE", "logD") if c in native.columns]
    other = native.select("recording_id", "particle", *[F.col(c).alias(f"_{c}") for c in names])
    j = own.join(other, ["recording_id", "particle"], "left")
    return j.withColumns({c: F.coalesce(f"_{c}", F.col(c)) if c in own.columns else F.col(f"_{c}") for c in names}) \
        .drop(*[f"_{c}" for c in names])


# ---- runs -----------------------------------------------------------------------------
DEFAULT_PIXEL_UM, DEFAULT_INTERVAL_S = 0.106, 0.02


def resolve_calibration(recordings: DataFrame) -> DataFrame:
    """Pixel size and frame interval from the summary, else the parameters, else a
    default that is marked."""
    def pick(*names: str) -> Column:
        have = [F.col(n) for n in names if n in recordings.columns]
        return F.coalesce(*have, F.lit(None).cast("double"))
    px, dt = pick("px_um", "pixel_size_um"), pick("fi_s", "frame_interval_s")
    return recordings.withColumns({
        "calibration_defaulted": px.isNull() | dt.isNull(), "px_um": F.coalesce(px, F.lit(DEFAULT_PIXEL_UM)),
        "fi_s": F.coalesce(dt, F.lit(DEFAULT_INTERVAL_S))})


def read_run(spark: SparkSession, root: str, recordings: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a run folder that exist, optionally of some recordings only
    (partitions of others are not read)."""
    out = {}
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(base):                     # one entry per table
        name = status.getPath().getName()
        if status.isDirectory() and not name.startswith(("_", ".")):
            t = spark.read.parquet(f"{root}/{name}")
            out[name] = t.where(F.col("recording_id").isin(recordings)) if recordings and "recording_id" in t.columns else t
    return out


def run_summary_rows(summaries: DataFrame, file: Column) -> DataFrame:
    """One flat row per run from nested summaries: motion counts as columns, the
    quality numbers, the number of flags, and the folder two levels up as group."""
    fields = set(summaries.columns)
    counts = [F.coalesce(F.try_element_at("motion_counts", F.lit(m)), F.lit(0)).alias(f"n_{m.lower()}")
              for m in ("Immobile", "Confined", "Brownian", "Directed", "Unknown")] if "motion_counts" in fields else []
    qc = []
    if "qc" in fields:
        qc = [F.col(f"qc.{f.name}").alias(f"qc_{f.name}") for f in summaries.schema["qc"].dataType if f.name != "flags"]
        qc.append(F.coalesce(F.size("qc.flags"), F.lit(0)).alias("n_qc_flags"))
    plain = [c for c in summaries.columns if c not in ("motion_counts", "qc", "fit_status_counts")]
    return summaries.select(*plain, *counts, *qc, F.regexp_extract(file, r"([^/]+)/[^/]+/[^/]+$", 1).alias("group"))


def aggregate_run_summaries(spark: SparkSession, root: str, pattern: str = "*_summary_metrics.json") -> DataFrame:
    """Every summary file below a folder as one table."""
    schema_hint = "motion_counts MAP<STRING,BIGINT>, fit_status_counts MAP<STRING,BIGINT>"
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("multiLine", "true")
    inferred = reader.json(root).schema
    from pyspark.sql import types as T
    fixed = T.StructType([f for f in inferred if f.name not in ("motion_counts", "fit_status_counts")])
    for f in T.StructType.fromDDL(schema_hint):
        if f.name in inferred.fieldNames():
            fixed = fixed.add(f)
    t = reader.schema(fixed).json(root)
    return run_summary_rows(t.withColumn("_file", F.col("_metadata.file_path")), F.col("_file")).drop("_file")


# ---- input catalogue --------------------------------------------------------------------
IMAGE_EXT, TABLE_EXT = ("tif", "tiff", "czi"), ("csv", "txt", "tsv")
AUX_ENDINGS = ("_summary_metrics.csv", "_diffusion_summary.csv", "_ensemble_msd.csv", "_turning_angles.csv", "_trajectories.csv")


def input_kind(name: Column) -> Column:
    """image, external_loc, or NULL for what is not an input."""
    low = F.lower(F.substring_index(F.translate(name, "\\", "/"), "/", -1))      # cheap, for every test below repeats it
    image = low.rlike(rf"\.({'|'.join(IMAGE_EXT)})$") & ~F.contains(low, F.lit("-tracks-z"))
    aux = F.contains(low, F.lit("trcpalmtracer"))
    for e in AUX_ENDINGS:
        aux = aux | F.endswith(low, F.lit(e))
    table = low.rlike(rf"\.({'|'.join(TABLE_EXT)})$") & ~aux
    return F.when(F.startswith(low, F.lit("._")), None).when(image, "image").when(table, "external_loc")


def filter_input_paths(paths: DataFrame, analysis_folders: tuple[str, ...] = ("figures", "data", "extras")) -> DataFrame:
    """``(path, kind)`` of the inputs outside analysis folders."""
    pruned = paths.where(~F.col("path").rlike(rf"(?i)(^|/)({'|'.join(map(re.escape, analysis_folders))})/"))
    return pruned.withColumn("kind", input_kind(F.col("path"))).where("kind IS NOT NULL")


def catalogue_inputs(paths: DataFrame, companion_suffix: str = "_green") -> DataFrame:
    """Acquisitions: the parts of each in natural order under one unique key.

    A companion image (same name plus a suffix) folds into the recording it
    accompanies; within one image series the CZI wins over TIFF copies; tables
    are never merged with images.
    """
    f = filter_input_paths(paths.repartition("path"))      # a listing packs into one small file, so one task would parse it all
    f = f.withColumn("leaf", F.substring_index("path", "/", -1))
    f = f.withColumn("folder", F.expr("left(path, length(path) - length(leaf) - 1)"))
    stem = F.regexp_replace("leaf", r"\.[^.]*$", "")
    f = f.withColumns({"series": F.when(F.col("kind") == "image", series_key(F.col("leaf"))).otherwise(stem),
                       "is_czi": F.endswith(F.lower("leaf"), F.lit(".czi")), "part": part_number(F.col("leaf")), "stem": stem})
    f = cut_lineage(f)                                      # read three times below
    owner = f.where("kind = 'image'").select("folder", (F.concat(F.lower("stem"), F.lit(companion_suffix.lower()))).alias("_c"))
    f = f.withColumn("_c", F.lower("stem")).join(owner, ["folder", "_c"], "left_anti").drop("_c")
    key = ["folder", "kind", "series"]
    best = f.groupBy(*key).agg(F.max("is_czi").alias("_czi"))
    f = f.join(best, key).where("is_czi = _czi OR kind <> 'image'")
    # the files of one acquisition
    parts = f.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "path"))), lambda s: s["path"]).alias("parts"))
    again = F.row_number().over(W.partitionBy("series").orderBy("folder", "kind"))
    return parts.withColumn("_k", again).select(
        F.when(F.col("_k") == 1, F.col("series")).otherwise(F.concat_ws("_", "series", F.col("_k").cast("string"))).alias("key"),
        "folder", "kind", "series", "parts", F.size("parts").alias("n_parts"))


def concatenate_series(frames: DataFrame) -> DataFrame:
    """Frames of multi-part movies as one movie: parts in natural order, frame
    numbers running on. ``(recording_id, part, frame, …)``."""
    sizes = frames.groupBy("recording_id", "part").agg((F.max("frame") + 1).alias("_n"))
    before = W.partitionBy("recording_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    at = sizes.select("recording_id", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return frames.join(at, ["recording_id", "part"]).withColumn("frame", (F.col("frame") + F.col("_off")).cast("int")).drop("_off", "part")


def read_frames(frames: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """A half-open frame range of movies kept as one array per frame."""
    out = frames if start is None else frames.where(F.col("frame") >= start)
    return out if end is None else out.where(F.col("frame") < end)
