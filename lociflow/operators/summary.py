"""Per-recording summaries, quality flags and the replicate table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lociflow.functions.distribution import distribution, medians, cumulative_fraction
from lociflow.operators import diffusion as D, steps as S
from lociflow.schema import METRICS_SCHEMA_VERSION, MOBILE_D_THRESHOLD, TRACK_KEY

REC = "recording_id"


def count_map(df: DataFrame, column: str, out: str) -> DataFrame:
    """``map(value → count)`` of a small-vocabulary column, per recording."""
    counts = df.groupBy(REC, F.coalesce(column, F.lit("unknown")).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(REC).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("_k", "_n")))).alias(out))


def summary_metrics(tracks: DataFrame, diffusion: DataFrame, locs: DataFrame, frame_interval: float,
                    d_threshold: float = MOBILE_D_THRESHOLD) -> DataFrame:
    """Headline scalars and count maps of each recording."""
    n_locs = locs.groupBy(REC).agg(F.count(F.lit(1)).alias("n_locs"),
                                   (F.max("frame") + 1).alias("frames"))
    durations = D.track_durations(tracks, frame_interval).groupBy(REC).agg(
        F.avg("observed_time_s").alias("mean_observed_time_s"),
        F.avg("track_duration_s").alias("mean_track_duration_s"))
    counts = diffusion.groupBy(REC).agg(
        F.count(F.lit(1)).alias("n_tracks"),
        F.count_if(F.col("fit_status") == "below_resolution").alias("n_below_resolution"))
    mobility = D.mobility_summary(diffusion, d_threshold).select(
        REC, "median_d", "median_alpha", "mobile_fraction")
    return (n_locs.join(counts, REC, "left").join(durations, REC, "left").join(mobility, REC, "left")
            .join(count_map(diffusion, "motion", "motion_counts"), REC, "left")
            .join(count_map(diffusion, "fit_status", "fit_status_counts"), REC, "left")
            .withColumn("metrics_schema_version", F.lit(METRICS_SCHEMA_VERSION)))


def qc_metrics(tracks: DataFrame, diffusion: DataFrame, locs: DataFrame) -> DataFrame:
    """Measurements behind the quality flags."""
    n_locs = locs.groupBy(REC).agg(F.count(F.lit(1)).alias("n_locs"), (F.max("frame") + 1).alias("_frames"))
    per = tracks.groupBy(*TRACK_KEY).agg(F.count(F.lit(1)).alias("_len"),
                                         (F.max("frame") - F.min("frame") + 1).alias("_span"))
    of_tracks = per.groupBy(REC).agg(F.sum("_len").alias("n_tracked_locs"),
                                     F.avg((F.col("_span") > F.col("_len")).cast("double")).alias("gap_fraction"))
    stuck = diffusion.where(F.col("D") > 0).groupBy(REC).agg(
        F.avg((F.col("D") < 1e-3).cast("double")).alias("stuck_fraction"))
    return (n_locs.join(of_tracks, REC, "left").join(medians(per, [REC], {"median_track_length": "_len"}), REC, "left")
            .join(stuck, REC, "left")
            .select(REC, "n_locs", F.coalesce("n_tracked_locs", F.lit(0)).alias("n_tracked_locs"),
                    F.try_divide(F.coalesce("n_tracked_locs", F.lit(0)), "n_locs").alias("link_ratio"),
                    (F.col("n_locs") / F.col("_frames")).alias("avg_locs_per_frame"),
                    "median_track_length", "gap_fraction", "stuck_fraction"))


def qc_flags(qc: DataFrame) -> DataFrame:
    """``flags``: array of {level, msg} for every measurement out of its range.
    ``drift_total_nm`` is judged when the table has it."""
    def flag(when: Column, level: str, msg: Column) -> Column:
        return F.when(when, F.struct(F.lit(level).alias("level"), msg.alias("msg")))
    checks = [
        flag(F.col("link_ratio") < 0.10, "warn", F.format_string(
            "linked share low: %.1f%% of the localisations are in a track", F.col("link_ratio") * 100)),
        flag(F.col("avg_locs_per_frame") > 800, "warn", F.format_string(
            "crowded: %.0f localisations a frame", F.col("avg_locs_per_frame"))),
        flag(F.col("median_track_length") < 6, "warn", F.format_string(
            "short tracks: half have %.1f frames or fewer", F.col("median_track_length"))),
        flag(F.col("stuck_fraction") > 0.30, "warn", F.format_string(
            "still spots: D is under 0.001 in %.1f%% of the tracks", F.col("stuck_fraction") * 100)),
        flag(F.col("gap_fraction") > 0.50, "info", F.format_string(
            "blinking: gaps in %.1f%% of the tracks", F.col("gap_fraction") * 100))]
    if "drift_total_nm" in qc.columns:
        checks.append(flag(F.col("drift_total_nm") > 500, "info", F.format_string(
            "stage moved: drift of %.0f nm taken out", F.col("drift_total_nm"))))
    return qc.withColumn("flags", F.filter(F.array(*checks), lambda f: f.isNotNull()))


# Metrics users add: name → function(tracks, diffusion) giving (recording_id, value).
METRICS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}
DISTRIBUTIONS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_metric(name: str, scalar: Callable[[DataFrame, DataFrame], DataFrame],
                    distribution: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
    """Add a metric to the replicate table: ``scalar`` returns one ``value`` per
    recording, ``distribution`` any number of them."""
    METRICS[name] = scalar
    if distribution is not None:
        DISTRIBUTIONS[name] = distribution


def spot_intensity(tracks: DataFrame) -> DataFrame:
    """Median over tracks of each track's mean mass, positive means only."""
    per = tracks.groupBy(*TRACK_KEY).agg(F.avg("mass").alias("_m")).where("_m > 0")
    return medians(per, [REC], {"spot_intensity": "_m"})


def replicate_table(tracks: DataFrame, diffusion: DataFrame, pixel_size: float, frame_interval: float,
                    d_threshold: float = MOBILE_D_THRESHOLD, states: DataFrame | None = None) -> DataFrame:
    """One row per recording with every scalar the group comparison tests; of ``states`` its ``state_…`` columns."""
    dt = float(frame_interval)
    mid = medians(diffusion.withColumn("_dur", F.col("track_duration_s")), [REC], {
        "radius_of_gyration": "radius_of_gyration_um", "net_displacement": "net_displacement_um",
        "path_length": "path_length_um", "step_distance": "mean_step_um",
        "link_displacement": "mean_link_displacement_um", "link_speed": "mean_link_speed_um_s",
        "directionality": "directionality_ratio", "track_duration": "_dur"})
    counts = diffusion.groupBy(REC).agg(
        F.count(F.lit(1)).alias("n_tracks"), F.sum("n_observations").alias("n_localisations"),
        F.count_if(F.col("fit_status") == "below_resolution").alias("n_below_resolution"),
        F.count_if(F.col("D") > 0).alias("n_diffusion_eligible"),
        F.avg(F.col("n_observations") * dt).alias("mean_observed_time_s"),
        F.avg("track_duration_s").alias("mean_track_duration_s"))
    auc = D.msd_auc(D.ensemble_msd(tracks, pixel_size), dt).withColumnRenamed("msd_auc", "auc_msd")
    hove = S.van_hove(tracks, 1.0).select(REC, F.col("non_gaussian_alpha2").alias("nongauss_alpha2"))
    vacf = (S.velocity_autocorrelation(tracks, 1.0, 1.0).where("lag_frame = 1")
            .select(REC, F.col("vacf").alias("vacf_persistence")))
    out = counts.withColumn("below_resolution_fraction", F.col("n_below_resolution") / F.col("n_tracks"))
    for part in (D.mobility_summary(diffusion, d_threshold).drop("n_mobile", "n_immobile"), mid, auc, hove, vacf,
                 *([spot_intensity(tracks)] if "mass" in tracks.columns else []),
                 *([states.select(REC, *(c for c in states.columns if c.startswith("state_")))] if states is not None else [])):
        out = out.join(part, REC, "left")
    out = out.withColumn("step_speed", F.col("step_distance") / dt)
    for name, scalar in METRICS.items():
        out = out.join(scalar(tracks, diffusion).select(REC, F.col("value").alias(name)), REC, "left")
    return out


def step_scalars(tracks: DataFrame, diffusion: DataFrame, angles: DataFrame, jumps: DataFrame,
                 curve: DataFrame, frame_interval: float) -> DataFrame:
    """Live-panel scalars: median step speed, median jump, MSD at one second,
    mean |cos θ| and counts."""
    dt = float(frame_interval)
    speed = medians(diffusion, [REC], {"median_step_speed": F.col("mean_step_um") / dt})
    jump = medians(jumps, [REC], {"median_jump_um": "jump_um"})
    at = curve.where(F.col("msd_um2").isNotNull()).groupBy(REC).agg(
        F.min_by("msd_um2", F.struct(F.abs(F.col("lag_frame") * dt - 1.0), "lag_frame")).alias("msd_at_1s"))
    cos = angles.groupBy(REC).agg(F.avg(F.abs(F.cos(F.radians("turning_angle_deg")))).alias("mean_abs_cos"))
    n = tracks.groupBy(*TRACK_KEY).agg(F.count(F.lit(1)).alias("_n")).groupBy(REC).agg(
        F.sum("_n").alias("n_locs"), F.count(F.lit(1)).alias("track_count"))
    for part in (speed, jump, at, cos):
        n = n.join(part, REC, "left")
    return n


def group_curve(curves: DataFrame, assignments: DataFrame, x: str, y: str,
                group: tuple[str, ...] = ("group",)) -> DataFrame:
    """Mean ± SEM across recordings at each abscissa."""
    joined = curves.join(assignments, REC).where(F.col(y).isNotNull())
    n = F.count(F.lit(1))
    return joined.groupBy(*group, x).agg(
        F.avg(y).alias("mean"), F.when(n > 1, F.stddev_samp(y) / F.sqrt(n)).alias("sem"), n.alias("n"))


def histogram(df: DataFrame, by: tuple[str, ...], value: str, low: float, high: float, bins: int,
              closed: bool = True) -> DataFrame:
    """Counts and shares over equal bins of [low, high]; empty bins included."""
    width = (high - low) / bins
    v = F.col(value)
    inside = df.where(v.between(low, high) if closed else (v >= low) & (v < high))
    bin_ = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    filled = (counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"),
                                      F.sum("n").alias("_t"))
              .select(*by, "_m", "_t", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")))
    n = F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0))
    return filled.select(*by, "bin", (low + (F.col("bin") + 0.5) * width).alias("center"),
                         n.alias("n"), (n / F.col("_t")).alias("fraction"))


def empirical_cdf(df: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """Cumulative fraction and survival at every distinct value."""
    return distribution(df, by, value).select(
        *by, "value", cumulative_fraction().alias("cdf"),
        (1 - cumulative_fraction()).alias("survival"))


def gaussian_kde(df: DataFrame, by: tuple[str, ...], value: str, low: float, high: float,
                 points: int = 200, cells: int = 2048) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on an even grid.

    Values are first counted on a fine grid of ``cells``, so the kernel sum costs
    points × cells however many values there are. NULL for fewer than two values
    or no spread.
    """
    by = list(by)
    spread = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp(value).alias("_sd"))
    width = (high - low) / cells
    # values off the grid keep their own positions in cells beyond either end
    cell = F.floor((F.col(value) - low) / width)
    binned = (df.where(F.col(value).isNotNull()).groupBy(*by, cell.alias("_cell"))
              .agg(F.count(F.lit(1)).alias("_c"), F.avg(value).alias("_x")))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)),
                       lambda i: low + i * (high - low) / (points - 1))
    at = binned.join(spread, by).withColumn("x", F.explode(grid))
    h = F.col("_sd") * F.pow(F.col("_n"), -0.2)
    kernel = F.exp(-F.pow((F.col("x") - F.col("_x")) / h, 2) / 2) / (h * F.sqrt(F.lit(2 * 3.141592653589793)))
    total = F.sum(F.when((F.col("_n") >= 2) & (F.col("_sd") > 0), F.col("_c") * kernel / F.col("_n")))
    return at.groupBy(*by, "x").agg(total.alias("density"))


DIFFUSION_METRICS = ("auc_msd", "mob_immob_ratio", "mobile_fraction", "median_d", "median_alpha",
                     "vacf_persistence")
STEP_METRICS = ("step_distance", "step_speed", "link_displacement", "link_speed")


def metric_contract(replicates: DataFrame) -> DataFrame:
    """Blank the metrics whose definition differs between the runs compared.

    Runs carry ``metrics_schema_version``, ``gap_policy``, ``step_definition``
    and ``metric_contract``; missing ones mean the first schema.
    """
    def col(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in replicates.columns else default
    schema = col("metrics_schema_version", F.lit(1))
    gap = col("gap_policy", F.when(schema < 2, "contiguous").otherwise("all_pairs"))
    contract = col("metric_contract", F.concat(F.lit("metrics_schema_"), schema.cast("string")))
    raw = F.lower(F.trim(col("step_definition", F.lit(""))))
    step = (F.when(schema < 2, "adjacent_observation")
            .when((raw == "") | raw.rlike("unit_frame|one frame|single_frame"), "single_frame").otherwise(raw))
    # one scalar subquery for the whole comparison
    verdict = replicates.agg(F.struct(
        (F.count_distinct(F.struct(schema, gap, contract)) <= 1).alias("diffusion_uniform"),
        (F.count_distinct(F.struct(schema, step, contract)) <= 1).alias("step_uniform"),
        F.max(schema < 2).alias("any_legacy"))).scalar()
    out = replicates.withColumn("_v", verdict).select("*", "_v.*").drop("_v")
    for names, ok in ((DIFFUSION_METRICS, "diffusion_uniform"), (STEP_METRICS, "step_uniform")):
        for m in names:
            if m in replicates.columns:
                out = out.withColumn(m, F.when(F.col(ok), F.col(m)))
    return out


def threshold_warnings(thresholds: DataFrame) -> DataFrame:
    """``(scope, group)`` rows where detection thresholds are mixed: within one
    group, or uniform in each group but different between them.

    Input ``(group, kind, threshold)``, one row per run.
    """
    vals = thresholds.where(F.col("threshold").isNotNull()).withColumn("threshold", F.round("threshold", 6))
    per = vals.groupBy("group").agg(F.count_distinct("threshold").alias("n"), F.min("threshold").alias("lo"),
                                    F.max("threshold").alias("hi"))
    within = per.where("n > 1").select(F.lit("within").alias("scope"), F.col("group").cast("string").alias("group"),
                                       "n", "lo", "hi")
    across = (per.where("n = 1").agg(F.count_distinct("lo").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
              .where("n > 1").select(F.lit("between").alias("scope"), F.lit(None).cast("string").alias("group"),
                                     "n", "lo", "hi"))
    return within.unionByName(across)


def recording_days(recordings: DataFrame, acquired_at: str = "acquired_at") -> DataFrame:
    """Calendar day of each recording, numbered in order."""
    day = F.to_date(F.try_to_timestamp(F.substring(F.col(acquired_at).cast("string"), 1, 10), F.lit("yyyy-MM-dd")))
    dated = recordings.withColumn("day", day)
    order = dated.where(F.col("day").isNotNull()).select("day").distinct().withColumn(
        "day_no", F.dense_rank().over(W.orderBy("day")))
    return dated.join(order, "day", "left")


def pool_runs(*tables: DataFrame) -> DataFrame:
    """The rows of several runs; columns only some have are NULL in the others."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows chosen by the MD5 of key and seed: the same ones every time, in any engine."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)


def track_attributes(diffusion: DataFrame, *parts: DataFrame) -> DataFrame:
    """Per-track columns joined onto the per-track table."""
    for part in parts:
        diffusion = diffusion.join(part, TRACK_KEY, "left")
    return diffusion
