"""Group comparison: recordings and their assignment → replicates and tests."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociflow.operators import circular as C, group_stats as G, summary as M
from lociflow.session import cut_lineage

CANONICAL_METRICS = (
    "auc_msd", "mob_immob_ratio", "mobile_fraction", "median_d", "median_alpha", "radius_of_gyration",
    "net_displacement", "path_length", "step_distance", "step_speed", "link_displacement", "link_speed",
    "directionality", "track_duration", "spot_intensity", "nongauss_alpha2", "vacf_persistence")


def compare(replicates: DataFrame, assignments: DataFrame, config: dict | None = None) -> dict[str, DataFrame]:
    """Everything the comparison reports: the replicate table with metrics of
    incompatible runs blanked, omnibus and pairwise tests, and for designs with
    time points the paired two-way analysis."""
    rows = cut_lineage(M.metric_contract(replicates).join(assignments, "recording_id"))
    metrics = [m for m in (*CANONICAL_METRICS, *M.METRICS) if m in rows.columns]
    long = G.melt(rows, ["recording_id", "group", "timepoint", "cell"], metrics)
    omnibus, pairwise = G.compare_metrics(long, config)
    kept, dropped = G.paired_values(long)
    return {"replicates": rows, "omnibus": omnibus, "pairwise": pairwise, "twoway": G.mixed_anova(long),
            "simple_effects": G.simple_effects(long, G.stat_config(config)["correction"]),
            "dropped_subjects": dropped, "paired": kept}


def circular_comparison(angles: DataFrame, assignments: DataFrame, config: dict | None = None) -> DataFrame:
    """Concentration, resultant length and mean direction compared with one value
    per recording; angles are never pooled across recordings."""
    per = cut_lineage(C.circular_stats(angles).where("n >= 2").join(assignments, "recording_id"))
    long = G.melt(per, ["recording_id", "group"], ["concentration_kappa", "mean_resultant_length"])
    omnibus, _ = G.compare_metrics(long, config)
    ww = C.watson_williams(per.withColumn("_all", F.lit(0)), ["_all"], "group", "mean_direction_deg")
    return omnibus.select("metric", "test", "p", "note").unionByName(ww.select(
        F.lit("mean_direction_deg").alias("metric"), F.lit("Watson-Williams").alias("test"), "p",
        F.when(F.col("valid"), "").otherwise("samples too dispersed for the test").alias("note")))


def missing_cells(assignments: DataFrame) -> DataFrame:
    """Time points at which a cell of a group has no recording."""
    key = ["group", "timepoint", "cell"]
    points = assignments.agg(F.array_sort(F.collect_set("timepoint"))).scalar()     # a handful of levels
    wanted = assignments.select("group", "cell").distinct().withColumn("timepoint", F.explode(points)).select(*key)
    return wanted.join(assignments.select(*key).distinct(), key, "left_anti")


def common_levels(curves: DataFrame, assignments: DataFrame, level: str) -> DataFrame:
    """Levels every recording of a group has."""
    have = curves.select("recording_id", level).distinct().join(assignments.select("recording_id", "group"), "recording_id")
    n = have.groupBy("group").agg(F.count_distinct("recording_id").alias("_n"))
    return (have.groupBy("group", level).agg(F.count_distinct("recording_id").alias("_c"))
            .join(n, "group").where("_c = _n").select("group", level))


def curve_drilldown(curves: DataFrame, assignments: DataFrame, level: str, value: str) -> DataFrame:
    """Group × level analysis of curves at each time point (``metric`` names it),
    over the levels every recording of every group has."""
    rows = curves.where(F.col(value).isNotNull()).join(assignments, "recording_id")
    n = rows.groupBy("timepoint").agg(F.count_distinct("recording_id").alias("_n"))
    full = (rows.groupBy("timepoint", level).agg(F.count_distinct("recording_id").alias("_c"))
            .join(n, "timepoint").where("_c = _n").select("timepoint", level))
    long = rows.join(full, ["timepoint", level], "left_semi").select(
        F.col("timepoint").cast("string").alias("metric"), "group", F.col(level).alias("timepoint"),
        F.col("recording_id").alias("cell"), F.col(value).cast("double").alias("value"))
    return G.mixed_anova(cut_lineage(long))
