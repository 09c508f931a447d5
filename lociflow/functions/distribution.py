"""Exact order statistics over groups of any size.

``percentile`` keeps every distinct value of a group in one task's memory, and a
window over a whole group sorts it in one task. Both fail when one recording
holds a third of the rows. Here equal values are merged before the shuffle, each
group is cut into value ranges by a mergeable sketch, and the ranges are ranked
independently; only one row per range is ever brought together.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RANGES = 64


def distribution(df: DataFrame, by: Sequence[str], value: str = "value",
                 ranges: int = RANGES) -> DataFrame:
    """One row per distinct value: ``(by…, value, n_equal, n_below, n_total)``."""
    if ranges & (ranges - 1):
        raise ValueError("ranges must be a power of two")
    by = list(by)
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*by, F.col(value).alias("value"))
              .agg(F.count(F.lit(1)).alias("n_equal")))
    cuts = [i / ranges for i in range(1, ranges)]
    # both reads of ``counts`` and of ``ranked`` ask for the same columns, so each
    # shuffle is done once and reused
    edges = counts.groupBy(*by).agg(
        F.percentile_approx("value", cuts, ranges * 16).alias("_edges"),
        F.max("n_equal").alias("_most")).where("_most > 0").drop("_most")
    ranged = counts.join(edges, by).withColumn("_range", F.lit(0))
    step = ranges // 2
    while step:                                  # binary search for the number of edges below
        ahead = F.get("_edges", F.col("_range") + (step - 1))
        ranged = ranged.withColumn("_range", F.col("_range") + F.when(ahead < F.col("value"), step).otherwise(0))
        step //= 2
    ranged = ranged.drop("_edges")
    in_range = W.partitionBy(*by, "_range").orderBy("value")
    ranked = ranged.withColumns({
        "_upto": F.sum("n_equal").over(in_range.rowsBetween(W.unboundedPreceding, 0)),
        "_next": F.lead("n_equal").over(in_range)})
    whole = W.partitionBy(*by)
    offsets = ranked.where(F.col("_next").isNull()).select(
        *by, "_range",
        F.coalesce(F.sum("_upto").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"),
        F.sum("_upto").over(whole).alias("n_total"))
    return (ranked.join(offsets, [*by, "_range"])
            .select(*by, "value", "n_equal",
                    (F.col("_offset") + F.col("_upto") - F.col("n_equal")).alias("n_below"),
                    "n_total"))


def mid_rank() -> Column:
    """Rank of a ``distribution`` row with ties averaged, counted from 1."""
    return F.col("n_below") + (F.col("n_equal") + 1) / 2.0


def cumulative_fraction() -> Column:
    return (F.col("n_below") + F.col("n_equal")) / F.col("n_total")


def pick_quantile(prob: float) -> Column:
    """Aggregate over ``distribution`` rows: the linearly interpolated quantile."""
    pos = (F.col("n_total") - 1) * F.lit(float(prob))
    low, high = F.floor(pos), F.ceil(pos)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("n_below") <= rank)
                            & (rank < F.col("n_below") + F.col("n_equal")), F.col("value")))
    share = F.max(pos - low)
    return at(low) + share * (at(high) - at(low))


def quantiles(df: DataFrame, by: Sequence[str], value: str,
              probs: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """``(by…, <name>…)`` with one exact quantile per entry of ``probs``."""
    return (distribution(df, by, value, ranges).groupBy(*by)
            .agg(*[pick_quantile(p).alias(name) for name, p in probs.items()]))


def medians(df: DataFrame, by: Sequence[str], columns: dict[str, Column | str]) -> DataFrame:
    """Exact medians of several columns at once, ``{output name: column}``."""
    by = list(by)
    pairs = F.array(*[F.struct(F.lit(name).alias("_name"),
                               (F.col(c) if isinstance(c, str) else c).cast("double").alias("value"))
                      for name, c in columns.items()])
    long = df.select(*by, F.inline(pairs))
    picked = quantiles(long, [*by, "_name"], "value", {"_median": 0.5})
    return picked.groupBy(*by).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_median"))).alias(name) for name in columns])
