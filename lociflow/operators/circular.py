"""Statistics of directions, from sums of cosines and sines."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lociflow.functions.tails import chi2_sf, f_sf, norm_sf
from lociflow.functions.distribution import RANGES, distribution
from lociflow.schema import TRACK_KEY


def concentration(rbar: Column) -> Column:
    """Von Mises concentration from the mean resultant length (Best and Fisher)."""
    return (F.when(rbar < 0.53, 2 * rbar + F.pow(rbar, 3) + 5 * F.pow(rbar, 5) / 6)
            .when(rbar < 0.85, -0.4 + 1.39 * rbar + 0.43 / F.greatest(1 - rbar, F.lit(1e-12)))
            .otherwise(1 / F.greatest(F.pow(rbar, 3) - 4 * F.pow(rbar, 2) + 3 * rbar, F.lit(1e-12))))


def small_sample_concentration(kappa: Column, n: Column) -> Column:
    low = F.greatest(kappa - 2 / (n * F.greatest(kappa, F.lit(1e-12))), F.lit(0.0))
    high = F.pow(n - 1, 3) * kappa / (F.pow(n, 3) + n)
    return F.when(n >= 15, kappa).when(kappa < 2, low).otherwise(high)


def circular_moments(angles: DataFrame, by: Sequence[str], angle: str) -> DataFrame:
    """``n, C, S, C2, S2``: sums that everything else follows from. The second
    trigonometric moment about the mean direction is a rotation of (C2, S2), so
    one pass is enough."""
    a = F.radians(angle)
    return angles.where(F.col(angle).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.cos(a)).alias("C"), F.avg(F.sin(a)).alias("S"),
        F.avg(F.cos(2 * a)).alias("C2"), F.avg(F.sin(2 * a)).alias("S2"))


def circular_stats(angles: DataFrame, by: Sequence[str] = ("recording_id",),
                   angle: str = "turning_angle_deg") -> DataFrame:
    by = list(by)
    n, enough = F.col("n"), F.col("n") >= 2
    df = circular_moments(angles, by, angle).withColumn("R", F.hypot("C", "S"))
    df = df.withColumn("mu", F.atan2("S", "C"))
    R, mu = F.col("R"), F.col("mu")
    df = df.withColumn("a2", F.col("C2") * F.cos(2 * mu) + F.col("S2") * F.sin(2 * mu))
    df = df.withColumn("b2", F.col("S2") * F.cos(2 * mu) - F.col("C2") * F.sin(2 * mu))
    df = df.withColumn("z", n * R * R)
    z, spread = F.col("z"), F.greatest(1 - R, F.lit(1e-12))
    corr = (1 + (2 * z - z * z) / (4 * n)
            - (24 * z - 132 * z * z + 76 * F.pow(z, 3) - 9 * F.pow(z, 4)) / (288 * n * n))
    log_p = -z + F.log(F.when(corr > 0, corr).otherwise(1.0))
    df = df.withColumn("vz", R * F.cos(mu) * F.sqrt(2 * n))
    half = 1.959964 * F.degrees(F.sqrt((1 - F.col("a2")) / (2 * n * R * R)))
    ci = enough & (R >= 0.4) & (n >= 15)

    def put(c: Column, name: str) -> Column:
        return F.when(enough, c).alias(name)
    return df.select(
        *by, "n", put(F.degrees(mu), "mean_direction_deg"), put(R, "mean_resultant_length"),
        put(1 - R, "circular_variance"),
        put(F.when(R > 0, F.degrees(F.sqrt(-2 * F.log(R)))), "circular_std_deg"),
        put(F.degrees(F.sqrt(2 * F.greatest(1 - R, F.lit(0.0)))), "angular_deviation_deg"),
        put(small_sample_concentration(concentration(R), n), "concentration_kappa"),
        put(z, "rayleigh_z"),
        put(F.when(log_p < -700, 1e-300).otherwise(F.least(F.exp(log_p), F.lit(1.0))), "rayleigh_p"),
        put(F.col("vz"), "v_test_z"),
        put(F.greatest(norm_sf(F.col("vz")), F.lit(1e-300)), "v_test_p"),
        put(F.col("b2") / F.pow(spread, 1.5), "circular_skewness"),
        put((F.col("a2") - F.pow(R, 4)) / F.pow(spread, 2), "circular_kurtosis"),
        F.when(ci, F.degrees(mu) - half).alias("ci95_lower_deg"),
        F.when(ci, F.degrees(mu) + half).alias("ci95_upper_deg"))


def circular_median(angles: DataFrame, by: Sequence[str] = ("recording_id",),
                    angle: str = "turning_angle_deg", ranges: int = RANGES) -> DataFrame:
    """The datum with the least summed arc distance to all others, over every
    angle.

    Written on the circle cut at −180°: with cumulative counts and sums up to any
    angle, the summed arc distance of a datum needs only those sums at itself and
    at its antipode, which an ordered union of data and antipodes provides.
    """
    by = list(by)
    counts = (angles.where(F.col(angle).isNotNull())
              .groupBy(*by, F.col(angle).cast("double").alias("a")).agg(F.count(F.lit(1)).alias("c")))
    anti = F.when(F.col("a") > 0, F.col("a") - 180).otherwise(F.col("a") + 180)
    marks = counts.select(*by, F.col("a").alias("at"), "c", F.col("a").alias("of"), F.lit(0).alias("kind")) \
        .unionByName(counts.select(*by, anti.alias("at"), F.lit(0).cast("long").alias("c"),
                                   F.col("a").alias("of"), F.lit(1).alias("kind")))
    # arcs of the circle, each summed on its own; whole-arc sums carry over
    arc = F.least(F.floor((F.col("at") + 180) / (360.0 / ranges)), F.lit(ranges - 1))
    marks = marks.withColumn("_arc", arc)
    inside = W.partitionBy(*by, "_arc").orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    cum = marks.withColumns({"_n": F.sum("c").over(inside),
                             "_s": F.sum(F.col("c") * F.col("at")).over(inside)})
    arcs = marks.groupBy(*by, "_arc").agg(F.sum("c").alias("_an"), F.sum(F.col("c") * F.col("at")).alias("_as"))
    before = W.partitionBy(*by).orderBy("_arc").rowsBetween(W.unboundedPreceding, -1)
    arcs = arcs.select(*by, "_arc", F.coalesce(F.sum("_an").over(before), F.lit(0)).alias("n_before"),
                       F.coalesce(F.sum("_as").over(before), F.lit(0.0)).alias("s_before"),
                       F.sum("_an").over(W.partitionBy(*by)).alias("n_all"),
                       F.sum("_as").over(W.partitionBy(*by)).alias("s_all"))
    upto = cum.join(arcs, [*by, "_arc"]).select(
        *by, "of", "kind", "n_all", "s_all", (F.col("_n") + F.col("n_before")).alias("n_upto"),
        (F.col("_s") + F.col("s_before")).alias("s_upto"))
    own, anti_ = F.col("kind") == 0, F.col("kind") == 1
    both = upto.groupBy(*by, "of").agg(
        F.max("n_all").alias("n_all"), F.max("s_all").alias("s_all"),
        F.max(F.when(own, F.col("n_upto"))).alias("n_own"), F.max(F.when(own, F.col("s_upto"))).alias("s_own"),
        F.max(F.when(anti_, F.col("n_upto"))).alias("n_anti"), F.max(F.when(anti_, F.col("s_upto"))).alias("s_anti"))
    a = F.col("of")
    # distances along the line, then shortened for what lies beyond the antipode
    line = (a * F.col("n_own") - F.col("s_own")
            + (F.col("s_all") - F.col("s_own")) - a * (F.col("n_all") - F.col("n_own")))
    n_above, s_above = F.col("n_all") - F.col("n_anti"), F.col("s_all") - F.col("s_anti")
    wrap_up = 360 * n_above - 2 * (s_above - a * n_above)
    wrap_down = 360 * F.col("n_anti") - 2 * (a * F.col("n_anti") - F.col("s_anti"))
    cost = line + F.when(a <= 0, wrap_up).otherwise(wrap_down)
    best = both.withColumn("cost", cost).groupBy(*by).agg(
        F.min_by("of", F.struct(F.round("cost", 6), "of")).alias("median_deg"), F.max("n_all").alias("n"))
    return best.where("n >= 2").select(*by, "median_deg")


def track_mean_angle(angles: DataFrame, angle: str = "turning_angle_deg") -> DataFrame:
    a = F.radians(angle)
    return angles.groupBy(*TRACK_KEY).agg(
        F.degrees(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a)))).alias("mean_angle_deg"))


def circular_linear_correlation(df: DataFrame, by: Sequence[str], angle: str, x: str) -> DataFrame:
    """Association of a direction with a number; n·r² is chi-square with 2 df."""
    a = F.radians(angle)
    ok = df.where(F.col(angle).isNotNull() & F.col(x).isNotNull()).select(
        *by, F.col(x).cast("double").alias("x"), F.cos(a).alias("c"), F.sin(a).alias("s"))
    m = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "c").alias("xc"),
                            F.corr("x", "s").alias("xs"), F.corr("c", "s").alias("cs"))
    r2 = ((F.pow("xc", 2) + F.pow("xs", 2) - 2 * F.col("xc") * F.col("xs") * F.col("cs"))
          / (1 - F.pow("cs", 2)))
    ok = m.where((F.col("n") >= 3) & (F.abs(1 - F.pow("cs", 2)) >= 1e-12)
                 & F.col("xc").isNotNull() & ~F.isnan("xc") & F.col("cs").isNotNull() & ~F.isnan("cs"))
    out = ok.withColumn("r2", F.least(F.greatest(r2, F.lit(0.0)), F.lit(1.0)))
    stat = F.col("n") * F.col("r2")
    return out.select(*by, "n", F.sqrt("r2").alias("r"), "r2", stat.alias("test_stat"),
                      F.greatest(chi2_sf(stat, F.lit(2.0)), F.lit(1e-300)).alias("p"))


def watson_williams(df: DataFrame, by: Sequence[str], group: str, angle: str) -> DataFrame:
    """Do groups of directions share a mean? One row per ``by`` (or one row)."""
    by, a = list(by), F.radians(angle)
    per = (df.where(F.col(angle).isNotNull()).groupBy(*by, group)
           .agg(F.count(F.lit(1)).alias("n"), F.sum(F.cos(a)).alias("c"), F.sum(F.sin(a)).alias("s"))
           .where("n >= 2"))
    tot = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_total"), F.sum(F.hypot("c", "s")).alias("sum_r"),
        F.hypot(F.sum("c"), F.sum("s")).alias("rp")).where("k >= 2")
    tot = tot.withColumn("R_bar_pooled", F.col("rp") / F.col("n_total"))
    tot = tot.withColumn("kappa_pooled", concentration(F.col("R_bar_pooled")))
    fix = F.when(F.col("kappa_pooled") > 0, 1 + 3 / (8 * F.col("kappa_pooled"))).otherwise(1.0)
    k, n = F.col("k"), F.col("n_total")
    below = (k - 1) * (n - F.col("sum_r"))
    out = tot.where(below > 0).withColumns({
        "F": fix * (n - k) * (F.col("sum_r") - F.col("rp")) / below, "df1": k - 1, "df2": n - k})
    return out.select(*by, "k", "n_total", "F", "df1", "df2",
                      F.greatest(f_sf(F.col("F"), F.col("df1"), F.col("df2")), F.lit(1e-300)).alias("p"),
                      "kappa_pooled", "R_bar_pooled",
                      ((F.col("kappa_pooled") >= 2) & (F.col("R_bar_pooled") >= 0.45)).alias("valid"))
