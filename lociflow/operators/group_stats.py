"""Tests between groups of recordings. Input everywhere: ``(metric, group, value)``,
one row per recording; moments and ranks are aggregates, and only one row per
metric and pair of groups reaches a distribution function."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lociflow.functions import dist, tails
from lociflow.functions.distribution import distribution, mid_rank
from lociflow.session import cut_lineage

N, I, J = "n", "group_i", "group_j"

# Fixed defaults and choices.
DEFAULTS = {
    "alpha": 0.05, "correction": "holm", "across_metric_correction": False,
    "parametric_strategy": "auto", "anova3plus": "welch", "ci_level": 0.95,
    "nonparametric_test": "mann_whitney", "posthoc": "auto", "control_group": "",
    "dunnett": False, "equivalence_tost": False, "tost_margin": 0.5}
CHOICES = {
    "correction": ("none", "bonferroni", "holm", "fdr_bh", "sidak", "hochberg"),
    "parametric_strategy": ("auto", "force_parametric", "force_nonparametric"),
    "anova3plus": ("welch", "oneway", "auto"),
    "nonparametric_test": ("mann_whitney", "brunner_munzel", "permutation"),
    "posthoc": ("auto", "games_howell", "dunn", "tukey")}
LIMITS = {"alpha": (0.0, 0.5), "ci_level": (0.5, 0.999), "tost_margin": (0.0, 5.0)}


def stat_config(given: dict | None = None) -> dict:
    """The complete configuration: unknown keys drop, bad values fall back."""
    cfg = {**DEFAULTS, **{k: v for k, v in (given or {}).items() if k in DEFAULTS}}
    for key, allowed in CHOICES.items():
        text = str(cfg[key]).lower()
        text = "auto" if key == "posthoc" and text == "pairwise" else text
        cfg[key] = text if text in allowed else DEFAULTS[key]
    for key, (low, high) in LIMITS.items():
        try:
            number = float(cfg[key])
        except (TypeError, ValueError):
            number = float("nan")
        cfg[key] = number if low < number <= high else DEFAULTS[key]
    for key in ("across_metric_correction", "dunnett", "equivalence_tost"):
        cfg[key] = bool(cfg[key])
    cfg["control_group"] = str(cfg["control_group"] or "")
    return cfg


def finite(values: DataFrame) -> DataFrame:
    return values.where(F.col("value").isNotNull() & ~F.isnan("value"))


def group_moments(values: DataFrame) -> DataFrame:
    return finite(values).groupBy("metric", "group").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def group_pairs(moments: DataFrame) -> DataFrame:
    """Every unordered pair of group rows of a metric, lower group first."""
    a = moments.select("metric", *[F.col(c).alias(f"{c}_i") for c in moments.columns if c != "metric"])
    b = moments.select("metric", *[F.col(c).alias(f"{c}_j") for c in moments.columns if c != "metric"])
    return a.join(b, "metric").where(F.col(I) < F.col(J))


def pooled_sd() -> Column:
    ni, nj = F.col("n_i"), F.col("n_j")
    return F.sqrt(((ni - 1) * F.col("var_i") + (nj - 1) * F.col("var_j")) / (ni + nj - 2))


def welch_t(values: DataFrame) -> DataFrame:
    """t, df and p of each pair of groups with two or more values each."""
    p = group_pairs(group_moments(values)).where("n_i >= 2 AND n_j >= 2")
    si, sj = F.col("var_i") / F.col("n_i"), F.col("var_j") / F.col("n_j")
    diff = F.col("mean_i") - F.col("mean_j")
    p = p.withColumns({
        "t": F.try_divide(diff, F.sqrt(si + sj)),
        "df": F.try_divide(F.pow(si + sj, 2), si * si / (F.col("n_i") - 1) + sj * sj / (F.col("n_j") - 1))})
    return p.select("metric", I, J, "n_i", "n_j", "mean_i", "mean_j", "t", "df",
                    tails.t_two_sided(F.col("t"), F.col("df")).alias("p"))


def oneway_anova(values: DataFrame) -> DataFrame:
    m = group_moments(values).where("n >= 2")
    tot = m.groupBy("metric").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"))
    between = m.join(tot, "metric").groupBy("metric").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ss_between"))
    out = tot.join(between, "metric").where("k >= 2").withColumns({
        "df1": F.col("k") - 1, "df2": F.col("total") - F.col("k")})
    out = out.withColumn("F", F.try_divide(F.col("ss_between") / F.col("df1"), F.col("ss_within") / F.col("df2")))
    return out.select("metric", "k", "total", "F", "df1", "df2", "ss_between", "ss_within",
                      F.try_divide("ss_between", F.col("ss_between") + F.col("ss_within")).alias("eta_sq"),
                      tails.f_sf(F.col("F"), F.col("df1"), F.col("df2")).alias("p"))


def welch_anova(values: DataFrame) -> DataFrame:
    """Unequal-variance ANOVA; no row where a group has no spread or one value."""
    m = group_moments(values)
    ok = m.groupBy("metric").agg(F.bool_and((F.col("n") >= 2) & (F.col("var") > 0)).alias("ok"),
                                 F.count(F.lit(1)).alias("k")).where("ok AND k >= 2")
    m = m.join(ok.drop("ok"), "metric").withColumn("w", F.col("n") / F.col("var"))
    tot = m.groupBy("metric", "k").agg(F.sum("w").alias("wsum"),
                                       (F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("centre"))
    sums = m.join(tot.drop("k"), "metric").groupBy("metric", "k").agg(
        F.sum(F.col("w") * F.pow(F.col("mean") - F.col("centre"), 2)).alias("a"),
        F.sum(F.pow(1 - F.col("w") / F.col("wsum"), 2) / (F.col("n") - 1)).alias("s"))
    k = F.col("k")
    sums = sums.withColumns({
        "F": (F.col("a") / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * F.col("s")),
        "df1": k - 1, "df2": (k * k - 1) / (3 * F.col("s"))})
    return sums.select("metric", "k", "F", "df1", "df2",
                       tails.f_sf(F.col("F"), F.col("df1"), F.col("df2")).alias("p"))


def rank_sums(values: DataFrame, by: list[str]) -> DataFrame:
    """``(by…, group, n, rank_sum)`` with ties averaged, and ``ties`` = Σ(t³−t)
    and ``total`` of the whole ranking."""
    ranks = distribution(values, by, "value")
    ties = ranks.groupBy(*by).agg(F.sum(F.pow("n_equal", F.lit(3)) - F.col("n_equal")).alias("ties"),
                                  F.max("n_total").alias("total"))
    held = values.groupBy(*by, "group", "value").agg(F.count(F.lit(1)).alias("c"))
    return (held.join(ranks, [*by, "value"]).groupBy(*by, "group")
            .agg(F.sum("c").alias("n"), F.sum(F.col("c") * mid_rank()).alias("rank_sum"))
            .join(ties, by))


def _per_pair(values: DataFrame) -> DataFrame:
    """The values of both groups under every pair they take part in."""
    v = finite(values).select("metric", "group", "value")
    names = v.select("metric", "group").distinct()
    pairs = (names.withColumnRenamed("group", I).join(names.withColumnRenamed("group", J), "metric")
             .where(F.col(I) < F.col(J)))
    return (pairs.withColumn("group", F.explode(F.array(I, J)))
            .join(v, ["metric", "group"]))


def mann_whitney(values: DataFrame) -> DataFrame:
    """U of the first group, p, and the rank effect sizes that follow from U."""
    key = ["metric", I, J]
    rs = rank_sums(_per_pair(values), key)
    first = F.col("group") == F.col(I)
    u = rs.groupBy(*key).agg(
        F.max(F.when(first, F.col("n"))).alias("n_i"), F.max(F.when(~first, F.col("n"))).alias("n_j"),
        F.max(F.when(first, F.col("rank_sum"))).alias("r"), F.max("ties").alias("ties"))
    u = u.withColumn("U", F.col("r") - F.col("n_i") * (F.col("n_i") + 1) / 2)
    delta = 2 * F.col("U") / (F.col("n_i") * F.col("n_j")) - 1
    both = (F.col("n_i") >= 2) & (F.col("n_j") >= 2)
    return u.select(*key, "n_i", "n_j", "U", "ties",
                    F.when(both, tails.mann_whitney(F.col("U"), F.col("n_i"), F.col("n_j"), F.col("ties"))).alias("p"),
                    F.when(both, delta).alias("cliffs_delta"), delta.alias("rank_biserial"))


def kruskal(values: DataFrame) -> DataFrame:
    v = finite(values)
    enough = v.groupBy("metric", "group").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    rs = rank_sums(v.join(enough, ["metric", "group"], "left_semi"), ["metric"])
    h = rs.groupBy("metric").agg(
        F.count(F.lit(1)).alias("k"), F.max("total").alias("total"), F.max("ties").alias("ties"),
        F.sum(F.pow("rank_sum", F.lit(2)) / F.col("n")).alias("q")).where("k >= 2")
    n = F.col("total")
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    h = h.withColumn("H", F.try_divide(raw, 1 - F.col("ties") / (F.pow(n, 3) - n)))
    eps = F.when((n > F.col("k")) & F.col("H").isNotNull(), F.least(F.greatest((F.col("H") - F.col("k") + 1) / (n - F.col("k")), F.lit(0.0)), F.lit(1.0)))
    return h.select("metric", "k", "total", "H", eps.alias("epsilon_sq"),
                    tails.chi2_sf(F.col("H"), F.col("k") - 1).alias("p"))


def brunner_munzel(values: DataFrame) -> DataFrame:
    key = ["metric", I, J]
    v = _per_pair(values)
    held = v.groupBy(*key, "group", "value").agg(F.count(F.lit(1)).alias("c"))
    overall = distribution(v, key, "value").select(*key, "value", mid_rank().alias("r"))
    within = distribution(v, [*key, "group"], "value").select(*key, "group", "value", mid_rank().alias("rw"))
    ranks = held.join(overall, [*key, "value"]).join(within, [*key, "group", "value"])
    place = F.col("r") - F.col("rw")
    g = ranks.groupBy(*key, "group").agg(
        F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("r")) / F.sum("c")).alias("mr"),
        F.sum(F.col("c") * place).alias("p1"), F.sum(F.col("c") * place * place).alias("p2"))
    g = g.withColumn("s2", (F.col("p2") - F.pow("p1", F.lit(2)) / F.col("n")) / (F.col("n") - 1))
    w = _spread(g, key, ("n", "mr", "s2")).where("n_i >= 2 AND n_j >= 2")
    a, b = F.col("n_i") * F.col("s2_i"), F.col("n_j") * F.col("s2_j")
    w = w.withColumns({
        "W": F.try_divide(F.col("n_i") * F.col("n_j") * (F.col("mr_j") - F.col("mr_i")),
                          (F.col("n_i") + F.col("n_j")) * F.sqrt(a + b)),
        "df": F.try_divide(F.pow(a + b, 2), a * a / (F.col("n_i") - 1) + b * b / (F.col("n_j") - 1))})
    return w.select(*key, "n_i", "n_j", "W", "df", tails.t_two_sided(F.col("W"), F.col("df")).alias("p"))


def _spread(g: DataFrame, key: list[str], names: tuple[str, ...]) -> DataFrame:
    """Two rows per pair (one per group) side by side as name_i, name_j."""
    first = F.col("group") == F.col(I)
    return g.groupBy(*key).agg(
        *[F.max(F.when(first, F.col(c))).alias(f"{c}_i") for c in names],
        *[F.max(F.when(~first, F.col(c))).alias(f"{c}_j") for c in names])


def _indexed(values: DataFrame, by: list[str]) -> DataFrame:
    """Number the values of each group 0, 1, … without gathering the group."""
    d = distribution(values, by, "value")
    return (d.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_equal") - 1)))
            .select(*by, "value", (F.col("n_below") + F.col("_t")).alias("idx"), F.col("n_total").alias("n")))


def _hash01(*parts) -> Column:
    """A reproducible number in [0, 1) from its arguments: 52 bits of their MD5, which any engine has."""
    return F.conv(F.substring(_hash(*parts), 1, 13), 16, 10).cast("long") / float(2 ** 52)


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws("|", *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts)))


def permutation_test(values: DataFrame, draws: int = 9999, seed: int = 0) -> DataFrame:
    """Two-sided p of the difference of means over seeded relabellings. A draw
    relabels by the order of a hash; its statistic needs only one sum."""
    key = ["metric", I, J]
    v = _indexed(_per_pair(values), [*key, "group"])
    n_i = v.where(F.col("group") == F.col(I)).groupBy(*key).agg(F.count(F.lit(1)).alias("n_i"), F.sum("value").alias("s_i"))
    n_all = v.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    base = n_i.join(n_all, key).where("n_i >= 2 AND n - n_i >= 2")
    drawn = v.join(base.select(*key), key, "left_semi").withColumn(
        "draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    drawn = drawn.select(*key, "draw", F.col("value"), _hash(F.lit(seed), "draw", "metric", "group", "idx").alias("value_key"))
    # a draw's rows are as many as the two groups have recordings
    order = drawn.withColumn("n_below", F.row_number().over(
        W.partitionBy(*key, "draw").orderBy("value_key", "value")) - 1)
    sums = (order.join(base.select(*key, "n_i"), key).where(F.col("n_below") < F.col("n_i"))
            .groupBy(*key, "draw").agg(F.sum("value").alias("t")))
    d = sums.join(base, key)
    def diff(t: Column) -> Column:
        return t / F.col("n_i") - (F.col("s") - t) / (F.col("n") - F.col("n_i"))
    seen, tol = diff(F.col("s_i")), F.abs(diff(F.col("s_i"))) * 1e-12
    tails = d.groupBy(*key).agg(
        F.count_if(diff(F.col("t")) <= seen + tol).alias("lo"),
        F.count_if(diff(F.col("t")) >= seen - tol).alias("hi"), F.count(F.lit(1)).alias("m"))
    low, high = (F.col("lo") + 1) / (F.col("m") + 1), (F.col("hi") + 1) / (F.col("m") + 1)
    return tails.select(*key, F.col("m").alias("draws"), F.least(2 * F.least(low, high), F.lit(1.0)).alias("p"))


def _moment_normality() -> Column:
    """p of the omnibus test on skewness and kurtosis, each transformed to a standard normal, from columns n, g1, g2."""
    n = F.col("n").cast("double")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    skew = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(w2) / 2)
    x = (F.col("g2") + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    third = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / third * (2 / third + F.sqrt(1 + 4 / (third * third)))
    kurt = (1 - 2 / (9 * a) - F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))) / F.sqrt(2 / (9 * a))
    return F.exp(-(skew * skew + kurt * kurt) / 2)


def normality_gate(values: DataFrame, alpha: float = 0.05, exact_upto: int = 5000) -> DataFrame:
    """One decision per metric: parametric unless a group of at least three values rejects normality.

    Groups of up to ``exact_upto`` (default 5000, at least 19) values are tested on their ordered values, so arrays stay bounded; larger
    ones by their moments, which need no array. ``n_by_moments`` counts the latter. Constant groups have no p."""
    sizes = group_moments(values).where(F.col("n").between(3, max(exact_upto, 19)))
    arrays = (finite(values).join(sizes.select("metric", "group"), ["metric", "group"], "left_semi")
              .groupBy("metric", "group").agg(F.array_sort(F.collect_list("value")).alias("_v")))
    tested = arrays.select("metric", "group", dist.shapiro_col(F.col("_v")).alias("p_normal"), F.lit(0).alias("_m"))
    large = finite(values).groupBy("metric", "group").agg(
        F.count("value").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")).where(F.col("n") > max(exact_upto, 19))
    tested = tested.unionByName(large.select("metric", "group", _moment_normality().alias("p_normal"), F.lit(1).alias("_m")))
    all_metrics = values.select("metric").distinct()
    gate = tested.groupBy("metric").agg(F.min("p_normal").alias("min_p_normal"), F.sum("_m").alias("n_by_moments"))
    return all_metrics.join(gate, "metric", "left").select(
        "metric", "min_p_normal", F.coalesce(F.col("min_p_normal") >= alpha, F.lit(True)).alias("parametric"),
        F.coalesce("n_by_moments", F.lit(0).cast("long")).alias("n_by_moments"))


def effect_sizes(values: DataFrame) -> DataFrame:
    p = group_pairs(group_moments(values)).where("n_i >= 2 AND n_j >= 2").withColumn("sp", pooled_sd())
    d = F.when(F.col("sp") > 0, (F.col("mean_i") - F.col("mean_j")) / F.col("sp"))
    g = d * (1 - 3 / (4 * (F.col("n_i") + F.col("n_j") - 2) - 1))
    ranks = mann_whitney(values).select("metric", I, J, "cliffs_delta", "rank_biserial")
    return p.select("metric", I, J, "n_i", "n_j", d.alias("cohens_d"), g.alias("hedges_g")) \
        .join(ranks, ["metric", I, J])


def bootstrap_ci(values: DataFrame, resamples: int = 2000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Percentile intervals of Hedges' g and Cliff's δ from the same seeded resamples of either group.

    A resample is one row per distinct value and how often each group drew it; δ is a sum over
    these of draws below and above, so no pairs of values arise.
    """
    key = ["metric", I, J]
    v = _indexed(_per_pair(values), [*key, "group"])
    slots = v.select(*key, "group", F.col("idx").alias("slot"), "n").withColumn(
        "resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    pick = F.floor(_hash01(F.lit(seed), "resample", "metric", "group", "slot") * F.col("n"))
    drawn = slots.select(*key, "group", "resample", pick.alias("idx")).join(
        v.select(*key, "group", "idx", "value"), [*key, "group", "idx"])
    first = F.col("group") == F.col(I)
    held = drawn.groupBy(*key, "resample", "value").agg(F.count_if(first).alias("c_i"), F.count_if(~first).alias("c_j"))
    # as many rows as a resample has distinct values
    below = F.sum("c_j").over(W.partitionBy(*key, "resample").orderBy("value").rowsBetween(W.unboundedPreceding, 0)) - F.col("c_j")
    held = held.withColumn("below", below)
    x = F.col("value")
    m = held.groupBy(*key, "resample").agg(
        *[F.sum(f"c_{s}").alias(f"n_{s}") for s in "ij"], *[(F.sum(F.col(f"c_{s}") * x) / F.sum(f"c_{s}")).alias(f"mean_{s}") for s in "ij"],
        F.sum(F.col("c_i") * (2 * F.col("below") + F.col("c_j"))).alias("wins"))
    spread = held.join(m, [*key, "resample"]).groupBy(*key, "resample").agg(
        *[F.try_divide(F.sum(F.col(f"c_{s}") * F.pow(x - F.col(f"mean_{s}"), 2)), F.first(f"n_{s}") - 1).alias(f"var_{s}") for s in "ij"])
    pair = m.join(spread, [*key, "resample"]).where("n_i >= 2 AND n_j >= 2").withColumn("sp", pooled_sd())
    g = F.when(F.col("sp") > 0, (F.col("mean_i") - F.col("mean_j")) / F.col("sp")
               * (1 - 3 / (4 * (F.col("n_i") + F.col("n_j") - 2) - 1)))
    delta = F.col("wins") / (F.col("n_i") * F.col("n_j")) - 1
    tail = (1 - level) / 2
    # one value per resample: the group is as large as ``resamples``, never the data
    return pair.groupBy(*key).agg(
        F.count(g).alias("resamples"), *[F.percentile(c, F.lit(q)).alias(f"{n}_ci_{end}") for n, c in (("hedges_g", g), ("cliffs_delta", delta))
                                         for end, q in (("low", tail), ("high", 1 - tail))])


def needed_sample_size(values: DataFrame) -> DataFrame:
    e = effect_sizes(values)
    return e.select("metric", I, J, "cohens_d", tails.sample_size(F.col("cohens_d"), 0.80).alias("n_needed_80"),
                    tails.sample_size(F.col("cohens_d"), 0.90).alias("n_needed_90"))


def tost(values: DataFrame, margin_sd: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """Two one-sided Welch tests against ± margin pooled standard deviations."""
    p = group_pairs(group_moments(values)).where("n_i >= 2 AND n_j >= 2").withColumn("sp", pooled_sd()).where("sp > 0")
    si, sj = F.col("var_i") / F.col("n_i"), F.col("var_j") / F.col("n_j")
    diff, bound = F.col("mean_i") - F.col("mean_j"), F.col("sp") * margin_sd
    p = p.withColumns({
        "df": F.pow(si + sj, 2) / (si * si / (F.col("n_i") - 1) + sj * sj / (F.col("n_j") - 1)),
        "t_lower": (diff + bound) / F.sqrt(si + sj), "t_upper": (diff - bound) / F.sqrt(si + sj)})
    p = p.withColumn("p", F.greatest(tails.t_sf(F.col("t_lower"), F.col("df")),
                                     tails.t_sf(-F.col("t_upper"), F.col("df"))))
    return p.select("metric", I, J, "df", "t_lower", "t_upper", "p", (F.col("p") < alpha).alias("equivalent"))


def posthoc(values: DataFrame, method: str) -> DataFrame:
    """``tukey``, ``games_howell`` or ``dunn``: statistic and p of every pair.
    The first two correct themselves for the family."""
    if method == "dunn":
        v = finite(values)
        enough = v.groupBy("metric", "group").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
        rs = rank_sums(v.join(enough, ["metric", "group"], "left_semi"), ["metric"])
        p = group_pairs(rs.withColumn("mr", F.col("rank_sum") / F.col("n")))
        n = F.col("total_i")
        s2 = n * (n + 1) / 12 - F.col("ties_i") / (12 * (n - 1))
        z = F.try_divide(F.col("mr_i") - F.col("mr_j"), F.sqrt(s2 * (1 / F.col("n_i") + 1 / F.col("n_j"))))
        return p.withColumn("statistic", z).select(
            "metric", I, J, "statistic", F.lit(None).cast("double").alias("df"),
            (2 * tails.norm_sf(F.abs("statistic"))).alias("p"))
    m = group_moments(values).where("n >= 2")
    fam = m.groupBy("metric").agg(
        F.count(F.lit(1)).alias("k"), (F.sum("n") - F.count(F.lit(1))).alias("dfw"),
        (F.sum((F.col("n") - 1) * F.col("var")) / (F.sum("n") - F.count(F.lit(1)))).alias("msw"))
    p = group_pairs(m).join(fam, "metric")
    diff = F.abs(F.col("mean_i") - F.col("mean_j"))
    if method == "tukey":
        q = F.try_divide(diff, F.sqrt(F.col("msw") / 2 * (1 / F.col("n_i") + 1 / F.col("n_j"))))
        df = F.col("dfw").cast("double")
    elif method == "games_howell":
        si, sj = F.col("var_i") / F.col("n_i"), F.col("var_j") / F.col("n_j")
        q = F.try_divide(diff, F.sqrt((si + sj) / 2))
        df = F.try_divide(F.pow(si + sj, 2), si * si / (F.col("n_i") - 1) + sj * sj / (F.col("n_j") - 1))
    else:
        raise ValueError(f"unknown post-hoc method {method!r}")
    return p.withColumns({"statistic": q, "df": df}).select(
        "metric", I, J, "statistic", "df", tails.range_sf(F.col("statistic"), F.col("k"), F.col("df")).alias("p"))


def dunnett(values: DataFrame, control: str, draws: int = 20000, seed: int = 0) -> DataFrame:
    """Every group against the control with a family-wise p: the share of seeded
    draws of the joint null whose largest |t| exceeds the one observed."""
    m = group_moments(values).where("n >= 2")
    fam = m.groupBy("metric").agg(
        (F.sum("n") - F.count(F.lit(1))).alias("dfw"),
        (F.sum((F.col("n") - 1) * F.col("var")) / (F.sum("n") - F.count(F.lit(1)))).alias("msw"))
    ctrl = m.where(F.col("group").cast("string") == control).select(
        "metric", F.col("group").alias("control"), F.col("n").alias("n_c"), F.col("mean").alias("mean_c"))
    t = (m.join(ctrl, "metric").where(F.col("group") != F.col("control")).join(fam, "metric")
         .withColumn("t", F.try_divide(F.col("mean") - F.col("mean_c"),
                                       F.sqrt(F.col("msw") * (1 / F.col("n") + 1 / F.col("n_c"))))))
    def gauss(*parts) -> Column:
        u1, u2 = 1 - _hash01(*parts, F.lit("a")), _hash01(*parts, F.lit("b"))
        return F.sqrt(-2 * F.log(u1)) * F.cos(u2 * 6.283185307179586)
    # chi-square of the pooled variance by the cube-root normal approximation
    null = t.select("metric", "group", "n", "n_c", "dfw").withColumn(
        "draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    zc = gauss(F.lit(seed), "draw", "metric", F.lit("control"))
    zg = gauss(F.lit(seed), "draw", "metric", F.concat(F.lit("group "), F.col("group").cast("string")))
    v = F.col("dfw")
    chi = F.pow(1 - 2 / (9 * v) + gauss(F.lit(seed), "draw", "metric", F.lit("scale")) * F.sqrt(2 / (9 * v)), 3)
    null_t = F.abs(zg / F.sqrt(F.col("n")) - zc / F.sqrt(F.col("n_c"))) / F.sqrt(
        F.greatest(chi, F.lit(1e-12)) * (1 / F.col("n") + 1 / F.col("n_c")))
    worst = null.groupBy("metric", "draw").agg(F.max(null_t).alias("worst"))
    p = (t.select("metric", "group", "control", "n", "n_c", "t").join(worst, "metric")
         .groupBy("metric", "group", "control", "n", "n_c", "t")
         .agg(F.avg((F.col("worst") >= F.abs("t")).cast("double")).alias("p")))
    return p


def paired_values(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete, dropped) subjects of ``(metric, group, timepoint, cell, value)``:
    kept when present exactly once at every time point of the metric."""
    v = finite(values)
    total = v.groupBy("metric").agg(F.count_distinct("timepoint").alias("_t"))
    per = v.groupBy("metric", "group", "cell").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("timepoint").alias("n_timepoints")).join(total, "metric")
    whole = (F.col("n_rows") == F.col("_t")) & (F.col("n_timepoints") == F.col("_t"))
    key = ["metric", "group", "cell"]
    dropped = per.where(~whole).select(*key, "n_rows", (F.col("_t") - F.col("n_timepoints")).alias("n_missing"))
    return v.join(per.where(whole), key, "left_semi"), dropped


def paired_differences(values: DataFrame, before, after) -> DataFrame:
    """``(metric, group, cell, diff)`` between two time points of complete cells."""
    v = finite(values).where(F.col("timepoint").isin(before, after))
    return (v.groupBy("metric", "group", "cell").agg(
        F.max(F.when(F.col("timepoint") == before, F.col("value"))).alias("_a"),
        F.max(F.when(F.col("timepoint") == after, F.col("value"))).alias("_b"))
        .where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        .select("metric", "group", "cell", (F.col("_b") - F.col("_a")).alias("diff")))


def paired_test(diffs: DataFrame) -> DataFrame:
    """Paired t and signed-rank statistics per metric and group, with both p."""
    key = ["metric", "group"]
    m = diffs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"),
                                F.stddev_samp("diff").alias("sd"), F.count_if(F.col("diff") == 0).alias("zeros"))
    size = distribution(diffs.where("diff <> 0").select(*key, F.abs("diff").alias("value")), key, "value")
    plus = (diffs.where("diff <> 0").groupBy(*key, F.abs("diff").alias("value"))
            .agg(F.count_if(F.col("diff") > 0).alias("_pos")))
    w = (size.join(plus, [*key, "value"]).groupBy(*key).agg(
        F.sum(F.col("_pos") * mid_rank()).alias("w_plus"),
        F.sum(F.pow("n_equal", F.lit(3)) - F.col("n_equal")).alias("ties"), F.max("n_total").alias("n_nonzero")))
    out = m.where("n >= 2").join(w, key, "left").withColumn(
        "t", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))))
    dz = F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("sd"))
    return out.select(*key, "n", "mean_diff", "t", (F.col("n") - 1).alias("df"), "w_plus",
                      (dz * (1 - 3 / (4 * (F.col("n") - 1) - 1.0))).alias("paired_hedges_g"),
                      tails.t_two_sided(F.col("t"), (F.col("n") - 1)).alias("p_t"),
                      tails.wilcoxon(F.col("w_plus"), F.col("n_nonzero"), F.col("ties"), F.col("zeros")).alias("p_wilcoxon"))


def ks_two_sample(values: DataFrame) -> DataFrame:
    """Largest gap between two empirical distribution functions."""
    key = ["metric", I, J]
    v = _per_pair(values)
    held = v.groupBy(*key, "value").agg(F.count_if(F.col("group") == F.col(I)).alias("ci"),
                                        F.count_if(F.col("group") == F.col(J)).alias("cj"))
    sizes = held.groupBy(*key).agg(F.sum("ci").alias("n_i"), F.sum("cj").alias("n_j"))
    # cumulative counts of one side at every pooled value: the side's own curve
    # is carried forward by ranking the pooled values once and counting the side
    ranked = distribution(v, key, "value").join(held, [*key, "value"]).join(sizes, key)
    side = ranked.withColumn("_range", F.floor(F.col("n_below") * 64 / F.col("n_total")))
    run = W.partitionBy(*key, "_range").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    part = side.groupBy(*key, "_range").agg(F.sum("ci").alias("_pi"))
    start = part.select(*key, "_range", F.coalesce(F.sum("_pi").over(
        W.partitionBy(*key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_si"))
    cum = side.withColumn("_ci", F.sum("ci").over(run)).join(start, [*key, "_range"])
    upto_i = F.col("_ci") + F.col("_si")
    upto_j = F.col("n_below") + F.col("n_equal") - upto_i
    gap = cum.withColumn("gap", F.abs(upto_i / F.col("n_i") - upto_j / F.col("n_j")))
    return gap.groupBy(*key).agg(F.max("n_i").alias("n_i"), F.max("n_j").alias("n_j"), F.max("gap").alias("D"))


def correct_pvalues(df: DataFrame, family: list[str], method: str = "holm", p: str = "p",
                    out: str = "p_corrected", order: tuple[str, ...] = ()) -> DataFrame:
    """Correct the p-values of each family (as many rows as there are tests).
    NULLs do not count; a family of one is left as it is."""
    fam = W.partitionBy(*family)
    m = F.count(p).over(fam)
    pv = F.col(p)
    rank = F.row_number().over(fam.orderBy(pv.asc_nulls_last(), *order))
    df = df.withColumns({"_m": m, "_rank": rank})
    up = W.partitionBy(*family).orderBy("_rank").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*family).orderBy("_rank").rowsBetween(0, W.unboundedFollowing)
    left = F.col("_m") - F.col("_rank") + 1
    adjusted = {
        "none": pv, "bonferroni": pv * F.col("_m"), "sidak": 1 - F.pow(1 - pv, F.col("_m")),
        "holm": F.max(left * pv).over(up), "hochberg": F.min(left * pv).over(down),
        "fdr_bh": F.min(pv * F.col("_m") / F.col("_rank")).over(down)}[method]
    value = F.when(F.col("_m") == 1, pv).otherwise(adjusted)
    return df.withColumn(out, F.when(pv.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))) \
             .drop("_m", "_rank")


def stars(p: Column, alpha: float = 0.05) -> Column:
    return (F.when(p.isNull(), "").when(p >= alpha, "ns").when(p < 0.001, "***")
            .when(p < 0.01, "**").otherwise("*"))


def compare_metrics(values: DataFrame, config: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(omnibus, pairwise) rows of every metric: one decision per metric between
    parametric and rank tests, effect sizes, notes, corrections."""
    cfg = stat_config(config)
    # one row per recording and metric, read by every test below: computed once
    v, alpha = cut_lineage(finite(values)), cfg["alpha"]
    strategy = cfg["parametric_strategy"]
    valid = group_moments(v).where("n >= 2")
    sizes = valid.groupBy("metric").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("min_n"))
    if strategy == "auto":
        gate = normality_gate(v, alpha).select("metric", "parametric")
    else:
        gate = v.select("metric").distinct().withColumn("parametric", F.lit(strategy == "force_parametric"))
    key = ["metric", I, J]
    welch = welch_t(v).select(*key, F.col("p").alias("_pt"))
    ranks = mann_whitney(v).select(*key, "cliffs_delta", "rank_biserial", F.col("p").alias("_pn"))
    which, label = cfg["nonparametric_test"], "Mann-Whitney U"
    if which != "mann_whitney":
        label = {"brunner_munzel": "Brunner-Munzel", "permutation": "Permutation"}[which]
        other = (brunner_munzel(v) if which == "brunner_munzel" else permutation_test(v)).select(*key, F.col("p").alias("_pn"))
        ranks = ranks.drop("_pn").join(other, key, "left")
    pairs = (group_pairs(group_moments(v)).join(gate, "metric").join(welch, key, "left").join(ranks, key, "left")
             .join(effect_sizes(v).select(*key, "cohens_d", "hedges_g"), key, "left")
             .join(bootstrap_ci(v, level=cfg["ci_level"]).drop("resamples"), key, "left")
             .join(needed_sample_size(v).drop("cohens_d"), key, "left"))
    if cfg["equivalence_tost"]:
        same = tost(v, cfg["tost_margin"], alpha).select(*key, F.col("p").alias("tost_p"), F.col("equivalent").alias("tost_equivalent"))
        pairs = pairs.join(same, key, "left")
    else:
        pairs = pairs.withColumns({"tost_p": F.lit(None).cast("double"), "tost_equivalent": F.lit(None).cast("boolean")})
    small = (F.col("n_i") < 2) | (F.col("n_j") < 2)
    weak = (F.col("n_i") < 3) | (F.col("n_j") < 3)
    pairs = pairs.withColumns({
        "p": F.when(~small, F.when(F.col("parametric"), F.col("_pt")).otherwise(F.col("_pn"))),
        "test": F.when(small, "n<2").when(F.col("parametric"), "Welch's t-test").otherwise(label),
        "note": F.when(small, "n<2 replicates - no test possible")
        .when(weak, "n<3 replicates - underpowered, not interpretable").otherwise(""),
        "self_corrected": F.lit(False)})
    if cfg["posthoc"] != "auto":
        ph = posthoc(v, cfg["posthoc"]).select(*key, F.col("p").alias("_ph")).join(
            sizes.where("k >= 3").select("metric"), "metric", "left_semi")
        pairs = pairs.join(ph, key, "left")
        name = {"tukey": "Tukey HSD", "games_howell": "Games-Howell", "dunn": "Dunn"}[cfg["posthoc"]]
        pairs = pairs.withColumns({
            "p": F.coalesce("_ph", "p"), "test": F.when(F.col("_ph").isNotNull(), name).otherwise(F.col("test")),
            "self_corrected": F.col("_ph").isNotNull() & F.lit(cfg["posthoc"] != "dunn")}).drop("_ph")
    family = F.when(~F.col("self_corrected"), F.col("p"))
    pairs = correct_pvalues(pairs.withColumn("_fam", family), ["metric"], cfg["correction"], "_fam", "_pc", (I, J))
    if cfg["across_metric_correction"]:
        pairs = correct_pvalues(pairs.withColumn("_all", F.lit(0)), ["_all"], cfg["correction"], "_fam", "_pc",
                                ("metric", I, J)).drop("_all")
    sem = {s: F.when(F.col(f"n_{s}") > 1, F.sqrt(F.col(f"var_{s}") / F.col(f"n_{s}"))).alias(f"sem_{s}") for s in "ij"}
    raw = F.when(weak, "").otherwise(stars(F.col("p"), alpha))
    pairwise = pairs.withColumn("p_corrected", F.when(F.col("self_corrected"), F.col("p")).otherwise(F.col("_pc"))).select(
        *key, "test", "p", raw.alias("stars"), "p_corrected",
        F.when(raw == "", "").otherwise(stars(F.col("p_corrected"), alpha)).alias("stars_corrected"), "note",
        "n_i", "n_j", "mean_i", "mean_j", sem["i"], sem["j"], "cohens_d", "hedges_g", "cliffs_delta",
        "rank_biserial", "self_corrected", "hedges_g_ci_low", "hedges_g_ci_high", "cliffs_delta_ci_low", "cliffs_delta_ci_high",
        "n_needed_80", "n_needed_90", "tost_p", "tost_equivalent", F.lit("pairwise").alias("family"))
    every_pair = pairwise
    if cfg["dunnett"] and cfg["control_group"]:
        pairwise = pairwise.unionByName(_against_control(v, cfg, pairwise))
    two = (every_pair.join(sizes.where("k = 2"), "metric", "left_semi").where("n_i >= 2 AND n_j >= 2")
           .select("metric", "test", "p", F.lit(None).cast("double").alias("effect_size")))
    one = oneway_anova(v).select("metric", F.col("p").alias("_po"), "eta_sq")
    wa = welch_anova(v.join(valid, ["metric", "group"], "left_semi")).select("metric", F.col("p").alias("_pw"))
    kw = kruskal(v).select("metric", F.col("p").alias("_pk"), "epsilon_sq")
    use_welch = F.lit(cfg["anova3plus"] != "oneway") & F.col("_pw").isNotNull()
    many = sizes.join(gate, "metric").join(one, "metric").join(wa, "metric", "left").join(kw, "metric", "left")
    effect = F.when(F.col("parametric"), F.col("eta_sq")).otherwise(F.col("epsilon_sq"))
    many_rows = many.where("k >= 3").select(
        "metric", F.when(~F.col("parametric"), "Kruskal-Wallis").when(use_welch, "Welch's ANOVA")
        .otherwise("One-way ANOVA").alias("test"),
        F.when(~F.col("parametric"), F.col("_pk")).when(use_welch, F.col("_pw")).otherwise(F.col("_po")).alias("p"),
        effect.alias("effect_size"))
    two = two.drop("effect_size").join(many.select("metric", effect.alias("effect_size")), "metric", "left")
    omni = two.unionByName(many_rows).join(sizes, "metric").where(F.col("p").isNotNull())
    under = F.col("min_n") < 3
    omnibus = omni.select("metric", "k", "test", "p", "effect_size",
                          F.when(under, "").otherwise(stars(F.col("p"), alpha)).alias("stars"),
                          F.when(under, "n<3 replicates - underpowered, not interpretable").otherwise("").alias("note"))
    return omnibus, pairwise


def _against_control(v: DataFrame, cfg: dict, pairwise: DataFrame) -> DataFrame:
    """Rows of the many-to-one family: every group as i against the control as j, in the columns of the ordinary pairs."""
    d = dunnett(v, cfg["control_group"]).select("metric", F.col("group").alias("g"), F.col("control").alias("c"), F.col("p").alias("_p"))
    turned = F.col("g") > F.col("c")
    met = d.withColumns({I: F.when(turned, F.col("c")).otherwise(F.col("g")), J: F.when(turned, F.col("g")).otherwise(F.col("c"))}).join(pairwise, ["metric", I, J])

    def side(name, i, j):
        return F.when(turned, F.col(f"{name}_{j}")).otherwise(F.col(f"{name}_{i}")).alias(f"{name}_{i}")
    sign = F.when(turned, -1.0).otherwise(1.0)
    weak = (F.col("n_i") < 3) | (F.col("n_j") < 3)
    mark = F.when(weak, "").otherwise(stars(F.col("_p"), cfg["alpha"]))
    made = {"group_i": F.col("g"), "group_j": F.col("c"), "test": F.lit("Dunnett"), "p": F.col("_p"), "p_corrected": F.col("_p"), "stars": mark,
            "stars_corrected": mark, "note": F.when(weak, F.col("note")).otherwise("vs control"), "self_corrected": F.lit(True), "family": F.lit("dunnett"),
            **{n: side(n[:-2], n[-1], "j" if n[-1] == "i" else "i") for n in ("n_i", "n_j", "mean_i", "mean_j", "sem_i", "sem_j")},
            **{n: sign * F.col(n) for n in ("cohens_d", "hedges_g", "cliffs_delta", "rank_biserial")},
            "cliffs_delta_ci_low": F.when(turned, -F.col("cliffs_delta_ci_high")).otherwise(F.col("cliffs_delta_ci_low")),
            "cliffs_delta_ci_high": F.when(turned, -F.col("cliffs_delta_ci_low")).otherwise(F.col("cliffs_delta_ci_high"))}
    empty = ("hedges_g_ci_low", "hedges_g_ci_high", "n_needed_80", "n_needed_90", "tost_p", "tost_equivalent")
    return met.select(*[made[c].alias(c) if c in made else F.lit(None).cast(pairwise.schema[c].dataType).alias(c) if c in empty else F.col(c)
                        for c in pairwise.columns])


def mixed_anova(values: DataFrame) -> DataFrame:
    """Group (between) × time point (within) ANOVA on complete cells, per metric.

    Rows ``effect`` = group, timepoint, interaction. The within effects carry the
    Greenhouse–Geisser ε from the pooled covariance of the time points.
    """
    v, _ = paired_values(values)
    v = v.select("metric", F.col("group").alias("g"), F.col("timepoint").alias("t"), F.col("cell").alias("s"), "value")
    grand = v.groupBy("metric").agg(F.avg("value").alias("gm"), F.count_distinct("g").alias("a"),
                                    F.count_distinct("t").alias("b"), F.count_distinct(F.struct("g", "s")).alias("ns"))
    sq = lambda c: F.pow(c, F.lit(2))                                        # noqa: E731
    cell = v.groupBy("metric", "g", "t").agg(F.avg("value").alias("cm"), F.count(F.lit(1)).alias("n"))
    grp = v.groupBy("metric", "g").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    tim = v.groupBy("metric", "t").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    sub = v.groupBy("metric", "g", "s").agg(F.avg("value").alias("sm"), F.count(F.lit(1)).alias("n"))
    ss_g = grp.join(grand, "metric").groupBy("metric").agg(F.sum(F.col("n") * sq(F.col("m") - F.col("gm"))).alias("ss_g"))
    ss_t = tim.join(grand, "metric").groupBy("metric").agg(F.sum(F.col("n") * sq(F.col("m") - F.col("gm"))).alias("ss_t"))
    ss_c = cell.join(grand, "metric").groupBy("metric").agg(F.sum(F.col("n") * sq(F.col("cm") - F.col("gm"))).alias("ss_c"))
    ss_s = (sub.join(grp.select("metric", "g", F.col("m").alias("gmn")), ["metric", "g"]).groupBy("metric")
            .agg(F.sum(F.col("n") * sq(F.col("sm") - F.col("gmn"))).alias("ss_s")))
    ss_tot = v.join(grand, "metric").groupBy("metric").agg(F.sum(sq(F.col("value") - F.col("gm"))).alias("ss_tot"))
    eps = greenhouse_geisser(v)
    al = grand.where("a >= 2 AND b >= 2")
    for part in (ss_g, ss_t, ss_c, ss_s, ss_tot, eps):
        al = al.join(part, "metric", "left")
    al = al.withColumns({
        "ss_i": F.col("ss_c") - F.col("ss_g") - F.col("ss_t"),
        "df_g": F.col("a") - 1, "df_t": F.col("b") - 1, "df_s": F.col("ns") - F.col("a")})
    al = al.withColumns({
        "ss_e": F.col("ss_tot") - F.col("ss_c") - F.col("ss_s"),
        "df_i": F.col("df_g") * F.col("df_t"), "df_e": F.col("df_s") * F.col("df_t")})

    def row(name: str, ss: str, df1: str, err: str, df2: str, within: bool):
        f = F.try_divide(F.col(ss) / F.col(df1), F.try_divide(F.col(err), F.col(df2)))
        return F.struct(F.lit(name).alias("effect"), F.col(ss).alias("SS"), f.alias("F"),
                        F.col(df1).cast("double").alias("df1"), F.col(df2).cast("double").alias("df2"),
                        F.try_divide(F.col(ss), F.col(ss) + F.col(err)).alias("np2"),
                        (F.col("eps") if within else F.lit(None).cast("double")).alias("eps"))
    rows = al.select("metric", F.inline(F.array(
        row("group", "ss_g", "df_g", "ss_s", "df_s", False),
        row("timepoint", "ss_t", "df_t", "ss_e", "df_e", True),
        row("interaction", "ss_i", "df_i", "ss_e", "df_e", True))))
    return rows.withColumns({
        "p_unc": tails.f_sf(F.col("F"), F.col("df1"), F.col("df2")),
        "p_GG": tails.f_sf(F.col("F"), F.col("df1") * F.col("eps"), F.col("df2") * F.col("eps"))})


def greenhouse_geisser(v: DataFrame) -> DataFrame:
    """ε per metric from the covariance of the time points across subjects, by
    its double-centred form. Input ``(metric, g, t, s, value)``."""
    a = v.select("metric", "g", "s", F.col("t").alias("t1"), F.col("value").alias("v1"))
    b = v.select("metric", "g", "s", F.col("t").alias("t2"), F.col("value").alias("v2"))
    cov = a.join(b, ["metric", "g", "s"]).groupBy("metric", "t1", "t2").agg(F.covar_samp("v1", "v2").alias("c"))
    tot = cov.groupBy("metric").agg(F.avg("c").alias("all"), F.count_distinct("t1").alias("b"),
                                    F.avg(F.when(F.col("t1") == F.col("t2"), F.col("c"))).alias("diag"),
                                    F.sum(F.col("c") * F.col("c")).alias("sq"))
    rows = cov.groupBy("metric", "t1").agg(F.avg("c").alias("r")).groupBy("metric").agg(F.sum(F.col("r") * F.col("r")).alias("rr"))
    b_ = F.col("b")
    num = F.pow(b_ * (F.col("diag") - F.col("all")), F.lit(2))
    den = (b_ - 1) * (F.col("sq") - 2 * b_ * F.col("rr") + b_ * b_ * F.col("all") * F.col("all"))
    # with two time points there is one contrast, so ε is 1 whatever the data
    eps = F.when(b_ == 2, 1.0).otherwise(F.least(F.try_divide(num, den), F.lit(1.0)))
    return tot.join(rows, "metric").select("metric", eps.alias("eps"))


def simple_effects(values: DataFrame, correction: str = "holm") -> DataFrame:
    """Groups compared at each time point, corrected within the metric."""
    v, _ = paired_values(values)
    at = v.select(F.struct("metric", "timepoint").alias("metric"), "group", "value")
    t = welch_t(at).select(F.col("metric.metric").alias("metric"), F.col("metric.timepoint").alias("timepoint"),
                           I, J, "t", "df", "p")
    return correct_pvalues(t, ["metric"], correction, order=("timepoint", I, J))


def melt(table: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Wide replicate rows to ``(ids…, metric, value)``."""
    return table.select(*ids, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
