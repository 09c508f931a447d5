import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.functions import dist as P, tails as T
from lociflow.operators import circular as C, group_stats as G


def close(a, b, tol=1e-4):
    assert abs(a - b) <= tol, (a, b)


@pytest.fixture
def value(spark):
    """The number that a column of literals has."""
    one = spark.range(1)
    return lambda fn, *args: one.select(fn(*(F.lit(a) for a in args))).first()[0]


def test_distribution_functions_against_tables(value):
    close(value(T.norm_sf, 1.959964), 0.025, 1e-7)
    close(value(T.t_two_sided, 2.228139, 10), 0.05, 1e-6)
    close(value(T.t_two_sided, 12.7062, 1), 0.05, 1e-6)
    close(value(T.f_sf, 4.102821, 2, 10), 0.05, 1e-6)
    close(value(T.chi2_sf, 5.991465, 2), 0.05, 1e-7)
    close(value(T.chi2_sf, 18.307038, 10), 0.05, 1e-7)
    close(value(T.range_sf, 3.877, 3, 10), 0.05, 2e-4)
    close(value(T.range_sf, 4.898, 4, 6), 0.05, 3e-4)
    for d, n in ((0.5, 64), (0.8, 26), (0.0, 501)):
        assert value(lambda x: T.sample_size(x, 0.80), d) == n


def test_normal_tail_against_the_library(spark):
    z = [k / 7 for k in range(-280, 281)]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(T.norm_sf(F.col("z")).alias("p"), "z").collect()
    assert all(abs(r.p - math.erfc(r.z / math.sqrt(2)) / 2) <= 1e-14 * max(r.p, 1e-280) + 1e-16 for r in got)


def test_exact_rank_tests_against_tables(value):
    close(value(T.mann_whitney, 0, 3, 3, 0), 0.1, 1e-12)             # 2 / C(6, 3)
    close(value(T.mann_whitney, 2, 4, 5, 0), 0.063492, 1e-6)
    close(value(T.wilcoxon, 0, 6, 0, 0), 2 / 64, 1e-12)
    close(value(T.wilcoxon, 3, 8, 0, 0), 0.0390625, 1e-9)


def test_unknown_arguments_give_null(value):
    for fn, n in ((T.norm_sf, 1), (T.t_two_sided, 2), (T.t_sf, 2), (T.f_sf, 3), (T.chi2_sf, 2), (T.range_sf, 3), (T.mann_whitney, 4), (T.wilcoxon, 4)):
        for bad in (None, float("nan")):
            assert value(fn, *([1.0] * (n - 1)), bad) is None, fn
    assert value(lambda x: T.sample_size(x, 0.8), None) is None and value(T.wilcoxon, 0.0, 0.0, 0.0, 0.0) is None


def test_shapiro_against_published_values():
    # weights of eleven men, the worked example of the original paper
    w = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    close(P.shapiro_p(np.array(w)), 0.0067, 5e-4)
    assert P.shapiro_p(np.linspace(-2, 2, 20)) > 0.05
    assert np.isnan(P.shapiro_p(np.ones(5)))


@pytest.fixture
def values(spark):
    rng = np.random.default_rng(0)
    rows = [("m", g, float(v)) for g, mu in (("a", 0), ("b", 2), ("c", 2)) for v in rng.normal(mu, 1, 8)]
    rows += [("tiny", "a", 1.0), ("tiny", "a", 2.0), ("tiny", "b", 5.0), ("tiny", "b", 6.5), ("one", "a", 1.0), ("one", "b", 2.0)]
    return spark.createDataFrame(rows, "metric string, group string, value double")


def test_comparison_notes_and_families(values):
    omni, pairs = G.compare_metrics(values, {"parametric_strategy": "force_parametric"})
    o = {r.metric: r for r in omni.collect()}
    p = {(r.metric, r.group_i, r.group_j): r for r in pairs.collect()}
    assert o["m"].test == "Welch's ANOVA" and o["m"].stars.startswith("*") and 0 < o["m"].effect_size < 1
    assert o["tiny"].test == "Welch's t-test" and o["tiny"].stars == "" and "underpowered" in o["tiny"].note
    assert "one" not in o and p[("one", "a", "b")].test == "n<2" and p[("one", "a", "b")].p is None
    r = p[("m", "a", "b")]
    assert r.p <= r.p_corrected <= 1 and r.cohens_d < 0 and r.cliffs_delta < 0
    tuk = {(r.group_i, r.group_j): r for r in G.compare_metrics(values.where("metric = 'm'"), {
        "posthoc": "tukey", "parametric_strategy": "force_parametric"})[1].collect()}
    assert tuk[("a", "b")].test == "Tukey HSD" and tuk[("a", "b")].p_corrected == tuk[("a", "b")].p


def test_seeded_resampling_repeats(values):
    v = values.where("metric = 'm'")
    a, b = (sorted(map(str, G.permutation_test(v, 199).collect())) for _ in range(2))
    assert a == b
    p = {(r.group_i, r.group_j): r.p for r in G.permutation_test(v, 499).collect()}
    data = {g: np.array([r.value for r in v.where(F.col("group") == g).orderBy("value").collect()]) for g in "abc"}
    shuffle = np.random.default_rng(1)
    for (i, j), got in p.items():
        both = np.concatenate([data[i], data[j]])
        draws = np.array([(lambda q: q[:8].mean() - q[8:].mean())(shuffle.permutation(both)) for _ in range(5000)])
        seen = data[i].mean() - data[j].mean()
        close(got, min(1.0, 2 * min((draws <= seen).mean(), (draws >= seen).mean())), 0.03)
    ci = {(r.group_i, r.group_j): r for r in G.bootstrap_ci(v, 200).collect()}
    g = {(r.group_i, r.group_j): r.hedges_g for r in G.effect_sizes(v).collect()}
    assert all(ci[k].hedges_g_ci_low < g[k] < ci[k].hedges_g_ci_high for k in g)
    d = {r.group: r.p for r in G.dunnett(v, "a", 2000).collect()}
    assert d["c"] < 0.01 and 0 <= d["c"] <= d["b"] <= 1


def test_configuration_falls_back():
    cfg = G.stat_config({"alpha": 2, "correction": "HOLM", "posthoc": "pairwise", "nonsense": 1, "tost_margin": "x"})
    assert (cfg["alpha"], cfg["correction"], cfg["posthoc"], cfg["tost_margin"]) == (0.05, "holm", "auto", 0.5)
    assert "nonsense" not in cfg


def test_corrections_by_hand(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, 0.03), ("f", 4, None), ("g", 1, 0.2)], "fam string, i int, p double")
    def run(m): return {(r.fam, r.i): r.q for r in G.correct_pvalues(df, ["fam"], m, out="q", order=("i",)).collect()}
    h = run("holm")
    close(h[("f", 1)], 0.03, 1e-12); close(h[("f", 3)], 0.06, 1e-12); close(h[("f", 2)], 0.06, 1e-12)
    assert h[("f", 4)] is None and h[("g", 1)] == 0.2
    b = run("fdr_bh")
    close(b[("f", 1)], 0.03, 1e-12); close(b[("f", 3)], 0.04, 1e-12)
    close(run("hochberg")[("f", 3)], 0.04, 1e-12)


def test_epsilon_is_one_for_spherical_data(spark):
    rng = np.random.default_rng(4)
    rows = [("m", g, t, s, float(x)) for g in range(2) for s in range(40) for t, x in enumerate(rng.normal(0, 1, 4))]
    df = spark.createDataFrame(rows, "metric string, group int, timepoint int, cell int, value double")
    r = {x.effect: x for x in G.mixed_anova(df).collect()}
    assert 0.85 < r["timepoint"].eps <= 1 and r["group"].df2 == 78 and r["interaction"].df1 == 3


def test_circular_extremes(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 180.0)] + [(2, 10.0)] * 20 + [(3, 5.0)] + [(4, a) for a in (-170.0, 175.0, 180.0)],
                               "recording_id int, turning_angle_deg double")
    r = {x.recording_id: x for x in C.circular_stats(df).collect()}
    assert r[1].mean_resultant_length < 1e-12 and r[1].concentration_kappa == 0
    close(r[2].mean_direction_deg, 10, 1e-9)
    assert r[3].n == 1 and r[3].mean_resultant_length is None
    assert {x.recording_id: x.median_deg for x in C.circular_median(df).collect()}[4] == 180.0


def test_large_groups_are_tested_by_moments(spark):
    rng = np.random.default_rng(7)
    rows = [(f"m{k}", "a", float(v)) for k in range(300) for v in rng.normal(3, 2, 60)]
    rows += [("skewed", "a", float(v)) for v in rng.exponential(1, 6000)] + [("skewed", "b", float(v)) for v in rng.normal(0, 1, 50)]
    rows += [("heavy", "a", float(v)) for v in rng.standard_t(4, 6000)] + [("flat", "a", float(v)) for v in rng.uniform(0, 1, 6000)]
    rows += [("constant", "a", 1.0)] * 6000 + [("empty", "a", None)]
    v = spark.createDataFrame(rows, "metric string, group string, value double")
    got = {r.metric: r for r in G.normality_gate(v).collect()}
    assert not any(got[m].parametric for m in ("skewed", "heavy", "flat")) and got["constant"].parametric and got["empty"].parametric
    assert [got[m].n_by_moments for m in ("skewed", "m0", "empty")] == [1, 0, 0]
    by_moments = G.normality_gate(v.where("metric LIKE 'm%'"), exact_upto=0).collect()
    assert all(r.n_by_moments == 1 for r in by_moments)
    share = np.mean([not r.parametric for r in by_moments])
    exact = np.mean([not got[r.metric].parametric for r in by_moments])
    assert 0.02 < share < 0.1 and 0.02 < exact < 0.1
