"""Queries over recordings: summaries, directions, group tests."""
from __future__ import annotations

from pyspark.sql import functions as F

from lociflow import recipes as V
from lociflow.operators import circular as C, diffusion as D, group_stats as G, steps as S, summary as M
from lociflow.operators import tracks as K
from lociflow.plans.catalog import query, r, rounded, rs
from lociflow.plans.sql_tails import chi2_sql, f_sql, mann_whitney_sql, normal_sql, range_sql, t_sql, wilcoxon_sql
from lociflow.session import cut_lineage
from lociflow.plans.sql_views import DIFFUSION, FIT, PAIRS, STEPS
from lociflow.plans.track_queries import ANGLES, diffusion
from lociflow.recipes import FRAME_INTERVAL as DT, PIXEL_SIZE as PX, SQL_ASSIGN, SQL_LOCS, SQL_TRACKS


def scalars(spark, d):
    """Four scalars per recording with its group, time point and cell, long."""
    per = V.tracks(spark, d).groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("n_localisations"), F.count_distinct("particle").alias("n_tracks"),
        F.avg("mass").alias("mean_mass"), F.stddev_samp("x").alias("spread"))
    return G.melt(per.join(V.assignments(spark, d), "recording_id"), ["recording_id", "group", "timepoint", "cell"],
                  ["n_localisations", "n_tracks", "mean_mass", "spread"])


VALUES = SQL_TRACKS + "," + SQL_ASSIGN + """,
per AS (SELECT recording_id, count(*)::DOUBLE AS n_localisations, count(DISTINCT particle)::DOUBLE AS n_tracks,
               avg(mass) AS mean_mass, stddev_samp(x) AS spread FROM tracks GROUP BY recording_id),
vals AS (SELECT recording_id, a."group", a.timepoint, a.cell, m AS metric,
           CASE m WHEN 'n_localisations' THEN n_localisations WHEN 'n_tracks' THEN n_tracks
                  WHEN 'mean_mass' THEN mean_mass ELSE spread END AS value
         FROM per JOIN assignments a USING (recording_id)
         CROSS JOIN (SELECT unnest(['n_localisations', 'n_tracks', 'mean_mass', 'spread']) AS m)),
moments AS (SELECT metric, "group", count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM vals GROUP BY ALL),
pairs_of AS (SELECT a.metric, a."group" AS group_i, b."group" AS group_j, a.n AS n_i, b.n AS n_j,
               a.mean AS mean_i, b.mean AS mean_j, a.var AS var_i, b.var AS var_j,
               nullif(sqrt(((a.n-1)*a.var + (b.n-1)*b.var) / (a.n+b.n-2)), 0) AS sp
             FROM moments a JOIN moments b ON a.metric = b.metric AND a."group" < b."group" WHERE a.n >= 2 AND b.n >= 2),
both_of AS (SELECT p.metric, p.group_i, p.group_j, p.n_i, p.n_j, v."group" AS g, v.value FROM pairs_of p JOIN vals v
              ON v.metric = p.metric AND v."group" IN (p.group_i, p.group_j)),
ranked_pairs AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY metric, group_i, group_j, value) - 1) / 2.0 AS rk
                 FROM both_of WINDOW w AS (PARTITION BY metric, group_i, group_j ORDER BY value)),
u_of AS (SELECT metric, group_i, group_j, n_i, n_j, sum(rk) FILTER (g = group_i) - n_i*(n_i+1)/2.0 AS U
         FROM ranked_pairs GROUP BY metric, group_i, group_j, n_i, n_j),
ranked AS (SELECT metric, "group", value, rank() OVER w + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS rk
           FROM vals WINDOW w AS (PARTITION BY metric ORDER BY value)),
tie_of AS (SELECT metric, sum(t*t*t - t)::DOUBLE AS ties, sum(t) AS total FROM (
             SELECT metric, value, count(*) AS t FROM vals GROUP BY ALL) GROUP BY metric),
rank_of AS (SELECT metric, "group", count(*) AS n, sum(rk) AS rank_sum FROM ranked GROUP BY ALL)"""
WELCH_T = "(mean_i - mean_j) / nullif(sqrt(var_i/n_i + var_j/n_j), 0)"
WELCH_DF = "(var_i/n_i + var_j/n_j)**2 / nullif((var_i/n_i)**2/(n_i-1) + (var_j/n_j)**2/(n_j-1), 0)"


@query("group_pairs", f"""WITH {VALUES} SELECT metric, group_i, group_j, n_i, n_j, {rs('mean_i', 'mean_j', 'var_i', 'var_j')}
FROM pairs_of""")
def group_pairs(spark, d):
    return rounded(G.group_pairs(G.group_moments(scalars(spark, d))))


WELCH = f"""
welch AS (SELECT metric, group_i, group_j, n_i, n_j, mean_i, mean_j, var_i, var_j, sp, {WELCH_T} AS t, {WELCH_DF} AS df FROM pairs_of)"""


@query("welch_t", f"""WITH {VALUES}, {WELCH} SELECT metric, group_i, group_j, n_i, n_j, {rs('t', 'df')}, {r(t_sql('t', 'df'))} AS p FROM welch""")
def welch_t(spark, d):
    return rounded(G.welch_t(scalars(spark, d)).select("metric", "group_i", "group_j", "n_i", "n_j", "t", "df", "p"))


@query("welch_t_pvalues", f"""WITH {VALUES}, {WELCH} SELECT metric, group_i, group_j, n_i, n_j, {rs('mean_i', 'mean_j', 't', 'df')}, {r(t_sql('t', 'df'))} AS p FROM welch""")
def welch_t_pvalues(spark, d):
    return rounded(G.welch_t(scalars(spark, d)))


@query("oneway_anova", f"""WITH {VALUES},
tot AS (SELECT metric, count(*) AS k, sum(n)::BIGINT AS total, sum(n*mean)/sum(n) AS grand, sum((n-1)*var) AS ssw FROM moments GROUP BY ALL),
b AS (SELECT t.metric, k, total, ssw, sum(n*(mean-grand)**2) AS ssb FROM tot t JOIN moments USING (metric) GROUP BY ALL),
f AS (SELECT metric, k, total, k - 1 AS df1, total - k AS df2, (ssb/(k-1))/(ssw/(total-k)) AS F, ssb/(ssb+ssw) AS eta_sq FROM b)
SELECT metric, k, total, df1, df2, {rs('F', 'eta_sq')}, {r(f_sql('F', 'df1', 'df2'))} AS p FROM f""")
def oneway_anova(spark, d):
    return rounded(G.oneway_anova(scalars(spark, d)).drop("ss_between", "ss_within"))


@query("welch_anova", f"""WITH {VALUES},
w AS (SELECT *, n / var AS w FROM moments), t AS (SELECT metric, count(*) AS k, sum(w) AS W_, sum(w*mean)/sum(w) AS c FROM w GROUP BY ALL),
s AS (SELECT metric, k, sum(w*(mean-c)**2) AS a, sum((1 - w/W_)**2/(n-1)) AS s FROM w JOIN t USING (metric) GROUP BY ALL),
f AS (SELECT metric, k, k - 1 AS df1, (a/(k-1)) / (1 + 2.0*(k-2)/(k*k-1)*s) AS F, (k*k-1)/(3*s) AS df2 FROM s)
SELECT metric, k, df1, {rs('F', 'df2')}, {r(f_sql('F', 'df1', 'df2'))} AS p FROM f""")
def welch_anova(spark, d):
    return rounded(G.welch_anova(scalars(spark, d)))


RANK_TEST = """
tied AS (SELECT metric, group_i, group_j, sum(t*t*t - t)::double AS ties FROM (SELECT metric, group_i, group_j, value, count(*) AS t FROM both_of GROUP BY ALL) GROUP BY ALL),
mw AS (SELECT * FROM u_of JOIN tied USING (metric, group_i, group_j))"""


@query("mann_whitney", f"""WITH {VALUES}, {RANK_TEST} SELECT metric, group_i, group_j, n_i, n_j, U, {r('2*U/(n_i*n_j) - 1')} AS rank_biserial,
{r(mann_whitney_sql('U', 'n_i', 'n_j', 'ties'))} AS p FROM mw""")
def mann_whitney(spark, d):
    return rounded(G.mann_whitney(scalars(spark, d)).drop("ties", "cliffs_delta"))


@query("mann_whitney_pvalues", f"""WITH {VALUES}, {RANK_TEST} SELECT metric, group_i, group_j, n_i, n_j, U, ties, {r(mann_whitney_sql('U', 'n_i', 'n_j', 'ties'))} AS p,
{r('2*U/(n_i*n_j) - 1')} AS cliffs_delta, {r('2*U/(n_i*n_j) - 1')} AS rank_biserial FROM mw""")
def mann_whitney_pvalues(spark, d):
    return rounded(G.mann_whitney(scalars(spark, d)))


KRUSKAL = """
h AS (SELECT metric, count(*) AS k, total, ties, (12.0/(total*(total+1))*sum(rank_sum**2/n) - 3*(total+1)) / nullif(1 - ties/(total**3-total), 0) AS H
      FROM rank_of JOIN tie_of USING (metric) GROUP BY metric, total, ties)"""


@query("kruskal", f"""WITH {VALUES}, {KRUSKAL} SELECT metric, k, total::BIGINT AS total, {rs('H')},
{r('CASE WHEN H IS NOT NULL THEN least(greatest((H - k + 1)/(total - k), 0), 1) END')} AS epsilon_sq, {r(chi2_sql('H', '(k - 1)'))} AS p FROM h""")
def kruskal(spark, d):
    return rounded(G.kruskal(scalars(spark, d)))


@query("brunner_munzel", f"""WITH {VALUES},
wi AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY metric, group_i, group_j, g, value) - 1)/2.0 AS rw FROM ranked_pairs
       WINDOW w AS (PARTITION BY metric, group_i, group_j, g ORDER BY value)),
a AS (SELECT metric, group_i, group_j, g, count(*) AS n, avg(rk) AS mr, var_samp(rk - rw) AS s2 FROM wi GROUP BY ALL),
p AS (SELECT i.metric, i.group_i, i.group_j, i.n AS n_i, j.n AS n_j, i.mr AS mi, j.mr AS mj, i.n*i.s2 AS vi, j.n*j.s2 AS vj
      FROM a i JOIN a j ON i.metric=j.metric AND i.group_i=j.group_i AND i.group_j=j.group_j AND i.g=i.group_i AND j.g=j.group_j)
, w AS (SELECT metric, group_i, group_j, n_i, n_j, n_i*n_j*(mj-mi)/((n_i+n_j)*sqrt(vi+vj)) AS W, (vi+vj)**2/(vi**2/(n_i-1)+vj**2/(n_j-1)) AS df FROM p)
SELECT metric, group_i, group_j, n_i, n_j, {rs('W', 'df')}, {r(t_sql('W', 'df'))} AS p FROM w""")
def brunner_munzel(spark, d):
    return rounded(G.brunner_munzel(scalars(spark, d)))


# Draws are numbered by the MD5 of what they belong to, so both engines draw alike.
INDEXED = """
idx AS (SELECT *, row_number() OVER (PARTITION BY metric, group_i, group_j, g ORDER BY value) - 1 AS idx FROM both_of)"""


def hash01(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0)"


@query("permutation_test", f"""WITH {VALUES}, {INDEXED},
dr AS (SELECT i.*, d, row_number() OVER (PARTITION BY metric, group_i, group_j, d ORDER BY md5('0|' || d || '|' || metric || '|' || g || '|' || idx), value) AS place
       FROM idx i, (SELECT unnest(range(1, 10000)) AS d)),
su AS (SELECT metric, group_i, group_j, d, n_i, n_j, sum(value) FILTER (place <= n_i) / n_i - sum(value) FILTER (place > n_i) / n_j AS diff FROM dr GROUP BY metric, group_i, group_j, d, n_i, n_j),
ob AS (SELECT metric, group_i, group_j, sum(value) FILTER (g = group_i) / n_i - sum(value) FILTER (g = group_j) / n_j AS seen FROM both_of GROUP BY metric, group_i, group_j, n_i, n_j),
ta AS (SELECT metric, group_i, group_j, count(*) AS draws, count(*) FILTER (diff <= seen + abs(seen)*1e-12) AS lo, count(*) FILTER (diff >= seen - abs(seen)*1e-12) AS hi
       FROM su JOIN ob USING (metric, group_i, group_j) GROUP BY ALL)
SELECT metric, group_i, group_j, draws, {r('least(2 * least((lo + 1)/(draws + 1), (hi + 1)/(draws + 1)), 1)')} AS p FROM ta""")
def permutation_test(spark, d):
    return rounded(G.permutation_test(scalars(spark, d)))


@query("normality_gate")
def normality_gate(spark, d):
    return rounded(G.normality_gate(scalars(spark, d)))


@query("effect_sizes", f"""WITH {VALUES},
cl AS (SELECT p.metric, p.group_i, p.group_j, avg(sign(a.value - b.value)) AS delta FROM pairs_of p
       JOIN vals a ON a.metric=p.metric AND a."group"=p.group_i JOIN vals b ON b.metric=p.metric AND b."group"=p.group_j GROUP BY ALL)
SELECT p.metric, p.group_i, p.group_j, n_i, n_j, {r('(mean_i-mean_j)/sp')} AS cohens_d,
 {r('(mean_i-mean_j)/sp*(1 - 3.0/(4*(n_i+n_j-2)-1))')} AS hedges_g, {r('delta')} AS cliffs_delta, {r('delta')} AS rank_biserial
FROM pairs_of p JOIN cl USING (metric, group_i, group_j)""")
def effect_sizes(spark, d):
    return rounded(G.effect_sizes(scalars(spark, d)))


def bootstrap_sql(level: float) -> str:
    """Intervals of Hedges' g and Cliff's δ, δ by all pairs of drawn values."""
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    return INDEXED + f""",
pk AS (SELECT s.metric, s.group_i, s.group_j, s.g, b, CAST(floor({hash01("'0|' || b || '|' || s.metric || '|' || s.g || '|' || s.idx")} * CASE WHEN s.g = s.group_i THEN s.n_i ELSE s.n_j END) AS BIGINT) AS idx
       FROM idx s, (SELECT unnest(range(1, 2001)) AS b)),
dw AS (SELECT p.metric, p.group_i, p.group_j, p.g, p.b, i.value FROM pk p JOIN idx i ON (p.metric, p.group_i, p.group_j, p.g, p.idx) = (i.metric, i.group_i, i.group_j, i.g, i.idx)),
mo AS (SELECT metric, group_i, group_j, b, count(*) FILTER (g = group_i) AS ni, count(*) FILTER (g = group_j) AS nj, avg(value) FILTER (g = group_i) AS mi, avg(value) FILTER (g = group_j) AS mj,
         var_samp(value) FILTER (g = group_i) AS vi, var_samp(value) FILTER (g = group_j) AS vj, list(value) FILTER (g = group_i) AS la, list(value) FILTER (g = group_j) AS lb FROM dw GROUP BY ALL),
ef AS (SELECT metric, group_i, group_j, CASE WHEN (ni-1)*vi + (nj-1)*vj > 0 THEN (mi - mj) / sqrt(((ni-1)*vi + (nj-1)*vj)/(ni+nj-2)) * (1 - 3.0/(4*(ni+nj-2)-1)) END AS g,
         list_sum(list_transform(la, lambda x: list_sum(list_transform(lb, lambda y: sign(x - y))))) / (ni*nj) AS dl FROM mo),
ci AS (SELECT metric, group_i, group_j, count(g) AS resamples, quantile_cont(g, {low}) AS g_low, quantile_cont(g, {high}) AS g_high,
         quantile_cont(dl, {low}) AS d_low, quantile_cont(dl, {high}) AS d_high FROM ef GROUP BY ALL)"""


@query("bootstrap_ci", f"""WITH {VALUES}, {bootstrap_sql(0.95)} SELECT metric, group_i, group_j, resamples, {r('g_low')} AS hedges_g_ci_low, {r('g_high')} AS hedges_g_ci_high,
{r('d_low')} AS cliffs_delta_ci_low, {r('d_high')} AS cliffs_delta_ci_high FROM ci""")
def bootstrap_ci(spark, d):
    return rounded(G.bootstrap_ci(scalars(spark, d)))


@query("needed_sample_size")
def needed_sample_size(spark, d):
    return rounded(G.needed_sample_size(scalars(spark, d)))


@query("tost", f"""WITH {VALUES}, {WELCH},
b AS (SELECT *, (mean_i - mean_j + 0.5*sp)/sqrt(var_i/n_i + var_j/n_j) AS t_lower, (mean_i - mean_j - 0.5*sp)/sqrt(var_i/n_i + var_j/n_j) AS t_upper FROM welch WHERE sp IS NOT NULL),
h AS (SELECT *, {t_sql('t_lower', 'df')} / 2 AS hl, {t_sql('t_upper', 'df')} / 2 AS hu FROM b),
p AS (SELECT *, greatest(CASE WHEN t_lower >= 0 THEN hl ELSE 1 - hl END, CASE WHEN t_upper <= 0 THEN hu ELSE 1 - hu END) AS p FROM h)
SELECT metric, group_i, group_j, {rs('df', 't_lower', 't_upper', 'p')}, p < 0.05 AS equivalent FROM p""")
def tost(spark, d):
    return rounded(G.tost(scalars(spark, d)))


@query("posthoc", f"""WITH {VALUES},
fam AS (SELECT metric, sum(n) - count(*) AS dfw, sum((n-1)*var)/(sum(n)-count(*)) AS msw FROM moments GROUP BY ALL),
dn AS (SELECT a.metric, a."group" AS group_i, b."group" AS group_j,
        (a.rank_sum/a.n - b.rank_sum/b.n)/nullif(sqrt((total*(total+1)/12.0 - ties/(12.0*(total-1)))*(1.0/a.n + 1.0/b.n)), 0) AS z
       FROM rank_of a JOIN rank_of b ON a.metric=b.metric AND a."group"<b."group" JOIN tie_of t ON t.metric=a.metric),
all_of AS (
  SELECT 'tukey' AS method, metric, group_i, group_j, abs(mean_i-mean_j)/nullif(sqrt(msw/2*(1.0/n_i+1.0/n_j)), 0) AS statistic, dfw::DOUBLE AS df FROM pairs_of JOIN fam USING (metric)
  UNION ALL SELECT 'games_howell', metric, group_i, group_j, abs(mean_i-mean_j)/nullif(sqrt((var_i/n_i+var_j/n_j)/2), 0), {WELCH_DF} FROM pairs_of
  UNION ALL SELECT 'dunn', metric, group_i, group_j, z, NULL FROM dn),
k_of AS (SELECT metric, count(*) AS k FROM moments GROUP BY ALL)
SELECT method, metric, group_i, group_j, {rs('statistic', 'df')},
  {r(f"CASE WHEN method = 'dunn' THEN 2 * {normal_sql('abs(statistic)')} ELSE {range_sql('statistic', 'k', 'df')} END")} AS p FROM all_of JOIN k_of USING (metric)""")
def posthoc(spark, d):
    v = scalars(spark, d)
    parts = [G.posthoc(v, m).withColumn("method", F.lit(m)) for m in ("tukey", "games_howell", "dunn")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def gauss_sql(name: str) -> str:
    text = f"'0|' || d || '|' || metric || '|' || {name}"
    a, b = (hash01(text + f" || '|{end}'") for end in "ab")
    return f"(sqrt(-2 * ln(1 - {a})) * cos({b} * 6.283185307179586))"


DUNNETT = f"""
fam AS (SELECT metric, sum(n) - count(*) AS dfw, sum((n-1)*var)/(sum(n)-count(*)) AS msw FROM moments GROUP BY ALL),
tc AS (SELECT m.metric, m."group", c."group" AS control, m.n, c.n AS n_c, m.mean, c.mean AS mean_c, dfw, (m.mean - c.mean)/nullif(sqrt(msw*(1.0/m.n + 1.0/c.n)), 0) AS t
       FROM moments m JOIN moments c ON m.metric = c.metric AND c."group" = 0 AND m."group" <> 0 JOIN fam ON fam.metric = m.metric),
nu AS (SELECT metric, d, max(abs({gauss_sql("'group ' || " + '"group"')}/sqrt(n) - {gauss_sql("'control'")}/sqrt(n_c))
         / sqrt(greatest(pow(1 - 2/(9*dfw) + {gauss_sql("'scale'")}*sqrt(2/(9*dfw)), 3), 1e-12) * (1.0/n + 1.0/n_c))) AS worst
       FROM tc, (SELECT unnest(range(1, 20001)) AS d) GROUP BY ALL),
dp AS (SELECT tc.*, (SELECT avg((worst >= abs(tc.t))::int) FROM nu WHERE nu.metric = tc.metric) AS p FROM tc)"""


@query("dunnett", f"""WITH {VALUES}, {DUNNETT} SELECT metric, "group", control, n, n_c, {rs('t', 'p')} FROM dp""")
def dunnett(spark, d):
    return rounded(G.dunnett(scalars(spark, d), "0"))


PAIRED = VALUES + """,
tt AS (SELECT metric, count(DISTINCT timepoint) AS t FROM vals GROUP BY ALL),
cells AS (SELECT metric, "group", cell, count(*) AS n_rows, count(DISTINCT timepoint) AS nt, any_value(t) AS t
          FROM vals JOIN tt USING (metric) GROUP BY metric, "group", cell),
complete AS (SELECT v.* FROM vals v SEMI JOIN (SELECT * FROM cells WHERE n_rows = t AND nt = t) c USING (metric, "group", cell)),
diffs AS (SELECT metric, "group", cell, max(value) FILTER (timepoint=1) - max(value) FILTER (timepoint=0) AS diff FROM complete GROUP BY ALL)"""


@query("pair_subjects", f"""WITH {PAIRED} SELECT metric, "group", cell, n_rows, t - nt AS n_missing,
(n_rows = t AND nt = t) AS complete FROM cells""")
def pair_subjects(spark, d):
    kept, dropped = G.paired_values(scalars(spark, d))
    whole = kept.groupBy("metric", "group", "cell").agg(F.count(F.lit(1)).alias("n_rows"))
    return whole.withColumns({"n_missing": F.lit(0).cast("long"), "complete": F.lit(True)}).unionByName(
        dropped.withColumn("complete", F.lit(False)))


PAIRED_TEST = PAIRED + """,
rk AS (SELECT metric, "group", diff, rank() OVER (PARTITION BY metric, "group" ORDER BY abs(diff))
         + (count(*) OVER (PARTITION BY metric, "group", abs(diff)) - 1)/2.0 AS rk FROM diffs WHERE diff <> 0),
w AS (SELECT metric, "group", coalesce(sum(rk) FILTER (diff > 0), 0)::DOUBLE AS w_plus, count(*) AS nz FROM rk GROUP BY ALL),
tie AS (SELECT metric, "group", sum(t*t*t - t)::DOUBLE AS ties FROM (SELECT metric, "group", abs(diff), count(*) AS t FROM diffs WHERE diff <> 0 GROUP BY ALL) GROUP BY ALL),
pt AS (SELECT d.metric, d."group", count(*) AS n, avg(diff) AS mean_diff, avg(diff)/nullif(stddev_samp(diff)/sqrt(count(*)), 0) AS t, count(*) - 1 AS df,
         any_value(w_plus) AS w_plus, avg(diff)/nullif(stddev_samp(diff), 0)*(1 - 3.0/(4*(count(*)-1)-1)) AS paired_hedges_g,
         any_value(nz) AS nz, any_value(ties) AS ties, count(*) FILTER (diff = 0) AS zeros
       FROM diffs d LEFT JOIN w USING (metric, "group") LEFT JOIN tie USING (metric, "group") GROUP BY d.metric, d."group")"""


@query("paired_test", f"""WITH {PAIRED_TEST} SELECT metric, "group", n, {rs('mean_diff', 't')}, df, w_plus, {rs('paired_hedges_g')} FROM pt""")
def paired_test(spark, d):
    kept, _ = G.paired_values(scalars(spark, d))
    return rounded(G.paired_test(G.paired_differences(kept, 0, 1)).drop("p_t", "p_wilcoxon"))


@query("paired_test_pvalues", f"""WITH {PAIRED_TEST} SELECT metric, "group", n, {rs('mean_diff', 't')}, df, w_plus, {rs('paired_hedges_g')},
{r(t_sql('t', 'df'))} AS p_t, {r(wilcoxon_sql('w_plus', 'nz', 'ties', 'zeros'))} AS p_wilcoxon FROM pt""")
def paired_test_pvalues(spark, d):
    kept, _ = G.paired_values(scalars(spark, d))
    return rounded(G.paired_test(G.paired_differences(kept, 0, 1)))


@query("ks_two_sample", f"""WITH {VALUES},
c AS (SELECT DISTINCT metric, group_i, group_j, value, n_i, n_j,
        count(*) FILTER (g = group_i) OVER w AS ci, count(*) FILTER (g = group_j) OVER w AS cj FROM both_of
      WINDOW w AS (PARTITION BY metric, group_i, group_j ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT metric, group_i, group_j, n_i, n_j, {r('max(abs(ci::DOUBLE/n_i - cj::DOUBLE/n_j))')} AS D FROM c GROUP BY ALL""")
def ks_two_sample(spark, d):
    return rounded(G.ks_two_sample(scalars(spark, d)))


# p-values both engines can compute alike: survival of |z| from the Dunn ranks has no
# closed form, so the correction is checked on 1/(1+t²), which lies in (0, 1] too.
_P = f"1 / (1 + ({WELCH_T})**2)"


@query("correct_pvalues", f"""WITH {VALUES},
p AS (SELECT metric, group_i, group_j, {_P} AS p FROM pairs_of),
k AS (SELECT *, count(*) OVER (PARTITION BY metric) AS m, row_number() OVER (PARTITION BY metric ORDER BY p) AS rk FROM p)
SELECT metric, group_i, group_j, {rs('p')}, {r('least(p*m, 1)')} AS bonferroni, {r('1 - (1-p)**m')} AS sidak,
 {r('least(max((m-rk+1)*p) OVER u, 1)')} AS holm, {r('least(min((m-rk+1)*p) OVER dn, 1)')} AS hochberg,
 {r('least(min(p*m/rk) OVER dn, 1)')} AS fdr_bh FROM k
WINDOW u AS (PARTITION BY metric ORDER BY rk), dn AS (PARTITION BY metric ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def correct_pvalues(spark, d):
    t = G.welch_t(scalars(spark, d)).select("metric", "group_i", "group_j", (1 / (1 + F.col("t") * F.col("t"))).alias("p"))
    for m in ("bonferroni", "sidak", "holm", "hochberg", "fdr_bh"):
        t = G.correct_pvalues(t, ["metric"], m, out=m, order=("group_i", "group_j"))
    return rounded(t)


@query("family_correction", f"""WITH {VALUES},
p AS (SELECT metric, group_i, group_j, {_P} AS p FROM pairs_of WHERE metric <> 'spread'),
k AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS rk FROM p)
SELECT metric, group_i, group_j, {rs('p')}, {r('least(max((m-rk+1)*p) OVER (ORDER BY rk), 1)')} AS p_corrected FROM k
UNION ALL SELECT metric, group_i, group_j, NULL, NULL FROM pairs_of WHERE metric = 'spread'""")
def family_correction(spark, d):
    p = F.when(F.col("metric") != "spread", 1 / (1 + F.col("t") * F.col("t")))
    t = G.welch_t(scalars(spark, d)).select("metric", "group_i", "group_j", p.alias("p"), F.lit(0).alias("all"))
    return rounded(G.correct_pvalues(t, ["all"], "holm", order=("metric", "group_i", "group_j")).drop("all"))


MIXED = PAIRED + """,
g AS (SELECT metric, avg(value) AS gm, count(DISTINCT "group") AS a, count(DISTINCT timepoint) AS b,
        count(DISTINCT ("group", cell)) AS ns FROM complete GROUP BY ALL),
cg AS (SELECT metric, "group", avg(value) AS m, count(*) AS n FROM complete GROUP BY ALL),
ct AS (SELECT metric, timepoint, avg(value) AS m, count(*) AS n FROM complete GROUP BY ALL),
cc AS (SELECT metric, "group", timepoint, avg(value) AS m, count(*) AS n FROM complete GROUP BY ALL),
cs AS (SELECT metric, "group", cell, avg(value) AS m, count(*) AS n FROM complete GROUP BY ALL),
ss AS (SELECT g.metric, a, b, ns,
  (SELECT sum(n*(m-gm)**2) FROM cg WHERE cg.metric=g.metric) AS ss_g,
  (SELECT sum(n*(m-gm)**2) FROM ct WHERE ct.metric=g.metric) AS ss_t,
  (SELECT sum(n*(m-gm)**2) FROM cc WHERE cc.metric=g.metric) AS ss_c,
  (SELECT sum(cs.n*(cs.m-cg.m)**2) FROM cs JOIN cg USING (metric, "group") WHERE cs.metric=g.metric) AS ss_s,
  (SELECT sum((value-gm)**2) FROM complete c WHERE c.metric=g.metric) AS ss_tot FROM g),
e AS (SELECT *, ss_c-ss_g-ss_t AS ss_i, ss_tot-ss_c-ss_s AS ss_e, a-1 AS dg, b-1 AS dt, ns-a AS ds FROM ss)"""


@query("mixed_anova", f"""WITH {MIXED},
rows_of AS (
  SELECT metric, 'group' AS effect, ss_g AS SS, (ss_g/dg)/nullif(ss_s/ds, 0) AS F, dg::DOUBLE AS df1, ds::DOUBLE AS df2, ss_g/nullif(ss_g+ss_s, 0) AS np2, NULL::DOUBLE AS eps FROM e
  UNION ALL SELECT metric, 'timepoint', ss_t, (ss_t/dt)/nullif(ss_e/(ds*dt), 0), dt::DOUBLE, (ds*dt)::DOUBLE, ss_t/nullif(ss_t+ss_e, 0), 1.0::DOUBLE FROM e
  UNION ALL SELECT metric, 'interaction', ss_i, (ss_i/(dg*dt))/nullif(ss_e/(ds*dt), 0), (dg*dt)::DOUBLE, (ds*dt)::DOUBLE, ss_i/nullif(ss_i+ss_e, 0), 1.0::DOUBLE FROM e),
p_of AS (SELECT *, {f_sql('F', 'df1', 'df2')} AS p FROM rows_of)
SELECT metric, effect, {r('SS', 4)} AS SS, {rs('F')}, df1, df2, {rs('np2')}, eps, {r('p')} AS p_unc, {r('CASE WHEN eps IS NOT NULL THEN p END')} AS p_GG FROM p_of""")
def mixed_anova(spark, d):
    return rounded(rounded(G.mixed_anova(scalars(spark, d)), "SS", digits=4), "F", "np2", "eps", "p_unc", "p_GG")


@query("simple_effects", f"""WITH {PAIRED},
m AS (SELECT metric, timepoint, "group", count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM complete GROUP BY ALL),
p AS (SELECT a.metric, a.timepoint, a."group" AS group_i, b."group" AS group_j, a.n n_i, b.n n_j, a.mean mean_i, b.mean mean_j, a.var var_i, b.var var_j
      FROM m a JOIN m b ON a.metric=b.metric AND a.timepoint=b.timepoint AND a."group"<b."group")
, t_of AS (SELECT metric, timepoint, group_i, group_j, {WELCH_T} AS t, {WELCH_DF} AS df FROM p),
p_of AS (SELECT *, {t_sql('t', 'df')} AS p FROM t_of),
ranked_p AS (SELECT *, count(p) OVER (PARTITION BY metric) AS m, row_number() OVER (PARTITION BY metric ORDER BY p NULLS LAST, timepoint, group_i, group_j) AS rk FROM p_of)
SELECT metric, timepoint, group_i, group_j, {rs('t', 'df', 'p')}, {r('CASE WHEN p IS NULL THEN NULL WHEN m = 1 THEN p ELSE least(max((m-rk+1)*p) OVER (PARTITION BY metric ORDER BY rk), 1) END')} AS p_corrected FROM ranked_p""")
def simple_effects(spark, d):
    return rounded(G.simple_effects(scalars(spark, d)))


@query("compare_metrics_pairwise", f"""WITH {VALUES} SELECT metric, group_i, group_j, n_i, n_j, {rs('mean_i', 'mean_j')},
{r('sqrt(var_i/n_i)')} AS sem_i, {r('sqrt(var_j/n_j)')} AS sem_j, {r('(mean_i-mean_j)/sp')} AS cohens_d,
{r('2*U/(n_i*n_j) - 1')} AS cliffs_delta FROM pairs_of JOIN u_of USING (metric, group_i, group_j, n_i, n_j)""")
def compare_metrics_pairwise(spark, d):
    return rounded(G.compare_metrics(scalars(spark, d))[1].select(
        "metric", "group_i", "group_j", "n_i", "n_j", "mean_i", "mean_j", "sem_i", "sem_j", "cohens_d", "cliffs_delta"))


@query("compare_intervals", f"""WITH {VALUES}, {bootstrap_sql(0.9)} SELECT metric, group_i, group_j, 'pairwise' AS family, {r('(mean_i-mean_j)/sp*(1 - 3.0/(4*(n_i+n_j-2)-1))')} AS hedges_g,
{r('g_low')} AS hedges_g_ci_low, {r('g_high')} AS hedges_g_ci_high, {r('d_low')} AS cliffs_delta_ci_low, {r('d_high')} AS cliffs_delta_ci_high FROM ci JOIN pairs_of USING (metric, group_i, group_j)""")
def compare_intervals(spark, d):
    """``ci_level`` 0.9."""
    out = G.compare_metrics(scalars(spark, d), {"ci_level": 0.9})[1]
    return rounded(out.select("metric", "group_i", "group_j", "family", "hedges_g", "hedges_g_ci_low", "hedges_g_ci_high", "cliffs_delta_ci_low", "cliffs_delta_ci_high"))


@query("compare_equivalence", f"""WITH {VALUES}, {WELCH},
b AS (SELECT *, (mean_i - mean_j + 0.8*sp)/sqrt(var_i/n_i + var_j/n_j) AS t_lower, (mean_i - mean_j - 0.8*sp)/sqrt(var_i/n_i + var_j/n_j) AS t_upper FROM welch),
h AS (SELECT *, {t_sql('t_lower', 'df')} / 2 AS hl, {t_sql('t_upper', 'df')} / 2 AS hu FROM b),
p AS (SELECT *, greatest(CASE WHEN t_lower >= 0 THEN hl ELSE 1 - hl END, CASE WHEN t_upper <= 0 THEN hu ELSE 1 - hu END) AS p FROM h)
SELECT metric, group_i, group_j, {r('CASE WHEN sp IS NOT NULL THEN p END')} AS tost_p, CASE WHEN sp IS NOT NULL THEN p < 0.1 END AS tost_equivalent FROM p""")
def compare_equivalence(spark, d):
    """``equivalence_tost`` with a margin of 0.8 pooled standard deviations at 0.1."""
    out = G.compare_metrics(scalars(spark, d), {"equivalence_tost": True, "tost_margin": 0.8, "alpha": 0.1})[1]
    return rounded(out.select("metric", "group_i", "group_j", "tost_p", "tost_equivalent"))


@query("compare_dunnett", f"""WITH {VALUES}, {DUNNETT} SELECT metric, "group" AS group_i, control AS group_j, 'Dunnett' AS test, n AS n_i, n_c AS n_j, {r('mean')} AS mean_i, {r('mean_c')} AS mean_j,
{rs('p')}, {r('p')} AS p_corrected, true AS self_corrected FROM dp""")
def compare_dunnett(spark, d):
    """``dunnett`` against ``control_group`` 0."""
    out = G.compare_metrics(scalars(spark, d), {"dunnett": True, "control_group": "0"})[1].where("family = 'dunnett'")
    return rounded(out.select("metric", "group_i", "group_j", "test", "n_i", "n_j", "mean_i", "mean_j", "p", "p_corrected", "self_corrected"))


@query("compare_metrics_omnibus")
def compare_metrics_omnibus(spark, d):
    return rounded(G.compare_metrics(scalars(spark, d))[0])


# ---- directions -------------------------------------------------------------
CIRC = ANGLES + """,
m0 AS (SELECT recording_id, count(*) AS n, avg(cos(radians(turning_angle_deg))) AS C, avg(sin(radians(turning_angle_deg))) AS S FROM angles GROUP BY ALL),
m1 AS (SELECT *, sqrt(C*C + S*S) AS R, atan2(S, C) AS mu FROM m0),
m2 AS (SELECT m1.*, (SELECT avg(cos(2*(radians(turning_angle_deg)-mu))) FROM angles a WHERE a.recording_id=m1.recording_id) AS a2,
   (SELECT avg(sin(2*(radians(turning_angle_deg)-mu))) FROM angles a WHERE a.recording_id=m1.recording_id) AS b2, n*R*R AS z FROM m1),
kap AS (SELECT *, CASE WHEN R < 0.53 THEN 2*R + R**3 + 5*R**5/6 WHEN R < 0.85 THEN -0.4 + 1.39*R + 0.43/(1-R)
   ELSE 1/(R**3 - 4*R**2 + 3*R) END AS k0, 1 + (2*z - z*z)/(4*n) - (24*z - 132*z*z + 76*z**3 - 9*z**4)/(288*n*n) AS corr FROM m2),
stats AS (SELECT recording_id, n, degrees(mu) AS mean_direction_deg, R AS mean_resultant_length, 1-R AS circular_variance,
   degrees(sqrt(-2*ln(R))) AS circular_std_deg, degrees(sqrt(2*(1-R))) AS angular_deviation_deg,
   CASE WHEN n >= 15 THEN k0 WHEN k0 < 2 THEN greatest(k0 - 2/(n*greatest(k0, 1e-12)), 0) ELSE (n-1)**3*k0/(n**3+n) END AS concentration_kappa,
   z AS rayleigh_z, least(exp(-z + ln(CASE WHEN corr > 0 THEN corr ELSE 1 END)), 1) AS rayleigh_p, R*cos(mu)*sqrt(2*n) AS v_test_z,
   b2/greatest(1-R, 1e-12)**1.5 AS circular_skewness, (a2 - R**4)/greatest(1-R, 1e-12)**2 AS circular_kurtosis FROM kap WHERE n >= 2)"""
_CS = ("mean_direction_deg", "mean_resultant_length", "circular_variance", "circular_std_deg", "angular_deviation_deg",
       "concentration_kappa", "rayleigh_z", "rayleigh_p", "v_test_z", "circular_skewness", "circular_kurtosis")


def circ(spark, d):
    return C.circular_stats(S.turning_angles(V.tracks(spark, d))).where("n >= 2")


@query("circular_stats", f"WITH {CIRC} SELECT recording_id, n, {rs(*_CS, digits=5)} FROM stats")
def circular_stats(spark, d):
    return rounded(circ(spark, d).select("recording_id", "n", *_CS), digits=5)


@query("circular_median", f"""WITH {ANGLES},
d AS (SELECT a.recording_id, a.turning_angle_deg AS a, sum(least(abs(a.turning_angle_deg-b.turning_angle_deg), 360-abs(a.turning_angle_deg-b.turning_angle_deg))) AS cost
      FROM angles a JOIN angles b USING (recording_id) GROUP BY a.recording_id, a.particle, a.frame, a.turning_angle_deg),
n AS (SELECT recording_id FROM angles GROUP BY ALL HAVING count(*) >= 2)
SELECT recording_id, {r('arg_min(a, (round(cost, 6), a))', 5)} AS median_deg FROM d SEMI JOIN n USING (recording_id) GROUP BY recording_id""")
def circular_median(spark, d):
    return rounded(C.circular_median(S.turning_angles(V.tracks(spark, d))), digits=5)


@query("track_mean_angle", f"""WITH {ANGLES} SELECT recording_id, particle,
{r('degrees(atan2(sum(sin(radians(turning_angle_deg))), sum(cos(radians(turning_angle_deg)))))', 5)} AS mean_angle_deg
FROM angles GROUP BY recording_id, particle""")
def track_mean_angle(spark, d):
    return rounded(C.track_mean_angle(S.turning_angles(V.tracks(spark, d))), digits=5)


@query("circular_linear_correlation", f"""WITH {ANGLES},
j AS (SELECT a.recording_id % 3 AS "group", t.mass AS x, cos(radians(turning_angle_deg)) AS c, sin(radians(turning_angle_deg)) AS s
      FROM angles a JOIN tracks t USING (recording_id, particle, frame)),
m AS (SELECT "group", count(*) AS n, corr(x,c) AS xc, corr(x,s) AS xs, corr(c,s) AS cs FROM j GROUP BY ALL)
SELECT "group", n, {r('sqrt((xc**2+xs**2-2*xc*xs*cs)/(1-cs**2))')} AS r, {r('(xc**2+xs**2-2*xc*xs*cs)/(1-cs**2)')} AS r2,
 {r('n*(xc**2+xs**2-2*xc*xs*cs)/(1-cs**2)')} AS test_stat, {r('exp(-n*(xc**2+xs**2-2*xc*xs*cs)/(1-cs**2)/2)')} AS p FROM m WHERE n >= 3""")
def circular_linear_correlation(spark, d):
    t = V.tracks(spark, d)
    joined = S.turning_angles(t).join(t.select("recording_id", "particle", "frame", "mass"), ["recording_id", "particle", "frame"])
    return rounded(C.circular_linear_correlation(joined.withColumn("group", F.col("recording_id") % 3), ["group"],
                                                 "turning_angle_deg", "mass"))


WW = CIRC + """,
mu AS (SELECT recording_id % 3 AS g, radians(mean_direction_deg) AS a FROM stats),
per AS (SELECT g, count(*) AS n, sum(cos(a)) AS c, sum(sin(a)) AS s FROM mu GROUP BY g HAVING count(*) >= 2),
tot AS (SELECT count(*) AS k, sum(n)::BIGINT AS n_total, sum(sqrt(c*c+s*s)) AS sum_r, sqrt(sum(c)**2 + sum(s)**2) AS rp FROM per),
kk AS (SELECT *, rp/n_total AS rb, CASE WHEN rp/n_total < 0.53 THEN 2*(rp/n_total) + (rp/n_total)**3 + 5*(rp/n_total)**5/6
   WHEN rp/n_total < 0.85 THEN -0.4 + 1.39*(rp/n_total) + 0.43/(1-rp/n_total) ELSE 1/((rp/n_total)**3-4*(rp/n_total)**2+3*(rp/n_total)) END AS kp FROM tot)"""


@query("watson_williams", f"""WITH {WW} SELECT k, n_total, {r('(1+3/(8*kp))*(n_total-k)*(sum_r-rp)/((k-1)*(n_total-sum_r))')} AS F,
k-1 AS df1, n_total-k AS df2, {r('kp')} AS kappa_pooled, {r('rb')} AS R_bar_pooled, (kp >= 2 AND rb >= 0.45) AS valid FROM kk""")
def watson_williams(spark, d):
    mu = circ(spark, d).select((F.col("recording_id") % 3).alias("group"), "mean_direction_deg", F.lit(0).alias("all"))
    return rounded(C.watson_williams(mu, ["all"], "group", "mean_direction_deg").drop("all", "p"))


@query("circular_comparison")
def circular_comparison(spark, d):
    from lociflow.plans.compare import circular_comparison as run
    return rounded(run(S.turning_angles(V.tracks(spark, d)), V.assignments(spark, d)))


# ---- recordings ---------------------------------------------------------------
@query("qc_metrics", f"""WITH {FIT},
per AS (SELECT recording_id, particle, count(*) AS l, max(frame)-min(frame)+1 AS s FROM tracks GROUP BY ALL),
o AS (SELECT recording_id, count(*) AS n_locs, max(frame)+1 AS fr FROM observations GROUP BY ALL),
t AS (SELECT recording_id, sum(l)::BIGINT AS n_tracked_locs, avg((s > l)::INT) AS gap_fraction, quantile_cont(l, 0.5) AS median_track_length FROM per GROUP BY ALL),
k AS (SELECT recording_id, avg((D < 1e-3)::INT) AS stuck_fraction FROM fit WHERE D > 0 GROUP BY ALL)
SELECT recording_id, n_locs, n_tracked_locs, {r('n_tracked_locs/n_locs')} AS link_ratio, {r('n_locs/fr')} AS avg_locs_per_frame,
 {r('median_track_length')} AS median_track_length, {rs('gap_fraction', 'stuck_fraction')},
 (n_tracked_locs/n_locs < 0.1)::INT + (n_locs/fr > 800)::INT + (median_track_length < 6)::INT
  + coalesce((stuck_fraction > 0.3)::INT, 0) + (gap_fraction > 0.5)::INT AS n_flags
FROM o JOIN t USING (recording_id) LEFT JOIN k USING (recording_id)""")
def qc_metrics(spark, d):
    t = V.tracks(spark, d)
    fits = D.fit_linear_d(D.track_msd(t, PX), DT)
    out = M.qc_flags(M.qc_metrics(t, fits, V.observations(spark, d)))
    return rounded(out.withColumn("n_flags", F.size("flags")).drop("flags"))


@query("summary_metrics", f"""WITH {DIFFUSION},
o AS (SELECT recording_id, count(*) AS n_locs, max(frame)+1 AS frames FROM observations GROUP BY ALL)
SELECT j.recording_id, any_value(n_locs) AS n_locs, any_value(frames) AS frames, count(*) AS n_tracks,
 count(*) FILTER (fit_status = 'below_resolution') AS n_below_resolution, {r('avg(n_observations)')} AS mean_observed_time_s,
 {r('avg(track_duration_s)')} AS mean_track_duration_s, {r('quantile_cont(pinned, 0.5)')} AS median_d,
 {r('quantile_cont(alpha, 0.5)', 4)} AS median_alpha,
 {r('count(*) FILTER (mobile) / nullif(count(*) FILTER (mobile OR immobile), 0)')} AS mobile_fraction,
 count(*) FILTER (motion = 'Immobile') AS n_immobile, count(*) FILTER (fit_status = 'fit') AS n_fit
FROM judged j JOIN o USING (recording_id) GROUP BY j.recording_id""")
def summary_metrics(spark, d):
    t = V.stored_tracks(spark, d)
    out = M.summary_metrics(t, cut_lineage(D.diffusion_table(t, PX, DT)), V.observations(spark, d), DT)
    out = out.select("recording_id", "n_locs", "frames", "n_tracks", "n_below_resolution", "mean_observed_time_s",
                     "mean_track_duration_s", "median_d", "median_alpha", "mobile_fraction",
                     F.coalesce(F.try_element_at("motion_counts", F.lit("Immobile")), F.lit(0)).alias("n_immobile"),
                     F.coalesce(F.try_element_at("fit_status_counts", F.lit("fit")), F.lit(0)).alias("n_fit"))
    return rounded(rounded(out, "median_alpha", digits=4), "mean_observed_time_s", "mean_track_duration_s",
                   "median_d", "mobile_fraction")


@query("replicate_table", f"""WITH {DIFFUSION},
curve AS (SELECT recording_id, lag, avg(dx*dx+dy*dy) AS m FROM pairs GROUP BY ALL),
auc AS (SELECT recording_id, sum(a) AS auc_msd FROM (SELECT recording_id, (lag - lag(lag) OVER w)*(m + lag(m) OVER w)/2 AS a FROM curve
        WINDOW w AS (PARTITION BY recording_id ORDER BY lag)) GROUP BY ALL),
inten AS (SELECT recording_id, quantile_cont(mm, 0.5) AS spot_intensity FROM (SELECT recording_id, particle, avg(mass) AS mm FROM tracks GROUP BY ALL) WHERE mm > 0 GROUP BY ALL)
SELECT j.recording_id, count(*) AS n_tracks, sum(n_observations)::BIGINT AS n_localisations, count(*) FILTER (D > 0) AS n_diffusion_eligible,
 {r('quantile_cont(pinned, 0.5)')} AS median_d, {r('any_value(auc_msd)')} AS auc_msd, {r('any_value(spot_intensity)')} AS spot_intensity,
 {r('quantile_cont(radius_of_gyration_um, 0.5)')} AS radius_of_gyration, {r('quantile_cont(net_displacement_um, 0.5)')} AS net_displacement,
 {r('quantile_cont(path_length_um, 0.5)')} AS path_length, {r('quantile_cont(mean_step_um, 0.5)')} AS step_distance,
 {r('quantile_cont(mean_step_um, 0.5)')} AS step_speed,
 {r('quantile_cont(mean_link_speed_um_s, 0.5)')} AS link_speed, {r('quantile_cont(directionality_ratio, 0.5)')} AS directionality,
 {r('quantile_cont(track_duration_s, 0.5)')} AS track_duration, {r('avg(track_duration_s)')} AS mean_track_duration_s
FROM judged j LEFT JOIN auc USING (recording_id) LEFT JOIN inten USING (recording_id) GROUP BY j.recording_id""")
def replicate_table(spark, d):
    t = V.stored_tracks(spark, d)
    out = M.replicate_table(t, cut_lineage(D.diffusion_table(t, PX, DT)), PX, DT)
    return rounded(out.select("recording_id", "n_tracks", "n_localisations", "n_diffusion_eligible", "median_d", "auc_msd",
                              "spot_intensity", "radius_of_gyration", "net_displacement", "path_length", "step_distance",
                              "step_speed", "link_speed", "directionality", "track_duration", "mean_track_duration_s"))


@query("step_scalars", f"""WITH {ANGLES}{STEPS[len(SQL_TRACKS):]},
ms AS (SELECT recording_id, particle, avg(sqrt(dx*dx+dy*dy)) AS s FROM steps GROUP BY ALL),
a AS (SELECT recording_id, quantile_cont(s, 0.5) AS median_step_speed FROM ms GROUP BY ALL),
b AS (SELECT recording_id, quantile_cont(sqrt(dx*dx+dy*dy), 0.5) AS median_jump_um, avg(dx*dx+dy*dy) AS msd_at_1s FROM steps GROUP BY ALL),
c AS (SELECT recording_id, avg(abs(cos(radians(turning_angle_deg)))) AS mean_abs_cos FROM angles GROUP BY ALL),
n AS (SELECT recording_id, count(*) AS n_locs, count(DISTINCT particle) AS track_count FROM tracks GROUP BY ALL)
SELECT recording_id, n_locs, track_count, {rs('median_step_speed', 'median_jump_um', 'msd_at_1s', 'mean_abs_cos')}
FROM n LEFT JOIN a USING (recording_id) LEFT JOIN b USING (recording_id) LEFT JOIN c USING (recording_id)""")
def step_scalars(spark, d):
    t = V.tracks(spark, d)
    return rounded(M.step_scalars(t, D.track_geometry(t, PX, DT), S.turning_angles(t), S.jump_distances(t, PX, 1),
                                  D.ensemble_msd(t, PX), DT))


@query("spot_intensity", f"""WITH {SQL_TRACKS} SELECT recording_id, {r('quantile_cont(m, 0.5)')} AS spot_intensity FROM (
SELECT recording_id, particle, avg(mass) AS m FROM tracks GROUP BY ALL) WHERE m > 0 GROUP BY recording_id""")
def spot_intensity(spark, d):
    return rounded(M.spot_intensity(V.tracks(spark, d)))


@query("group_curve", f"""WITH {PAIRS}, {SQL_ASSIGN},
curve AS (SELECT recording_id, lag AS lag_frame, avg(dx*dx+dy*dy) AS m FROM pairs GROUP BY ALL)
SELECT "group", lag_frame, {r('avg(m)')} AS mean, {r('CASE WHEN count(*) > 1 THEN stddev_samp(m)/sqrt(count(*)) END')} AS sem, count(*) AS n
FROM curve JOIN assignments USING (recording_id) GROUP BY "group", lag_frame""")
def group_curve(spark, d):
    return rounded(M.group_curve(D.ensemble_msd(V.tracks(spark, d), PX), V.assignments(spark, d), "lag_frame", "msd_um2"))


@query("log_d_histogram", f"""WITH {FIT},
b AS (SELECT recording_id, CAST(least(floor((log10(D) + 5)/0.2), 29) AS INTEGER) AS bin FROM fit WHERE D > 0 AND log10(D) BETWEEN -5 AND 1),
c AS (SELECT recording_id, bin, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT recording_id, sum(n) AS t FROM c GROUP BY ALL)
SELECT t.recording_id, CAST(g.bin AS INTEGER) AS bin, {r('-5 + (g.bin + 0.5)*0.2')} AS center, coalesce(n, 0) AS n, {r('coalesce(n, 0)/t')} AS fraction
FROM t CROSS JOIN (SELECT unnest(range(30)) AS bin) g LEFT JOIN c ON c.recording_id = t.recording_id AND c.bin = g.bin""")
def log_d_histogram(spark, d):
    fits = D.fit_linear_d(D.track_msd(V.tracks(spark, d), PX), DT)
    logd = fits.select("recording_id", F.when(F.col("D") > 0, F.log10("D")).alias("v"))
    return rounded(M.histogram(logd, ("recording_id",), "v", -5, 1, 30))


@query("angle_histogram", f"""WITH {ANGLES},
c AS (SELECT recording_id % 3 AS "group", CAST(least(floor(abs(turning_angle_deg)/5), 35) AS INTEGER) AS bin, count(*) AS n FROM angles GROUP BY ALL),
t AS (SELECT "group", sum(n) AS t FROM c GROUP BY ALL)
SELECT t."group", CAST(g.bin AS INTEGER) AS bin, {r('(g.bin + 0.5)*5')} AS center, coalesce(n, 0) AS n, {r('coalesce(n, 0)/t')} AS fraction
FROM t CROSS JOIN (SELECT unnest(range(36)) AS bin) g LEFT JOIN c ON c."group" = t."group" AND c.bin = g.bin""")
def angle_histogram(spark, d):
    a = S.turning_angles(V.tracks(spark, d)).select((F.col("recording_id") % 3).alias("group"), F.abs("turning_angle_deg").alias("v"))
    return rounded(M.histogram(a, ("group",), "v", 0, 180, 36))


@query("track_length_cdf", f"""WITH {SQL_TRACKS},
l AS (SELECT recording_id, particle, count(*) AS value FROM tracks GROUP BY ALL)
SELECT DISTINCT recording_id, value, {r('cume_dist() OVER w')} AS cdf, {r('1 - cume_dist() OVER w')} AS survival FROM l
WINDOW w AS (PARTITION BY recording_id ORDER BY value)""")
def track_length_cdf(spark, d):
    return rounded(M.empirical_cdf(K.track_lengths(V.tracks(spark, d)), ("recording_id",), "n_observations"))


@query("jump_cdf", f"""WITH {STEPS}, j AS (SELECT recording_id, round(sqrt(dx*dx+dy*dy), 9) AS v FROM steps)
SELECT DISTINCT recording_id, {r('v')} AS value, {r('cume_dist() OVER w')} AS cdf, {r('1 - cume_dist() OVER w')} AS survival FROM j
WINDOW w AS (PARTITION BY recording_id ORDER BY v)""")
def jump_cdf(spark, d):
    j = S.jump_distances(V.tracks(spark, d), PX, 1).withColumn("v", F.round("jump_um", 9))
    return rounded(M.empirical_cdf(j, ("recording_id",), "v"))


@query("gaussian_kde", f"""WITH {FIT},
v AS (SELECT recording_id % 3 AS "group", log10(D) AS v FROM fit WHERE D > 0),
s AS (SELECT "group", count(*) AS n, stddev_samp(v) AS sd FROM v GROUP BY ALL),
g AS (SELECT -5 + i * 6.0 / 49 AS x FROM (SELECT unnest(range(50)) AS i))
SELECT "group", {r('x', 4)} AS x, {r('sum(exp(-0.5*((x - v)/(sd*pow(n, -0.2)))**2))/(any_value(n)*any_value(sd)*pow(any_value(n), -0.2)*sqrt(2*pi()))', 3)} AS density
FROM v JOIN s USING ("group") CROSS JOIN g GROUP BY "group", x""")
def gaussian_kde(spark, d):
    fits = D.fit_linear_d(D.track_msd(V.tracks(spark, d), PX), DT).where("D > 0")
    v = fits.select((F.col("recording_id") % 3).alias("group"), F.log10("D").alias("v"))
    return rounded(rounded(M.gaussian_kde(v, ("group",), "v", -5, 1, 50), "x", digits=4), "density", digits=3)


@query("metric_contract", f"""WITH {PAIRS},
c AS (SELECT recording_id, lag, avg(dx*dx+dy*dy) AS m FROM pairs GROUP BY ALL)
SELECT recording_id, (CASE WHEN recording_id < 6 THEN 2 ELSE 3 END) AS metrics_schema_version, NULL::DOUBLE AS median_d,
  {r('max(m)')} AS peak, NULL::DOUBLE AS step_distance, false AS diffusion_uniform, false AS step_uniform, false AS any_legacy FROM c GROUP BY recording_id""")
def metric_contract(spark, d):
    peak = D.ensemble_msd(V.tracks(spark, d), PX).groupBy("recording_id").agg(F.max("msd_um2").alias("peak"))
    runs = peak.withColumns({"metrics_schema_version": F.when(F.col("recording_id") < 6, 2).otherwise(3),
                             "median_d": F.col("peak"), "step_distance": F.col("peak")})
    return rounded(M.metric_contract(runs))


@query("threshold_warnings", f"""WITH {SQL_ASSIGN},
v AS (SELECT "group", CASE WHEN "group" = 1 THEN 100.0 + recording_id % 2 ELSE 100.0 + "group" END AS threshold FROM assignments),
p AS (SELECT "group", count(DISTINCT threshold) AS n, min(threshold) AS lo, max(threshold) AS hi FROM v GROUP BY ALL)
SELECT 'within' AS scope, CAST("group" AS VARCHAR) AS "group", n, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM p WHERE n > 1
UNION ALL SELECT 'between', NULL, count(DISTINCT lo), min(lo)::DOUBLE, max(hi)::DOUBLE FROM p WHERE n = 1 HAVING count(DISTINCT lo) > 1""")
def threshold_warnings(spark, d):
    t = F.when(F.col("group") == 1, 100.0 + F.col("recording_id") % 2).otherwise(100.0 + F.col("group"))
    return M.threshold_warnings(V.assignments(spark, d).withColumns({"kind": F.lit("minmass"), "threshold": t.cast("double")}))


@query("recording_days", """WITH r AS (SELECT o_orderkey AS recording_id, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT recording_id, CAST(day AS VARCHAR) AS day, dense_rank() OVER (ORDER BY day) AS day_no FROM r""")
def recording_days(spark, d):
    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("recording_id"), F.col("o_orderdate").alias("acquired_at"))
    return M.recording_days(o).select("recording_id", F.col("day").cast("string").alias("day"), F.col("day_no").cast("long").alias("day_no"))


@query("unpaired_subjects", f"""WITH {SQL_ASSIGN},
grid AS (SELECT g."group", t.timepoint, g.cell FROM (SELECT DISTINCT "group", cell FROM assignments) g
         CROSS JOIN (SELECT DISTINCT timepoint FROM assignments) t)
SELECT "group", timepoint, cell FROM grid EXCEPT SELECT "group", timepoint, cell FROM assignments""")
def unpaired_subjects(spark, d):
    from lociflow.plans.compare import missing_cells
    return missing_cells(V.assignments(spark, d))


@query("common_lags", f"""WITH {PAIRS}, {SQL_ASSIGN},
s AS (SELECT DISTINCT p.lag AS lag_frame, a."group", a.recording_id FROM pairs p JOIN assignments a USING (recording_id)),
n AS (SELECT "group", count(*) AS n FROM assignments SEMI JOIN pairs USING (recording_id) GROUP BY ALL)
SELECT s."group", lag_frame FROM s JOIN n USING ("group") GROUP BY s."group", lag_frame, n HAVING count(*) = n""")
def common_lags(spark, d):
    from lociflow.plans.compare import common_levels
    return common_levels(D.ensemble_msd(V.tracks(spark, d), PX).where("msd_um2 IS NOT NULL"),
                         V.assignments(spark, d), "lag_frame")


@query("curve_drilldown", f"""WITH {PAIRS}, {SQL_ASSIGN},
curve AS (SELECT recording_id, lag, avg(dx*dx+dy*dy) AS m FROM pairs WHERE lag <= 6 GROUP BY ALL),
rows_ AS (SELECT a.timepoint AS tp, "group", lag, recording_id, m FROM curve JOIN assignments a USING (recording_id)),
nn AS (SELECT tp, count(DISTINCT recording_id) AS n FROM rows_ GROUP BY ALL),
ok AS (SELECT tp, lag FROM rows_ JOIN nn USING (tp) GROUP BY tp, lag, n HAVING count(DISTINCT recording_id) = n),
complete AS (SELECT CAST(tp AS VARCHAR) AS metric, "group", lag AS timepoint, recording_id AS cell, m AS value FROM rows_ SEMI JOIN ok USING (tp, lag))
{MIXED[len(PAIRED):]}
SELECT metric, 'group' AS effect, {r('(ss_g/dg)/(ss_s/ds)')} AS F, dg::DOUBLE AS df1, ds::DOUBLE AS df2 FROM e
UNION ALL SELECT metric, 'timepoint', {r('(ss_t/dt)/(ss_e/(ds*dt))')}, dt::DOUBLE, (ds*dt)::DOUBLE FROM e
UNION ALL SELECT metric, 'interaction', {r('(ss_i/(dg*dt))/(ss_e/(ds*dt))')}, (dg*dt)::DOUBLE, (ds*dt)::DOUBLE FROM e""")
def curve_drilldown(spark, d):
    from lociflow.plans.compare import curve_drilldown as run
    c = D.ensemble_msd(V.tracks(spark, d), PX, 6)
    return rounded(run(c, V.assignments(spark, d), "lag_frame", "msd_um2").select("metric", "effect", "F", "df1", "df2"))


@query("track_attributes", f"""WITH {FIT} SELECT f.recording_id, f.particle, fit_status, {r('avg(y/100)*0.01*1000')} AS loc_precision_nm FROM fit f
JOIN tracks t USING (recording_id, particle) GROUP BY ALL""")
def track_attributes(spark, d):
    t = V.tracks(spark, d).withColumn("ep", F.col("y") / 100)
    fits = D.fit_linear_d(D.track_msd(t, PX), DT).select("recording_id", "particle", "fit_status")
    return rounded(M.track_attributes(fits, D.track_precision(t, PX)))


@query("pool_runs", f"""WITH {SQL_TRACKS} SELECT recording_id, particle, frame, CASE WHEN recording_id % 2 = 0 THEN mass END AS mass FROM tracks""")
def pool_runs(spark, d):
    t = V.tracks(spark, d).select("recording_id", "particle", "frame", "mass")
    return M.pool_runs(t.where("recording_id % 2 = 0"), t.where("recording_id % 2 = 1").drop("mass"))


@query("seeded_sample", f"WITH {SQL_LOCS} SELECT loc_id FROM locs ORDER BY md5(loc_id || '|42'), loc_id LIMIT 1000")
def seeded_sample(spark, d):
    return M.seeded_sample(V.localisations(spark, d), 1000, "loc_id", 42).select("loc_id")


@query("semi_and_anti", f"""WITH {FIT} SELECT recording_id, particle, frame, 'kept' AS side FROM tracks SEMI JOIN (SELECT * FROM fit WHERE D > 0.01) k USING (recording_id, particle)
UNION ALL SELECT recording_id, particle, frame, 'dropped' FROM tracks ANTI JOIN (SELECT * FROM fit WHERE D > 0.01) k USING (recording_id, particle)""")
def semi_and_anti(spark, d):
    t = V.tracks(spark, d).select("recording_id", "particle", "frame")
    keep = D.fit_linear_d(D.track_msd(V.tracks(spark, d), PX), DT).where("D > 0.01")
    return K.keep_tracks(t, keep).withColumn("side", F.lit("kept")).unionByName(K.drop_tracks(t, keep).withColumn("side", F.lit("dropped")))
