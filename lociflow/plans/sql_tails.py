"""The tails of the test distributions in DuckDB's SQL, by other means than ``functions.tails``: Simpson sums over smooth
integrands with the engine's own gamma function, and counts of rank sums as folds over lists. Arguments are column names."""
from __future__ import annotations

from lociflow.functions.tails import WEST_BELOW, WEST_TOP


def simpson(low: str, high: str, body: str, n: int, i: str = "i") -> str:
    """Integral of ``body`` over ``{v}`` from low to high."""
    v = f"({low} + {i} * (({high}) - ({low})) / {n}.0)"
    weight = f"CASE WHEN {i} = 0 OR {i} = {n} THEN 1 WHEN {i} % 2 = 1 THEN 4 ELSE 2 END"
    return f"((({high}) - ({low})) / {3 * n}.0 * list_sum(list_transform(range({n + 1}), lambda {i}: ({weight}) * ({body.replace('{v}', v)}))))"


def beta_sql(a: str, b: str, x: str, n: int = 1000) -> str:
    """Incomplete beta over the angle whose squared sine is the variable."""
    inside = simpson("0", f"asin(sqrt(least({x}, 1)))", f"pow(sin({{v}}), 2*({a})-1) * pow(cos({{v}}), 2*({b})-1)", n)
    return f"least(2 * exp(lgamma(({a})+({b})) - lgamma({a}) - lgamma({b})) * {inside}, 1)"


def t_sql(t: str, df: str) -> str:
    return f"CASE WHEN {t} IS NOT NULL AND {df} IS NOT NULL THEN {beta_sql(f'{df}/2.0', '0.5', f'{df}/({df} + {t}*{t})')} END"


def f_sql(f: str, df1: str, df2: str) -> str:
    return f"CASE WHEN {f} <= 0 THEN 1.0 WHEN {f} IS NOT NULL AND {df2} IS NOT NULL THEN {beta_sql(f'{df2}/2.0', f'{df1}/2.0', f'{df2}/({df2} + {df1}*{f})')} END"


def chi2_sql(x: str, df: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} IS NOT NULL THEN greatest(1 - 2 * exp(-lgamma(({df})/2.0)) * {simpson('0', f'sqrt({x}/2.0)', f'pow({{v}}, ({df})-1) * exp(-{{v}}*{{v}})', 1000)}, 0) END"


def normal_sql(z: str) -> str:
    """Upper tail by the rational approximation."""
    def poly(cs):
        out = str(cs[0])
        for c in cs[1:]:
            out = f"({out} * abs({z}) + {c})"
        return out
    far = f"(abs({z}) + 1/(abs({z}) + 2/(abs({z}) + 3/(abs({z}) + 4/(abs({z}) + 0.65)))))"
    tail = f"(CASE WHEN abs({z}) > 37 THEN 0 WHEN abs({z}) < 7.07106781186547 THEN exp(-({z})*({z})/2) * {poly(WEST_TOP)} / {poly(WEST_BELOW)} ELSE exp(-({z})*({z})/2) / {far} / 2.506628274631 END)"
    return f"(CASE WHEN ({z}) >= 0 THEN {tail} ELSE 1 - {tail} END)"


def range_sql(q: str, k: str, df: str) -> str:
    inner = f"exp(-{{v}}*{{v}}/2) / 2.5066282746310002 * pow(greatest({normal_sql('-zz')} - {normal_sql('qs - zz')}, 0), {k} - 1)"
    at = simpson("-8", "8", inner, 160, "j").replace("qs", "({q} * {v})")
    at = at.replace("zz", "(-8 + j * ((8) - (-8)) / 160.0)").replace("{q}", q)
    low, high = f"greatest(1 - 9/sqrt(2.0*{df}), 0.000001)", f"(1 + 12/sqrt(2.0*{df}))"
    density = f"exp(ln(2) + {df}/2.0*ln({df}/2.0) - lgamma({df}/2.0) + ({df}-1)*ln({{v}}) - {df}*{{v}}*{{v}}/2)"
    return f"CASE WHEN {q} <= 0 THEN 1.0 WHEN {q} IS NOT NULL THEN greatest(1 - {simpson(low, high, f'{density} * {k} * {at}', 120)}, 0) END"


def mann_whitney_sql(u: str, n1: str, n2: str, ties: str) -> str:
    """Exact up to 8 values on the smaller side without ties, else normal."""
    n, m = f"least({n1}, {n2})", f"greatest({n1}, {n2})"
    w = f"({n1}*{n2} + 1)"
    start = f"list_transform(range((({n}) + 1) * {w}), lambda c: CASE WHEN c = 0 THEN 1::bigint ELSE 0::bigint END)"
    back = "x[1] - c // {w}".replace("{w}", w)
    cell = f"acc[c + 1] + CASE WHEN c // {w} > 0 AND {back} BETWEEN 0 AND ({m}) AND c % {w} >= {back} THEN acc[c - {w} - ({back}) + 1] ELSE 0 END"
    ways = f"list_reduce(list_prepend({start}, list_transform(range(1, {n1} + {n2} + 1), lambda r: [r])), lambda acc, x: list_transform(range((({n}) + 1) * {w}), lambda c: {cell}))"
    last = f"list_slice({ways}, ({n}) * {w} + 1, (({n}) + 1) * {w})"
    top = f"greatest({u}, {n1}*{n2} - {u})"
    exact = f"least(2 * list_sum(list_slice({last}, round({top})::bigint + 1, {w})) / list_sum({last}), 1)"
    var = f"({n1}*{n2}/12.0*(({n1}+{n2}+1) - {ties}/(({n1}+{n2})*({n1}+{n2}-1.0))))"
    return f"CASE WHEN {ties} = 0 AND {n} <= 8 THEN {exact} WHEN {var} > 0 THEN least(2 * {normal_sql(f'({top} - {n1}*{n2}/2.0 - 0.5)/sqrt({var})')}, 1) END"


def wilcoxon_sql(w: str, n: str, ties: str, zeros: str) -> str:
    total = f"({n}*({n}+1)//2)"
    start = f"list_transform(range({total} + 1), lambda s: CASE WHEN s = 0 THEN 1::bigint ELSE 0::bigint END)"
    ways = (f"list_reduce(list_prepend({start}, list_transform(range(1, {n} + 1), lambda r: [r])), lambda acc, x: list_transform(range({total} + 1), "
            f"lambda s: acc[s + 1] + CASE WHEN s >= x[1] THEN acc[s - x[1] + 1] ELSE 0 END))")
    exact = f"least(2 * list_sum(list_slice({ways}, 1, round(least({w}, {total} - {w}))::bigint + 1)) / pow(2.0, {n}), 1)"
    var = f"({n}*({n}+1)*(2*{n}+1)/24.0 - {ties}/48.0)"
    return (f"CASE WHEN {n} IS NULL OR {n} < 1 THEN NULL WHEN {n} <= 50 AND {ties} = 0 AND {zeros} = 0 THEN {exact} "
            f"WHEN {var} > 0 THEN 2 * {normal_sql(f'abs({w} - {total}/2.0)/sqrt({var})')} END")
