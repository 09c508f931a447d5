"""Tail probabilities of the test distributions as column expressions.

Continued fractions and series are folds of a fixed number of terms, quadratures sums over fixed nodes, so nothing leaves
the JVM. Every function takes columns of numbers and gives null where one of them is null or not a number.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

TERMS = 300
TINY = 1e-300
# Lanczos' series for the gamma function (g = 7), and West's rational approximation of the normal tail.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
           -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
WEST_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
WEST_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
              440.413735824752)


def let(fn: Callable[..., Column], **values: Column) -> Column:
    """``fn`` of values that are computed once, null if one is null or not a number."""
    row = F.struct(*(v.cast("double").alias(n) for n, v in values.items()))
    known = F.lit(True)
    for v in values.values():
        known = known & v.isNotNull() & ~F.isnan(v.cast("double"))
    return F.when(known, F.element_at(F.transform(F.array(row), lambda r: fn(*(r[n] for n in values))), 1))


def log_gamma(x: Column) -> Column:
    """For x of 0.5 and more, as half degrees of freedom are."""
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        total = total + c / (x + i)
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(t) - t + F.log(total)


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _once(x: Column, fn) -> Column:
    return F.element_at(F.transform(F.array(x), fn), 1)


def beta_inc(a: Column, b: Column, x: Column, terms: int = TERMS) -> Column:
    """Regularised incomplete beta function by its continued fraction, from the side on which that converges."""
    def whole(a, b, x):
        def side(s):
            a, b, x = s["a"], s["b"], s["x"]

            def step(acc, m):
                m = m.cast("double")
                even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
                odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
                half = F.struct((1 / _away(1 + even * acc["d"])).alias("d"), _away(1 + even / acc["c"]).alias("c"), acc["h"].alias("h"))

                def second(p):
                    d, c = 1 / _away(1 + odd * p["d"]), _away(1 + odd / p["c"])
                    return F.struct(d.alias("d"), c.alias("c"), (p["h"] * p["d"] * p["c"] * d * c).alias("h"))
                return _once(half, second)
            first = 1 / _away(1 - (a + b) * x / (a + 1))
            start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
            front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
            value = front * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["h"])
            return F.when(s["turned"], 1 - value).otherwise(value)
        turned = x > (a + 1) / (a + b + 2)
        chosen = F.struct(F.when(turned, b).otherwise(a).alias("a"), F.when(turned, a).otherwise(b).alias("b"),
                          F.when(turned, 1 - x).otherwise(x).alias("x"), turned.alias("turned"))
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.least(F.greatest(_once(chosen, side), F.lit(0.0)), F.lit(1.0)))
    return let(whole, a=a, b=b, x=x)


def gamma_sf(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    def whole(a, x):
        front = a * F.log(x) - x - log_gamma(a)

        def term(acc, n):
            t = acc["t"] * x / (a + n)
            return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))
        series = F.aggregate(F.sequence(F.lit(1), F.lit(2 * TERMS)), F.struct((1 / a).alias("t"), (1 / a).alias("s")), term, lambda acc: acc["s"])

        def step(acc, i):
            i = i.cast("double")
            an, b = -i * (i - a), x + 1 - a + 2 * i
            pair = F.struct((1 / _away(an * acc["d"] + b)).alias("d"), _away(b + an / acc["c"]).alias("c"))
            return _once(pair, lambda p: F.struct(p["d"].alias("d"), p["c"].alias("c"), (acc["h"] * p["d"] * p["c"]).alias("h")))
        first = 1 / (x + 1 - a)
        start = F.struct(first.alias("d"), F.lit(1 / TINY).alias("c"), first.alias("h"))
        fraction = F.aggregate(F.sequence(F.lit(1), F.lit(2 * TERMS)), start, step, lambda acc: acc["h"])
        value = F.when(x < a + 1, 1 - F.exp(front) * series).otherwise(F.exp(front) * fraction)
        return F.when(x <= 0, 1.0).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    return let(whole, a=a, x=x)


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _normal_sf(z: Column) -> Column:
    def tail(x):
        far = x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))
        near = _poly(x, WEST_TOP) / _poly(x, WEST_BELOW)
        return F.when(x > 37, 0.0).otherwise(F.exp(-x * x / 2) * F.when(x < 7.07106781186547, near).otherwise(1 / (far * 2.506628274631)))
    upper = _once(F.abs(z), tail)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def norm_sf(z: Column) -> Column:
    return let(_normal_sf, z=z)


def t_two_sided(t: Column, df: Column, terms: int = TERMS) -> Column:
    return beta_inc(df / 2.0, F.lit(0.5), df / (df + t * t), terms)


def t_sf(t: Column, df: Column) -> Column:
    half = 0.5 * t_two_sided(t, df)
    return F.when(t >= 0, half).otherwise(1 - half)


def f_sf(f: Column, df1: Column, df2: Column) -> Column:
    return let(lambda f, a, b: F.when(f <= 0, F.lit(1.0)).otherwise(beta_inc(b / 2.0, a / 2.0, b / (b + a * f))), f=f, a=df1, b=df2)


def chi2_sf(x: Column, df: Column) -> Column:
    return gamma_sf(df / 2.0, x / 2.0)


def _nodes(n: int) -> Column:
    at, weight = np.polynomial.legendre.leggauss(n)
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(at, weight)))


def _over_scale(df: Column, inner: Callable[[Column], Column], n: int) -> Column:
    """The mean of ``inner(s)`` over the pooled standard deviation s, whose square is chi-squared over df."""
    sd = 1 / F.sqrt(2 * df)
    low, high = F.greatest(1 - 9 * sd, F.lit(1e-6)), 1 + 12 * sd
    constant = math.log(2) + (df / 2) * F.log(df / 2) - log_gamma(df / 2)

    def add(total, node):
        s = 0.5 * (high - low) * node["x"] + 0.5 * (high + low)
        return total + _once(s, lambda s: node["w"] * F.exp(constant + (df - 1) * F.log(s) - df * s * s / 2) * inner(s))
    return F.aggregate(_nodes(n), F.lit(0.0), add) * 0.5 * (high - low)


def range_sf(q: Column, k: Column, df: Column) -> Column:
    """Upper tail of the studentised range of k means with df degrees of freedom."""
    at, weight = np.polynomial.legendre.leggauss(80)
    known = F.array(*(F.struct(F.lit(float(8 * x)).alias("z"), F.lit(float(8 * w * math.exp(-32 * x * x) / math.sqrt(2 * math.pi))).alias("w"),
                               F.lit(0.5 * math.erfc(-8 * x / math.sqrt(2))).alias("below")) for x, w in zip(at.tolist(), weight.tolist())))

    def whole(q, k, df):
        def within(s):
            def add(total, node):
                reach = F.greatest(node["below"] - _normal_sf(q * s - node["z"]), F.lit(0.0))
                return total + node["w"] * F.pow(reach, k - 1)
            return k * F.aggregate(known, F.lit(0.0), add)
        return F.when(q <= 0, 1.0).otherwise(F.least(F.greatest(1 - _over_scale(df, within, 80), F.lit(0.0)), F.lit(1.0)))
    return let(whole, q=q, k=k, df=df)


def critical_values(n_max: int, alpha: float) -> np.ndarray:
    """Two-sided critical t of two groups of n = 2 … ``n_max``, bisected on the tail as an integral of powers of a cosine."""
    df = 2.0 * np.arange(2, n_max + 1) - 2
    at, weight = np.polynomial.legendre.leggauss(80)
    half = np.array([0.5 * math.log(math.pi) - math.log(2) + math.lgamma(d / 2) - math.lgamma((d + 1) / 2) for d in df])
    low, high = np.zeros(len(df)), np.full(len(df), 20.0)
    for _ in range(60):
        mid = (low + high) / 2
        begin = np.arctan(mid / np.sqrt(df))
        size = np.minimum(np.pi / 2 - begin, 12 / np.sqrt(df))
        theta = begin[:, None] + size[:, None] * (at + 1) / 2
        tail = (np.cos(theta) ** (df[:, None] - 1)) @ weight * size / 2 / np.exp(half)
        low, high = np.where(tail > alpha, mid, low), np.where(tail > alpha, high, mid)
    return (low + high) / 2


def sample_size(d: Column, power: float, alpha: float = 0.05, n_max: int = 500) -> Column:
    """Smallest n in each of two groups whose two-sided t test reaches ``power`` at effect ``d``; n_max + 1 when none does.

    The power is the non-central t by quadrature, and n is bisected on it; critical values depend on n alone.
    """
    critical = F.array(*map(F.lit, critical_values(n_max, alpha).tolist()))

    def whole(d):
        def reached(n):
            shift, crit = d * F.sqrt(n / 2), F.get(critical, n.cast("int") - 2)
            at = F.struct(shift.alias("shift"), crit.alias("crit"), (2 * n - 2).alias("df"))
            tail = _once(at, lambda p: _over_scale(p["df"], lambda s: 1 - _normal_sf(p["shift"] - p["crit"] * s) + _normal_sf(p["shift"] + p["crit"] * s), 80))
            return F.when(n >= 2, tail).otherwise(0.0) >= power

        def halve(acc, _):
            mid = F.floor((acc["low"] + acc["high"]) / 2).cast("double")
            open_ = acc["high"] - acc["low"] > 1
            return F.when(open_, _once(mid, lambda m: _once(F.struct(m.alias("m"), reached(m).alias("r")), lambda p: F.struct(
                F.when(p["r"], acc["low"]).otherwise(p["m"]).alias("low"), F.when(p["r"], p["m"]).otherwise(acc["high"]).alias("high"))))).otherwise(acc)
        start = F.struct(F.lit(1.0).alias("low"), F.lit(float(n_max)).alias("high"))
        steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(n_max)) + 1))
        found = F.aggregate(steps, start, halve, lambda acc: acc["high"])
        return F.when((d >= 1e-6) & reached(F.lit(float(n_max))), found).otherwise(n_max + 1.0)
    return let(whole, d=F.abs(d)).cast("int")


def mann_whitney(u: Column, n1: Column, n2: Column, ties: Column, exact_upto: int = 8) -> Column:
    """Two-sided p: exact if the smaller sample has up to ``exact_upto`` values and none are tied, else normal with tie and
    continuity correction. Exact counts the ways to reach each U by taking one rank after another into the smaller sample."""
    def whole(u, n1, n2, ties):
        small, large, top = F.least(n1, n2).cast("int"), F.greatest(n1, n2).cast("int"), F.greatest(u, n1 * n2 - u)

        def exact(s):
            n, m = s["n"], s["m"]
            width = n * m + 1
            cells = F.sequence(F.lit(0), (n + 1) * width - 1)
            start = F.transform(cells, lambda c: F.when(c == 0, 1.0).otherwise(0.0))

            def take(ways, rank):
                def cell(c):
                    i, at = F.floor(c / width).cast("int"), c % width
                    shift = rank - i
                    before = F.when((i > 0) & (shift >= 0) & (shift <= m) & (at >= shift), F.get(ways, c - width - shift)).otherwise(0.0)
                    return F.get(ways, c) + before
                return F.transform(cells, cell)
            ways = F.aggregate(F.sequence(F.lit(1), n + m), start, take)
            last = F.slice(ways, n * width + 1, width)

            def total(x):
                return F.aggregate(x, F.lit(0.0), lambda a, w: a + w)
            return _once(last, lambda w: F.least(2 * total(F.slice(w, F.round(top).cast("int") + 1, width)) / total(w), F.lit(1.0)))
        n = n1 + n2
        var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
        normal = F.when(var > 0, F.least(2 * _normal_sf((top - n1 * n2 / 2.0 - 0.5) / F.sqrt(var)), F.lit(1.0)))
        chosen = F.struct(small.alias("n"), large.alias("m"))
        return F.when((ties == 0) & (small <= exact_upto), _once(chosen, exact)).otherwise(normal)
    return let(whole, u=u, n1=n1, n2=n2, ties=ties)


def wilcoxon(w_plus: Column, n: Column, ties: Column, zeros: Column, exact_upto: int = 50) -> Column:
    """Two-sided signed-rank p: exact up to ``exact_upto`` differences without ties or zeros, else normal."""
    def whole(w, n, ties, zeros):
        total = n * (n + 1) / 2

        def exact(size):
            sums = F.sequence(F.lit(0), (size * (size + 1) / 2).cast("int"))
            start = F.transform(sums, lambda s: F.when(s == 0, 1.0).otherwise(0.0))
            ways = F.aggregate(F.sequence(F.lit(1), size), start, lambda acc, rank: F.transform(
                sums, lambda s: F.get(acc, s) + F.when(s >= rank, F.get(acc, s - rank)).otherwise(0.0)))
            below = F.slice(ways, F.lit(1), F.round(F.least(w, total - w)).cast("int") + 1)
            return F.least(2 * F.aggregate(below, F.lit(0.0), lambda a, x: a + x) / F.pow(F.lit(2.0), size), F.lit(1.0))
        var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
        normal = F.when(var > 0, 2 * _normal_sf(F.abs(w - total / 2) / F.sqrt(var)))
        return (F.when(n < 1, F.lit(None).cast("double"))
                .when((n <= exact_upto) & (ties == 0) & (zeros == 0), _once(n.cast("int"), exact)).otherwise(normal))
    return let(whole, w=w_plus, n=n, ties=ties, zeros=zeros)
