"""Normality by Royston's approximation. The tails of the other test distributions are column expressions (``tails``)."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def shapiro_p(values: np.ndarray) -> float:
    """Shapiro–Wilk p by Royston's 1995 approximation, 3 ≤ n ≤ 5000."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or n > 5000 or x[-1] - x[0] < 1e-19:
        return float("nan")
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        ssq, u = float(m @ m), 1.0 / math.sqrt(n)
        # fixed polynomial coefficients of the published approximation
        last = m[-1] / math.sqrt(ssq) + np.polyval(
            [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)
        a = np.empty(n)
        if n > 5:
            before = m[-2] / math.sqrt(ssq) + np.polyval(
                [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
            phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last ** 2 - 2 * before ** 2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[1], a[-2] = -before, before
        else:
            phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last ** 2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0], a[-1] = -last, last
    w = float((a @ x) ** 2 / np.sum((x - x.mean()) ** 2))
    w = min(w, 1.0)
    if n == 3:
        return max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
    y = math.log(max(1 - w, 1e-19))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if y >= g:
            return 1e-99
        y = -math.log(g - y)
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return norm_sf((y - mu) / sd)


def norm_ppf(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(120):
        mid = 0.5 * (lo + hi)
        if 1.0 - norm_sf(mid) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def shapiro_col(values: Column) -> Column:
    @F.pandas_udf("double")
    def apply(arrays: pd.Series) -> pd.Series:
        ps = [shapiro_p(v) for v in arrays]
        return pd.Series([None if p != p else p for p in ps], dtype="object")
    return apply(values)
