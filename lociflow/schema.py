"""Column contracts and fixed values shared by the operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, types as T

TRACK_KEY = ["recording_id", "particle"]

LOCALISATION = T.StructType([
    T.StructField("recording_id", T.StringType()),
    T.StructField("loc_id", T.LongType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("mass", T.DoubleType()),
])

# Fixed values that decide results.
METRICS_SCHEMA_VERSION = 3
ALPHA_THRESHOLDS = (0.5, 0.9, 1.1)
ALPHA_BOUNDS = (0.0, 2.0)
ALPHA_LIMIT_TOL = 0.01
D_FLOOR = 1e-5
MOBILE_D_THRESHOLD = 0.02
MOTION_CLASSES = ("Immobile", "Confined", "Brownian", "Directed")

GAP_POLICIES = ("all_pairs", "contiguous")


class ContractError(ValueError):
    """An input table breaks the contract of an operator."""


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"missing required columns: {missing}")


def require_positive(name: str, value: float) -> float:
    value = float(value)
    if not (value > 0 and value != float("inf")):
        raise ContractError(f"{name} must be a positive, finite number (got {value!r})")
    return value


def require_gap_policy(policy: str) -> str:
    if policy not in GAP_POLICIES:
        raise ContractError(f"gap policy must be one of {GAP_POLICIES} (got {policy!r})")
    return policy
