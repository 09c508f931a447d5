"""Registry of the named queries and of the SQL that checks each of them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Added before rounding so that exact ties (…5) round alike in both engines.
NUDGE = 3.7e-10


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round the named columns, or every double column."""
    names = names or tuple(n for n, t in df.dtypes if t == "double")
    return df.withColumns({n: F.round(F.col(n) + NUDGE, digits) + 0.0 for n in names})


def r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr}) + {NUDGE}, {digits}) + 0.0)"


def rs(*names: str, digits: int = 6, alias: str = "") -> str:
    """``name`` rounded under its own name, comma separated."""
    pre = f"{alias}." if alias else ""
    return ", ".join(f"{r(pre + n, digits)} AS {n}" for n in names)
