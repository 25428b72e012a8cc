"""Registered queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded double for output: sums differ in their last bits between engines.

    The boundary lies just beside the half, so a value that is a tie but for its last bit
    falls clearly on one side.
    """
    scale = float(10**digits)
    return F.floor((F.col(x) if isinstance(x, str) else x) * scale + 0.501) / F.lit(scale)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})
