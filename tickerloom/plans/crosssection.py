"""Statistics over all tickers of one date, without gathering a date in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_date_stats(df: DataFrame, aggs: Mapping[str, Column], keys: Sequence[str] = ("date",)) -> DataFrame:
    """Attach per-date aggregates.

    The aggregate combines map-side, and its result has one row per calendar date, a bound
    that does not grow with the table: it is broadcast, so the panel is not shuffled again.
    """
    stats = df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()])
    return df.join(F.broadcast(stats), list(keys), "left")


def join_group_stats(df: DataFrame, aggs: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """The same for keys with no calendar bound: a shuffled join that AQE may rewrite."""
    stats = df.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()])
    return df.join(stats, list(keys), "left")


def with_cross_section_z(df: DataFrame, cols: Mapping[str, str], key: str = "date") -> DataFrame:
    """Add ``out = (x - mean of the date) / std of the date`` for each ``out: x``."""
    aggs = {}
    for out, x in cols.items():
        aggs[f"_m_{out}"] = F.avg(x)
        aggs[f"_s_{out}"] = F.stddev_samp(x)
    joined = join_date_stats(df, aggs, [key])
    z = {
        out: (F.col(x) - F.col(f"_m_{out}")) / F.nullif(F.col(f"_s_{out}"), F.lit(0.0)) for out, x in cols.items()
    }
    return joined.withColumns(z).drop(*aggs)
