"""Vendor rows brought to the bronze schemas. The network clients are not part of this library."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings vendors use for the date column, in order of preference.
DATE_COLUMNS = ("Date", "Dates", "timestamp", "Datetime", "date")
BAR_COLUMNS = ("ticker", "date", "open", "high", "low", "close", "volume", "vwap", "source")


def normalise_bars(df: DataFrame, source: str) -> DataFrame:
    """Capitalised OHLCV with any of the known date columns → bronze bars."""
    found = [c for c in DATE_COLUMNS if c in df.columns]
    if not found:
        raise ValueError(f"no date column among {DATE_COLUMNS}")
    names = {c.lower(): c for c in df.columns}
    num = {c: F.col(names[c]).cast("double") for c in ("open", "high", "low", "close")}
    vwap = F.col(names["vwap"]).cast("double") if "vwap" in names else F.lit(None).cast("double")
    return df.select(
        F.col(names["ticker"]).alias("ticker"), F.to_date(F.col(found[0])).alias("date"),
        *[c.alias(n) for n, c in num.items()],
        F.col(names["volume"]).cast("long").alias("volume"), vwap.alias("vwap"), F.lit(source).alias("source"),
    )


def normalise_epoch_bars(df: DataFrame, source: str) -> DataFrame:
    """Single-letter bars with epoch-millisecond timestamps (t, o, h, l, c, v, vw)."""
    return df.filter(F.col("t").isNotNull()).select(
        "ticker", F.to_date(F.timestamp_millis("t")).alias("date"),
        F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"),
        F.coalesce(F.col("v").cast("long"), F.lit(0).cast("long")).alias("volume"),
        F.col("vw").cast("double").alias("vwap"), F.lit(source).alias("source"),
    )


def normalise_dividends(df: DataFrame, start: date, end: date, start_exclusive: bool = False) -> DataFrame:
    ok = F.col("ex_date").isNotNull() & F.col("amount").isNotNull() & (F.col("ex_date") <= F.lit(end))
    after = F.col("ex_date") > F.lit(start) if start_exclusive else F.col("ex_date") >= F.lit(start)
    return df.filter(ok & after).select("ticker", F.to_date("ex_date").alias("ex_date"),
                                        F.col("amount").cast("double").alias("amount"))


def normalise_splits(df: DataFrame) -> DataFrame:
    """factor = split_to / split_from; incomplete rows are dropped."""
    return (
        df.withColumn("factor", F.try_divide(F.col("split_to").cast("double"), F.col("split_from").cast("double")))
        .filter(F.col("date").isNotNull() & F.col("factor").isNotNull())
        .select("ticker", F.to_date("date").alias("date"), F.lit("split").alias("action_type"), "factor")
    )


def validate_bars(df: DataFrame, source: str, today: Column | None = None) -> DataFrame:
    """Keep bars with a positive close that are not in the future; stamp the source."""
    today = F.current_date() if today is None else today
    out = df.filter((F.col("close") > 0) & (F.col("date") <= today)).withColumn("source", F.lit(source))
    return out if "vwap" in df.columns else out.withColumn("vwap", F.lit(None).cast("double"))
