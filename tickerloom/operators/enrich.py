"""Gold layer: sector, rolling volume, size bucket, universe flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.rolling import rolling_mean, series

# The ticker lists behind the size buckets.
MEGA_CAPS = ("AAPL", "MSFT", "GOOGL", "GOOG", "AMZN", "META", "NVDA", "BRK.B", "JPM")
LARGE_CAPS = ("TSLA", "UNH", "V", "MA", "JNJ", "XOM", "CVX", "PG", "HD", "DIS", "NFLX")
ETFS = ("SPY", "QQQ", "IWM", "DIA")
ETF_PREFIX = "X"

# Sector of each known ticker.
SECTOR_OF = {
    "AAPL": "Technology", "MSFT": "Technology", "GOOGL": "Technology",
    "GOOG": "Technology", "META": "Technology", "NVDA": "Technology",
    "AMD": "Technology", "INTC": "Technology", "CRM": "Technology",
    "ADBE": "Technology", "NFLX": "Communication Services",
    "JPM": "Financials", "BAC": "Financials", "WFC": "Financials",
    "GS": "Financials", "MS": "Financials", "C": "Financials",
    "BRK-B": "Financials", "V": "Financials", "MA": "Financials",
    "JNJ": "Health Care", "UNH": "Health Care", "PFE": "Health Care",
    "ABBV": "Health Care", "MRK": "Health Care", "LLY": "Health Care",
    "XOM": "Energy", "CVX": "Energy", "COP": "Energy", "SLB": "Energy",
    "PG": "Consumer Defensive", "KO": "Consumer Defensive",
    "PEP": "Consumer Defensive", "WMT": "Consumer Defensive",
    "COST": "Consumer Defensive", "NKE": "Consumer Cyclical",
    "CAT": "Industrials", "HON": "Industrials", "UNP": "Industrials",
    "BA": "Industrials", "GE": "Industrials",
    "DIS": "Communication Services", "TSLA": "Consumer Cyclical",
    "AMZN": "Consumer Cyclical",
    "SPY": "Broad Market", "QQQ": "Broad Market", "IWM": "Broad Market",
    "DIA": "Broad Market",
    "XLF": "Financials", "XLE": "Energy", "XLK": "Technology",
    "XLV": "Health Care", "XLI": "Industrials", "XLP": "Consumer Defensive",
    "XLU": "Utilities", "XLB": "Materials", "XLRE": "Real Estate",
    "XLY": "Consumer Cyclical",
}


def static_sectors(df: DataFrame) -> DataFrame:
    """The fixed sector list as a table."""
    return df.sparkSession.createDataFrame(list(SECTOR_OF.items()), "ticker string, sector string")


def enrich_with_sector(df: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """Left join on ticker; unlisted tickers become 'Unknown'.

    The fixed list is broadcast. A given table is joined by ticker, the key the panel is already clustered
    on, unless its size at run time shows that it is small.
    """
    table = static_sectors(df) if sectors is None else sectors
    if sectors is None:
        table = F.broadcast(table)
    return df.join(table, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def enrich_with_volume_features(df: DataFrame) -> DataFrame:
    w = series()
    long_run = F.col("avg_volume_60d")
    return df.withColumns(
        {"avg_volume_20d": rolling_mean("volume", 20, w), "avg_volume_60d": rolling_mean("volume", 60, w)}
    ).withColumn("volume_ratio", F.when(long_run > 0, F.col("volume") / long_run).otherwise(F.lit(1.0)))


def enrich_with_market_cap_bucket(
    df: DataFrame,
    mega: Sequence[str] = MEGA_CAPS,
    large: Sequence[str] = LARGE_CAPS,
    etfs: Sequence[str] = ETFS,
    etf_prefix: str = ETF_PREFIX,
) -> DataFrame:
    t = F.col("ticker")
    return df.withColumn(
        "market_cap_bucket",
        F.when(t.isin(*mega), "mega")
        .when(t.isin(*large), "large")
        .when(t.isin(*etfs) | t.startswith(etf_prefix), "etf")
        .otherwise("mid"),
    )


def enrich_with_universe_flag(df: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """TRUE everywhere, or membership in a (ticker, date) table."""
    if members is None:
        return df.withColumn("universe_date", F.lit(True))
    flag = members.select("ticker", "date").distinct().withColumn("universe_date", F.lit(True))
    return df.join(flag, ["ticker", "date"], "left").withColumn(
        "universe_date", F.coalesce("universe_date", F.lit(False))
    )


def build_gold(silver: DataFrame, sectors: DataFrame | None = None) -> DataFrame:
    """All enrichments. Sorting is left to the writer."""
    out = enrich_with_volume_features(enrich_with_sector(silver, sectors))
    return enrich_with_universe_flag(enrich_with_market_cap_bucket(out))
