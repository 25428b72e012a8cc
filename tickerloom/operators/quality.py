"""Data-quality checks as rows of (level, check, ticker, n, message).

All counts of a run come out of one pass: a lag per ticker, then one rollup that yields
the per-ticker and the whole-table rows together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICE_COLUMNS = ("open", "high", "low", "close")
MAX_GAP_DAYS = 5
MAX_ZERO_SHARE = 0.10
MAX_MOVE = 0.20

COUNT_CHECKS = ("negative_prices", "future_dates", "date_gaps", "zero_volume", "price_gaps")
RESULT = "level string, check string, ticker string, n bigint, message string"


def _row(cond: Column, level: str, check: str, ticker: Column, n: Column, message: Column) -> Column:
    row = F.struct(
        F.lit(level).alias("level"),
        F.lit(check).alias("check"),
        ticker.alias("ticker"),
        n.cast("long").alias("n"),
        message.alias("message"),
    )
    return F.when(cond, row)


def count_checks(
    df: DataFrame, checks: Sequence[str] = COUNT_CHECKS, threshold: float = MAX_MOVE, today: Column | None = None
) -> DataFrame:
    """The count-based checks, any subset of them."""
    today = F.current_date() if today is None else today
    price = "adj_close" if "adj_close" in df.columns else "close"
    whole, nobody = F.col("_whole") == 1, F.lit(None).cast("string")
    per_ticker = F.col("_whole") == 0
    aggs, rows = {"_n": F.count(F.lit(1))}, []
    pre = {}

    if "negative_prices" in checks:
        for c in (c for c in PRICE_COLUMNS if c in df.columns):
            aggs[f"_neg_{c}"] = F.count_if(F.col(c) < 0)
            n = F.col(f"_neg_{c}")
            rows.append(_row(whole & (n > 0), "error", f"negative_{c}", nobody, n,
                             F.format_string(f"%d rows with negative {c} prices", n)))
    if "future_dates" in checks:
        aggs["_future"] = F.count_if(F.col("date") > today)
        n = F.col("_future")
        rows.append(_row(whole & (n > 0), "error", "future_dates", nobody, n,
                         F.format_string("%d rows with future dates", n)))
    w = Window.partitionBy("ticker").orderBy("date")
    if "date_gaps" in checks:
        pre["_gap"] = F.datediff("date", F.lag("date").over(w)) > MAX_GAP_DAYS
        aggs["_gaps"] = F.count_if("_gap")
        n = F.col("_gaps")
        rows.append(_row(per_ticker & (n > 0), "warning", "date_gaps", F.col("ticker"), n,
                         F.format_string(f"%s: %d large date gaps (>{MAX_GAP_DAYS} days)", "ticker", n)))
    if "zero_volume" in checks and "volume" in df.columns:
        aggs["_zero"] = F.count_if(F.col("volume") == 0)
        n, share = F.col("_zero"), F.col("_zero") / F.col("_n")
        rows.append(_row(per_ticker & (share > MAX_ZERO_SHARE), "warning", "zero_volume", F.col("ticker"), n,
                         F.format_string("%s: %d/%d (%d%%) days with zero volume", "ticker", n, "_n", F.expr("(200 * _zero + _n) div (2 * _n)"))))  # halves go up; a product of doubles misses them
    if "price_gaps" in checks:
        prev = F.lag(price).over(w)
        move = F.abs(F.col(price) / F.nullif(prev, F.lit(0.0)) - 1)
        pre["_jump"] = (F.col(price) != 0) & (move > threshold)
        aggs["_jumps"] = F.count_if("_jump")
        n = F.col("_jumps")
        rows.append(_row(whole & (n > 0), "warning", "price_gaps", nobody, n,
                         F.format_string(f"%d price gaps > {threshold:.0%}%% (may indicate splits/gaps)".replace("%%%", "%%"), n)))

    counted = (
        (df.withColumns(pre) if pre else df)
        .rollup("ticker")
        .agg(F.grouping("ticker").alias("_whole"), *[c.alias(k) for k, c in aggs.items()])
    )
    return (
        counted.select(F.explode(F.array_compact(F.array(*rows))).alias("r"))
        .select("r.level", "r.check", "r.ticker", "r.n", "r.message")
    )


def date_coverage(df: DataFrame) -> DataFrame:
    n = F.col("n")
    return df.agg(F.countDistinct("date").alias("n")).select(
        F.lit("info").alias("level"), F.lit("unique_dates").alias("check"), F.lit(None).cast("string").alias("ticker"),
        n, F.format_string("Unique dates in dataset: %d", n).alias("message"),
    )


def quality_flags(df: DataFrame) -> DataFrame:
    if "data_quality" not in df.columns:
        return df.sparkSession.createDataFrame([], RESULT)
    return (
        df.groupBy("data_quality").agg(F.count(F.lit(1)).alias("n")).filter(F.col("data_quality") != "good")
        .select(F.lit("warning").alias("level"), F.lit("quality_flag").alias("check"),
                F.lit(None).cast("string").alias("ticker"), "n",
                F.format_string("data_quality='%s': %d rows", "data_quality", "n").alias("message"))
    )


def run_all_checks(df: DataFrame, layer: str = "silver", threshold: float = MAX_MOVE) -> DataFrame:
    out = count_checks(df, threshold=threshold).unionByName(date_coverage(df))
    return out.unionByName(quality_flags(df)) if layer in ("silver", "gold") else out


def summary(results: DataFrame) -> DataFrame:
    """One row: is_valid, error and warning counts."""
    errors = F.count_if(F.col("level") == "error")
    return results.agg(
        (errors == 0).alias("is_valid"), errors.alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"), F.count_if(F.col("level") == "info").alias("infos"),
    )
