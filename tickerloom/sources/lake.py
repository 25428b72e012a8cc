"""Layered Parquet lake: reads, keyed writes, views, CSV and JSON sinks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

LAYERS = ("bronze_daily", "silver_daily", "gold_daily")


def between_dates(
    df: DataFrame, start=None, end=None, column: str = "date", end_exclusive: bool = False
) -> DataFrame:
    """Plain range predicates, which reach the partition filters and the Parquet scan."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(column) < F.lit(end) if end_exclusive else F.col(column) <= F.lit(end))
    return df


def _prune_years(df: DataFrame, start, end) -> DataFrame:
    if "year" in df.columns:
        if start is not None:
            df = df.filter(F.col("year") >= F.year(F.lit(start)))
        if end is not None:
            df = df.filter(F.col("year") <= F.year(F.lit(end)))
    return df


def load_gold(spark: SparkSession, path: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Gold bars from ``start`` (included) to ``end`` (excluded)."""
    return between_dates(_prune_years(spark.read.parquet(path), start, end), start, end, end_exclusive=True)


def load_range(
    spark: SparkSession, path: str, tickers: Sequence[str] | None = None, start=None, end=None, column: str = "date"
) -> DataFrame:
    """Bars of some tickers with both ends included (bronze, backtest and intraday loads)."""
    df = between_dates(_prune_years(spark.read.parquet(path), start, end), start, end, column)
    return df if tickers is None else df.filter(F.col("ticker").isin(*tickers))


def load_bronze(
    spark: SparkSession, root: str, tickers: Sequence[str], start: date, end: date
) -> dict[str, DataFrame]:
    """Bars, dividends and corporate actions of one bronze root; empty frames where a set is missing."""
    columns = {"daily": "date", "dividends": "ex_date", "corporate_actions": "date"}
    schemas = {
        "daily": "ticker string, date date, open double, high double, low double, close double, volume bigint",
        "dividends": "ticker string, ex_date date, amount double",
        "corporate_actions": "ticker string, date date, action_type string, factor double",
    }
    out = {}
    for name, col in columns.items():
        try:
            out[name] = load_range(spark, f"{root}/{name}", tickers, start, end, col)
        except AnalysisException:
            out[name] = spark.createDataFrame([], schemas[name])
    return out


def union_relaxed(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Union by name: missing columns become NULL, types widen, columns end up sorted by name."""
    out = first
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def newest_wins(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Rows of both sides, unique per key, the incoming row replacing the stored one."""
    kept = existing.join(incoming.select(*keys), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def append_unseen(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet, added to the stored ones."""
    fresh = incoming.join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def write_by_year(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per year, rows clustered by ticker inside it.

    Rows are spread over (year, ticker range) so that a year is written by many tasks and
    each file keeps a narrow ticker range for min/max pruning.
    """
    (
        df.withColumn("year", F.year("date"))
        .repartitionByRange("year", "ticker", "date")
        .sortWithinPartitions("year", "ticker", "date")
        .write.mode(mode).partitionBy("year").option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic").parquet(path)
    )


def upsert_by_year(spark: SparkSession, incoming: DataFrame, path: str, staging: str) -> None:
    """Merge bars into the lake; only the years they touch are rewritten.

    The merged years are written to ``staging`` first, since a folder cannot be read and
    overwritten by one job.
    """
    incoming = incoming.withColumn("year", F.year("date"))
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        write_by_year(incoming.drop("year"), path)
        return
    # at most one value per calendar year
    years = [y for (y,) in incoming.select("year").distinct().collect()]
    newest_wins(stored.filter(F.col("year").isin(*years)), incoming).write.mode("overwrite").parquet(staging)
    write_by_year(spark.read.parquet(staging).drop("year"), path)


def write_minutes(df: DataFrame, path: str) -> None:
    """Minute bars by ticker, year and month; each month of a busy ticker is still split over tasks by day."""
    (
        df.withColumns({"year": F.year("datetime"), "month": F.date_format("datetime", "MM")})
        .repartitionByRange("ticker", "datetime").sortWithinPartitions("ticker", "datetime")
        .write.mode("overwrite").partitionBy("ticker", "year", "month").option("compression", "zstd").parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def register_views(spark: SparkSession, paths: dict[str, str]) -> list[str]:
    """Layer views for the paths that hold data, plus universe_daily over gold."""
    made = []
    for name, path in paths.items():
        try:
            spark.read.parquet(path).createOrReplaceTempView(name)
            made.append(name)
        except AnalysisException:
            continue
    if "gold_daily" in made:
        universe(spark.table("gold_daily")).createOrReplaceTempView("universe_daily")
        made.append("universe_daily")
    return made


def universe(gold: DataFrame) -> DataFrame:
    return gold.filter(F.col("universe_date") & (F.col("data_quality") == "good"))


def run_sql(spark: SparkSession, text: str, params: Sequence | dict | None = None) -> DataFrame:
    """SQL over the views with positional (?) or named (:x) parameters."""
    return spark.sql(text, args=params) if params else spark.sql(text)


def view_counts(spark: SparkSession, frames: dict[str, DataFrame | None]) -> DataFrame:
    """Row count per view; NULL and 'Not available' where a view is missing."""
    out = None
    for name, df in frames.items():
        if df is None:
            one = spark.range(1).select(F.lit(name).alias("view"), F.lit(None).cast("long").alias("rows"),
                                        F.lit("Not available").alias("status"))
        else:
            one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("view"), "rows",
                                                                 F.lit("ok").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def ticker_ranges(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def fetch_plan(universe_tickers: DataFrame, stored: DataFrame, start: date, end: date, force: bool = False) -> DataFrame:
    """What to fetch per ticker: everything, nothing, or the days after the last stored one."""
    last = stored.groupBy("ticker").agg(F.max("date").alias("max_date"))
    full = F.col("max_date").isNull() | F.lit(force)
    fresh = F.col("max_date") >= F.date_sub(F.lit(end), 1)
    return universe_tickers.select("ticker").distinct().join(last, "ticker", "left").select(
        "ticker",
        (full | ~fresh).alias("should_fetch"),
        F.when(full, F.lit(start)).when(fresh, F.lit(None)).otherwise(F.date_add("max_date", 1)).alias("effective_start"),
        F.when(full, "full").when(fresh, "fresh")
        .when(F.date_add("max_date", 1) > F.lit(start), "incremental").otherwise("full").alias("label"),
    )


def fills_log(fills: DataFrame) -> DataFrame:
    """Executions in log form: BOT/SLD become BUY/SELL, timestamps carry their UTC day."""
    side = F.upper("side")
    return fills.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts_utc"),
        F.to_date("ts").alias("day"),
        "ticker",
        F.when(side.isin("BOT", "BUY"), "BUY").when(side.isin("SLD", "SELL"), "SELL").otherwise(side).alias("side"),
        "shares", "price", "commission", "exec_id", "order_id",
    )


def append_fills(fills: DataFrame, path: str) -> None:
    """Add to the log, one folder per UTC day; a task holds a narrow range of days, so few files are opened."""
    fills_log(fills).repartitionByRange("day", "ts_utc", "exec_id").write.mode("append").partitionBy("day").json(path)
