"""Writes checked by reading them back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tickerloom.operators import metrics
from tickerloom.queries.lake import PX, SQL_PX
from tickerloom.queries.registry import query, r, rounded
from tickerloom.queries.research import CORE, FT, HORIZONS, lean_panel
from tickerloom.queries.sql import BARS, TRADES, ctes, r as sr
from tickerloom.queries.trading import ACCT, MINUTES, OHLC, PX as MIN_PX, SUM_COLS, TICKS, minutes, summary
from tickerloom.sources import lake, market
from tickerloom.streaming.jobs import work_folder


@query("sink_by_year", ctes(BARS) + f" SELECT ticker, date, {SQL_PX}, volume, CAST(year(date) AS INTEGER) AS year FROM bars")
def sink_by_year(spark, root):
    path = work_folder(spark, "bars-by-year")
    lake.write_by_year(rounded(market.bars(spark, root), *PX), path)
    return spark.read.parquet(path).select("ticker", "date", *PX, "volume", "year")


@query(
    "sink_upsert_by_year",
    ctes(BARS) + f""" SELECT ticker, date, {sr('CASE WHEN date > DATE ' + "'1999-01-01'" + ' THEN close + 1 ELSE close END')} AS close FROM bars""",
)
def sink_upsert(spark, root):
    """A second load overlaps the first; newer rows win and keys stay unique."""
    path, staging = work_folder(spark, "upsert"), work_folder(spark, "upsert-staging")
    b = market.bars(spark, root).select("ticker", "date", "close")
    lake.write_by_year(b.filter(F.col("date") <= F.lit(date(1999, 6, 30))), path)
    lake.upsert_by_year(spark, b.filter(F.col("date") > F.lit(date(1999, 1, 1))).withColumn("close", F.col("close") + 1), path, staging)
    return rounded(spark.read.parquet(path), "close").select("ticker", "date", "close")


@query("sink_minutes", ctes(TICKS, MINUTES) + f" SELECT ticker, datetime, {MIN_PX}, volume FROM minutes")
def sink_minutes(spark, root):
    path = work_folder(spark, "minutes")
    lake.write_minutes(minutes(spark, root), path)
    return rounded(spark.read.parquet(path), *OHLC).select("ticker", "datetime", *OHLC, "volume")


@query(
    "intraday_load",
    ctes(TICKS, MINUTES) + f" SELECT ticker, datetime, {MIN_PX}, volume FROM minutes WHERE ticker IN ('view', 'click') AND datetime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
)
def intraday_load(spark, root):
    path = work_folder(spark, "minutes")
    lake.write_minutes(minutes(spark, root), path)
    lo, hi = (F.lit(x).cast("timestamp") for x in ("2024-01-05", "2024-01-20"))
    out = lake.load_range(spark, path, ["view", "click"], lo, hi, "datetime")
    return rounded(out, *OHLC).select("ticker", "datetime", *OHLC, "volume")


@query("sink_csv", ctes(TRADES) + " SELECT date, count(*) AS trades, CAST(sum(qty) AS BIGINT) AS volume FROM trades GROUP BY date")
def sink_csv(spark, root):
    path = work_folder(spark, "csv")
    lake.write_csv(market.trades(spark, root).groupBy("date").agg(F.count(F.lit(1)).alias("trades"), F.sum("qty").cast("long").alias("volume")), path)
    return spark.read.schema("date date, trades bigint, volume bigint").option("header", True).csv(path)


@query("sink_json_report", ctes(*FT) + f" SELECT scope, signal, CAST(horizon AS INTEGER) AS horizon, {sr('ic')} AS ic, n_obs FROM ic")
def sink_json_report(spark, root):
    path = work_folder(spark, "report")
    lake.write_json(rounded(metrics.forward_test(lean_panel(spark, root, written=False), HORIZONS, CORE), "ic").select("scope", "signal", "horizon", "ic", "n_obs"), path)
    return spark.read.schema("scope string, signal string, horizon int, ic double, n_obs bigint").json(path)


@query(
    "sink_fills_log",
    """SELECT CAST(l_shipdate AS DATE) AS day, 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, count(*) AS fills,
 sum(l_quantity) AS shares FROM lineitem GROUP BY ALL""",
)
def sink_fills_log(spark, root):
    path = work_folder(spark, "fills")
    raw = market.table(spark, root, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("ts"), market.ticker_name("l_suppkey").alias("ticker"), F.when(F.col("l_returnflag") == "R", "SLD").otherwise("BOT").alias("side"),
        F.col("l_quantity").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_tax").alias("commission"),
        F.col("l_partkey").cast("string").alias("exec_id"), F.col("l_orderkey").alias("order_id"))
    lake.append_fills(raw, path)
    log = spark.read.schema("day date, ticker string, side string, shares double, price double").json(path)
    return log.groupBy("day", "ticker", "side").agg(F.count(F.lit(1)).alias("fills"), F.sum("shares").alias("shares"))


@query("sink_daily_summary", ctes(*ACCT) + f" SELECT account, date, num_wins, num_losses, {', '.join(f'{sr(c)} AS {c}' for c in SUM_COLS)} FROM summary")
def sink_daily_summary(spark, root):
    path = work_folder(spark, "summaries")
    rounded(summary(spark, root), *SUM_COLS).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("account", "date", "num_wins", "num_losses", *SUM_COLS)


@query(
    "sink_summary_text",
    ctes(*ACCT) + " SELECT format('{} {} wins={} losses={}', account, date, num_wins, num_losses) AS line FROM summary",
)
def sink_summary_text(spark, root):
    path = work_folder(spark, "summary-text")
    line = F.format_string("%s %s wins=%d losses=%d", "account", F.col("date").cast("string"), "num_wins", "num_losses")
    lake.write_text(summary(spark, root).select(line.alias("line")), path, "line")
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("newest_rows", ctes(BARS) + f" SELECT ticker, date, {SQL_PX} FROM bars ORDER BY date DESC, ticker LIMIT 10")
def newest_rows(spark, root):
    """Head of a table, a bounded report."""
    return market.bars(spark, root).orderBy(F.col("date").desc(), "ticker").limit(10).select("ticker", "date", *[r(c).alias(c) for c in PX])
