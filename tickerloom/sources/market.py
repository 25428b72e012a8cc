"""Bars, events, ticks and fills derived from the given tables.

lineitem is a log of trades: supplier = ticker, ship date = trading day, price =
extended price per unit. events is a tick stream: type = ticker, value = price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def ticker_name(key: str) -> Column:
    return F.concat(F.lit("S"), F.col(key).cast("string"))


def trade_seq() -> Column:
    """Order number, line and price: sorts by the first that differs.

    Packed into one number it would overflow at large keys or prices.
    """
    return F.struct(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("l_extendedprice").alias("extendedprice"))


def trades(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").select(
        ticker_name("l_suppkey").alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("amount"),
        trade_seq().alias("seq"),
    )


def bars(spark: SparkSession, root: str) -> DataFrame:
    """Daily bars, one row per (ticker, date); a busy ticker-day combines before the shuffle."""
    return (
        trades(spark, root)
        .groupBy("ticker", "date")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("qty").cast("long").alias("volume"),
            (F.sum(F.floor(F.col("amount") * 100 + 0.5)) / 100.0 / F.sum("qty")).alias("vwap"),
        )
    )


def sectors(spark: SparkSession, root: str) -> DataFrame:
    """ticker → region name; one row per supplier."""
    nation, region = table(spark, root, "nation"), table(spark, root, "region")
    return (
        table(spark, root, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(ticker_name("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"))
    )


def actions(panel: DataFrame) -> DataFrame:
    """Corporate actions of every ticker: 2:1 split at its 200th bar, 3:1 at its 400th,
    a reverse split at its 300th and a symbol change at its 100th."""
    n = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    kind = F.when(F.col("_n") == 100, "symbol_change").otherwise("split")
    factor = (
        F.when(F.col("_n") == 200, 2.0).when(F.col("_n") == 300, 0.5).when(F.col("_n") == 400, 3.0).otherwise(1.0)
    )
    return (
        panel.select("ticker", "date", n.alias("_n"))
        .filter(F.col("_n").isin(100, 200, 300, 400))
        .select("ticker", "date", kind.alias("action_type"), factor.alias("factor"))
    )


def dividends(panel: DataFrame) -> DataFrame:
    """Every ticker pays 0.5 % of its mean raw close on its first bar of each quarter."""
    w = Window.partitionBy("ticker")
    return (
        panel.select("ticker", "date", F.avg("close").over(w).alias("_mean"))
        .groupBy("ticker", F.trunc("date", "quarter").alias("_q"))
        .agg(F.min("date").alias("ex_date"), (F.first("_mean") * 0.005).alias("amount"))
        .select("ticker", "ex_date", "amount")
    )


def ticks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select(
        F.col("event_type").alias("ticker"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(1)).alias("volume"),
        "user_id",
    )


def fills(spark: SparkSession, root: str) -> DataFrame:
    """Executions: account = order's customer segment, side by return flag (returns are sells).

    Orders find their customers first, so that trades, the largest of the three, are shuffled once.
    """
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, root, "customer").select("c_custkey", "c_mktsegment")
    return (
        table(spark, root, "lineitem")
        .join(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("c_mktsegment").alias("account"),
            ticker_name("l_suppkey").alias("ticker"),
            F.to_date("l_shipdate").alias("date"),
            trade_seq().alias("seq"),
            F.when(F.col("l_linenumber").isin(2, 4, 6) | (F.col("l_returnflag") == "R"), "SELL")
            .otherwise("BUY")
            .alias("side"),
            F.col("l_quantity").alias("shares"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            (F.col("l_quantity") * 0.005).alias("commission"),
        )
    )
