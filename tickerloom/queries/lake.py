"""Sources, silver, gold and data quality."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tickerloom.operators import adjust, enrich, quality
from tickerloom.queries.registry import query, r, rounded
from tickerloom.queries.sql import (
    ACTIONS, BARS, DIVIDENDS, LAKE, SECTORS, SPLIT_BARS, TRADES, ctes, dividend_bars, r as sr, rm,
)
from tickerloom.sources import lake, market, vendor

PX = ("open", "high", "low", "close")
SQL_PX = ", ".join(f"{sr(c)} AS {c}" for c in PX)


def silver(spark, root):
    bars = market.bars(spark, root)
    return adjust.build_silver(bars, market.dividends(bars), market.actions(bars))


def gold(spark, root):
    return enrich.build_gold(silver(spark, root), market.sectors(spark, root))


def _out(df, *extra):
    return df.select("ticker", "date", *[r(c).alias(c) for c in PX], *extra)


@query("daily_bars", ctes(BARS) + f" SELECT ticker, date, {SQL_PX}, volume, {sr('vwap')} AS vwap FROM bars")
def daily_bars(spark, root):
    return _out(market.bars(spark, root), "volume", r("vwap").alias("vwap"))


@query(
    "gold_range_load",
    LAKE + f" SELECT ticker, date, {SQL_PX}, data_quality FROM gold WHERE date >= DATE '1997-01-01' AND date < DATE '2000-01-01'",
)
def gold_range_load(spark, root):
    return _out(
        lake.between_dates(gold(spark, root), date(1997, 1, 1), date(2000, 1, 1), end_exclusive=True), "data_quality"
    )


@query(
    "bronze_reload",
    ctes(BARS, ACTIONS, DIVIDENDS) + """
 SELECT 'daily' AS dataset, ticker, date, floor((close) * 1e6 + 0.501) / 1e6 AS amount FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
 UNION ALL SELECT 'dividends', ticker, ex_date, floor((amount) * 1e6 + 0.501) / 1e6 FROM dividends WHERE ex_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
 UNION ALL SELECT 'corporate_actions', ticker, date, factor FROM actions WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
)
def bronze_reload(spark, root):
    bars = market.bars(spark, root)
    lo, hi = date(1996, 1, 1), date(2000, 12, 31)
    parts = (
        lake.between_dates(bars, lo, hi).select(F.lit("daily").alias("dataset"), "ticker", "date", r("close").alias("amount")),
        lake.between_dates(market.dividends(bars), lo, hi, "ex_date").select(
            F.lit("dividends").alias("dataset"), "ticker", F.col("ex_date").alias("date"), r("amount").alias("amount")),
        lake.between_dates(market.actions(bars), lo, hi).select(
            F.lit("corporate_actions").alias("dataset"), "ticker", "date", F.col("factor").alias("amount")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "lazy_filtered_scan",
    "SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, floor((l_extendedprice / l_quantity) * 1e6 + 0.501) / 1e6 AS price "
    "FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_quantity >= 10",
)
def lazy_filtered_scan(spark, root):
    return (
        market.table(spark, root, "lineitem")
        .filter((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") >= 10))
        .select(market.ticker_name("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"),
                r(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    )


@query(
    "relaxed_union",
    """SELECT CAST(l_quantity AS DOUBLE) AS amount, NULL::VARCHAR AS kind, 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, NULL::DOUBLE AS value FROM lineitem
 UNION ALL SELECT NULL, event_type, CAST(user_id AS VARCHAR), value FROM events""",
)
def relaxed_union(spark, root):
    a = market.table(spark, root, "lineitem").select(
        market.ticker_name("l_suppkey").alias("ticker"), F.col("l_quantity").alias("amount"))
    b = market.table(spark, root, "events").select(
        F.col("user_id").cast("string").alias("ticker"), F.col("event_type").alias("kind"), "value")
    return lake.union_relaxed(a, b)


@query(
    "universe_view",
    LAKE + f" SELECT ticker, date, {SQL_PX}, sector FROM gold WHERE universe_date AND data_quality = 'good'",
)
def universe_view(spark, root):
    return _out(lake.universe(gold(spark, root)), "sector")


@query(
    "parameterised_sql",
    ctes(BARS) + " SELECT ticker, count(*) AS bars, sum(volume) AS volume FROM bars WHERE date >= DATE '1998-01-01' AND volume >= 20 GROUP BY ticker",
)
def parameterised_sql(spark, root):
    market.bars(spark, root).createOrReplaceTempView("bronze_daily")
    return lake.run_sql(
        spark,
        "SELECT ticker, count(*) AS bars, sum(volume) AS volume FROM bronze_daily WHERE date >= ? AND volume >= ? GROUP BY ticker",
        [date(1998, 1, 1), 20],
    )


@query(
    "view_row_counts",
    LAKE + """ SELECT 'bronze_daily' AS view, count(*) AS rows, 'ok' AS status FROM bars
 UNION ALL SELECT 'gold_daily', count(*), 'ok' FROM gold
 UNION ALL SELECT 'universe_daily', count(*), 'ok' FROM gold WHERE universe_date AND data_quality = 'good'
 UNION ALL SELECT 'silver_weekly', NULL, 'Not available'""",
)
def view_row_counts(spark, root):
    g = gold(spark, root)
    return lake.view_counts(
        spark,
        {"bronze_daily": market.bars(spark, root), "gold_daily": g, "universe_daily": lake.universe(g), "silver_weekly": None},
    )


@query(
    "ticker_date_ranges",
    ctes(TRADES) + " SELECT ticker, min(date) AS first_date, max(date) AS last_date FROM trades GROUP BY ticker",
)
def ticker_date_ranges(spark, root):
    return lake.ticker_ranges(market.trades(spark, root))


@query("distinct_tickers", ctes(TRADES) + " SELECT DISTINCT ticker FROM trades")
def distinct_tickers(spark, root):
    return market.trades(spark, root).select("ticker").distinct()


@query(
    "normalise_daily_bars",
    ctes(BARS) + f" SELECT ticker, date, {SQL_PX}, volume, NULL::DOUBLE AS vwap, 'feed' AS source FROM bars",
)
def normalise_daily_bars(spark, root):
    raw = market.bars(spark, root).select(
        "ticker", F.col("date").cast("timestamp").alias("Date"), *[F.col(c).alias(c.capitalize()) for c in PX],
        F.col("volume").alias("Volume"))
    return rounded(vendor.normalise_bars(raw, "feed"), *PX)


@query(
    "normalise_epoch_bars",
    """SELECT event_type AS ticker, CAST(ts AS DATE) AS date, value AS open, value + 1 AS high, value - 1 AS low, value AS close,
  coalesce(CASE WHEN user_id > 20 THEN user_id END, 0) AS volume, NULL::DOUBLE AS vwap, 'feed' AS source FROM events WHERE ts IS NOT NULL""",
)
def normalise_epoch_bars(spark, root):
    e = market.table(spark, root, "events")
    v = F.col("value")
    raw = e.select(
        F.col("event_type").alias("ticker"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), v.alias("o"),
        (v + 1).alias("h"), (v - 1).alias("l"), v.alias("c"), F.when(F.col("user_id") > 20, F.col("user_id")).alias("v"),
        F.lit(None).cast("double").alias("vw"))
    return vendor.normalise_epoch_bars(raw, "feed")


@query(
    "normalise_dividends",
    ctes(BARS, DIVIDENDS) + " SELECT ticker, ex_date, floor((amount) * 1e6 + 0.501) / 1e6 AS amount FROM dividends WHERE ex_date > DATE '1996-01-02' AND ex_date <= DATE '2001-01-31'",
)
def normalise_dividends(spark, root):
    divs = market.dividends(market.bars(spark, root))
    return rounded(vendor.normalise_dividends(divs, date(1996, 1, 2), date(2001, 1, 31), start_exclusive=True), "amount")


@query(
    "normalise_splits",
    """SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, 'split' AS action_type,
  floor((l_quantity / nullif(l_linenumber - 1, 0)) * 1e6 + 0.501) / 1e6 AS factor FROM lineitem WHERE l_linenumber <> 1""",
)
def normalise_splits(spark, root):
    raw = market.table(spark, root, "lineitem").select(
        market.ticker_name("l_suppkey").alias("ticker"), F.col("l_shipdate").alias("date"),
        F.col("l_quantity").alias("split_to"), (F.col("l_linenumber") - 1).alias("split_from"))
    return rounded(vendor.normalise_splits(raw), "factor")


@query(
    "validate_bars",
    ctes(BARS) + f" SELECT ticker, date, {SQL_PX}, volume, {sr('vwap')} AS vwap, 'lineitem' AS source FROM bars WHERE close > 0 AND date <= DATE '2000-06-30'",
)
def validate_bars(spark, root):
    ok = vendor.validate_bars(market.bars(spark, root), "lineitem", F.lit(date(2000, 6, 30)))
    return rounded(ok, *PX, "vwap")


@query(
    "last_stored_date",
    ctes(TRADES) + " SELECT ticker, max(date) AS max_date FROM trades GROUP BY ticker",
)
def last_stored_date(spark, root):
    return market.trades(spark, root).groupBy("ticker").agg(F.max("date").alias("max_date"))


PLAN_START, PLAN_END = date(1995, 1, 2), date(2001, 11, 2)


@query(
    "fetch_plan",
    ctes(TRADES) + """, u AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker FROM supplier UNION SELECT 'NEW'),
 m AS (SELECT u.ticker, max(t.date) AS max_date FROM u LEFT JOIN trades t ON u.ticker = t.ticker GROUP BY u.ticker)
 SELECT ticker, max_date IS NULL OR max_date < DATE '2001-11-01' AS should_fetch,
  CASE WHEN max_date IS NULL THEN DATE '1995-01-02' WHEN max_date >= DATE '2001-11-01' THEN NULL ELSE max_date + 1 END AS effective_start,
  CASE WHEN max_date IS NULL THEN 'full' WHEN max_date >= DATE '2001-11-01' THEN 'fresh' ELSE 'incremental' END AS label FROM m""",
)
def fetch_plan(spark, root):
    universe = market.table(spark, root, "supplier").select(market.ticker_name("s_suppkey").alias("ticker"))
    universe = universe.unionByName(spark.range(1).select(F.lit("NEW").alias("ticker")))
    return lake.fetch_plan(universe, market.trades(spark, root), PLAN_START, PLAN_END)


@query(
    "append_unseen_bars",
    ctes(BARS) + """ SELECT ticker, date, floor((close) * 1e6 + 0.501) / 1e6 AS close FROM bars WHERE date <= DATE '1999-06-30'
 UNION ALL SELECT ticker, date, floor((close + 1) * 1e6 + 0.501) / 1e6 FROM bars WHERE date > DATE '1999-06-30'""",
)
def append_unseen_bars(spark, root):
    b = market.bars(spark, root).select("ticker", "date", "close")
    stored = b.filter(F.col("date") <= F.lit(date(1999, 6, 30)))
    incoming = b.filter(F.col("date") > F.lit(date(1999, 1, 1))).withColumn("close", F.col("close") + 1)
    return rounded(lake.append_unseen(stored, incoming), "close")


@query(
    "upsert_newest_wins",
    ctes(BARS) + """ SELECT ticker, date, floor((close) * 1e6 + 0.501) / 1e6 AS close FROM bars WHERE date <= DATE '1999-01-01'
 UNION ALL SELECT ticker, date, floor((close + 1) * 1e6 + 0.501) / 1e6 FROM bars WHERE date > DATE '1999-01-01'""",
)
def upsert_newest_wins(spark, root):
    b = market.bars(spark, root).select("ticker", "date", "close")
    stored = b.filter(F.col("date") <= F.lit(date(1999, 6, 30)))
    incoming = b.filter(F.col("date") > F.lit(date(1999, 1, 1))).withColumn("close", F.col("close") + 1)
    return rounded(lake.newest_wins(stored, incoming), "close")


@query(
    "fills_log",
    """SELECT strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') AS ts_utc, CAST(l_shipdate AS DATE) AS day,
  'S' || CAST(l_suppkey AS VARCHAR) AS ticker, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  l_quantity AS shares, floor((l_extendedprice / l_quantity) * 1e6 + 0.501) / 1e6 AS price, floor((l_tax * l_quantity) * 1e6 + 0.501) / 1e6 AS commission,
  CAST(l_partkey AS VARCHAR) AS exec_id, l_orderkey AS order_id FROM lineitem""",
)
def fills_log(spark, root):
    raw = market.table(spark, root, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("ts"), market.ticker_name("l_suppkey").alias("ticker"),
        F.when(F.col("l_returnflag") == "R", "SLD").otherwise("bot").alias("side"), F.col("l_quantity").alias("shares"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_tax") * F.col("l_quantity")).alias("commission"),
        F.col("l_partkey").cast("string").alias("exec_id"), F.col("l_orderkey").alias("order_id"))
    return rounded(lake.fills_log(raw), "price", "commission")


@query("split_adjustment", ctes(BARS, ACTIONS, SPLIT_BARS) + f" SELECT ticker, date, {SQL_PX}, {sr('volume')} AS volume FROM split_bars")
def split_adjustment(spark, root):
    bars = market.bars(spark, root)
    splits = market.actions(bars).filter(F.col("action_type") == "split")
    return _out(adjust.adjust_for_splits(bars, splits), r("volume").alias("volume"))


@query(
    "dividend_adjustment",
    ctes(BARS, DIVIDENDS, dividend_bars("bars")) + f" SELECT ticker, date, {SQL_PX}, volume FROM div_bars",
)
def dividend_adjustment(spark, root):
    bars = market.bars(spark, root)
    return _out(adjust.adjust_for_dividends(bars, market.dividends(bars)), "volume")


@query(
    "silver_layer",
    LAKE + f" SELECT ticker, date, {SQL_PX}, {sr('volume')} AS volume, {sr('adj_close')} AS adj_close, split_factor, dividend_yield, is_market_date, data_quality FROM silver",
)
def silver_layer(spark, root):
    return _out(silver(spark, root), r("volume").alias("volume"), r("adj_close").alias("adj_close"), "split_factor",
                "dividend_yield", "is_market_date", "data_quality")


@query("sector_join", ctes(BARS, SECTORS) + " SELECT b.ticker, b.date, coalesce(sector, 'Unknown') AS sector FROM bars b LEFT JOIN sectors s ON b.ticker = s.ticker")
def sector_join(spark, root):
    return enrich.enrich_with_sector(market.bars(spark, root), market.sectors(spark, root)).select("ticker", "date", "sector")


A60 = rm("volume", 60)


@query(
    "volume_enrichment",
    ctes(BARS) + f""" SELECT ticker, date, {sr(rm('volume', 20))} AS avg_volume_20d, {sr(A60)} AS avg_volume_60d,
 {sr(f'CASE WHEN {A60} > 0 THEN volume / {A60} ELSE 1.0 END')} AS volume_ratio FROM bars""",
)
def volume_enrichment(spark, root):
    out = enrich.enrich_with_volume_features(market.bars(spark, root))
    cols = ("avg_volume_20d", "avg_volume_60d", "volume_ratio")
    return rounded(out, *cols).select("ticker", "date", *cols)


BUCKETS = {"mega": ("S1", "S2", "S3"), "large": ("S3", "S4", "S5"), "etfs": ("S6",), "etf_prefix": "S7"}


@query(
    "market_cap_bucket",
    ctes(BARS) + """ SELECT ticker, date, CASE WHEN ticker IN ('S1','S2','S3') THEN 'mega' WHEN ticker IN ('S3','S4','S5') THEN 'large'
 WHEN ticker = 'S6' OR starts_with(ticker, 'S7') THEN 'etf' ELSE 'mid' END AS market_cap_bucket FROM bars""",
)
def market_cap_bucket(spark, root):
    return enrich.enrich_with_market_cap_bucket(market.bars(spark, root), **BUCKETS).select("ticker", "date", "market_cap_bucket")


@query(
    "universe_membership",
    ctes(BARS) + """, m AS (SELECT DISTINCT ticker, date FROM bars WHERE volume >= 20)
 SELECT b.ticker, b.date, m.ticker IS NOT NULL AS universe_date FROM bars b LEFT JOIN m ON b.ticker = m.ticker AND b.date = m.date""",
)
def universe_membership(spark, root):
    bars = market.bars(spark, root)
    return enrich.enrich_with_universe_flag(bars, bars.filter(F.col("volume") >= 20)).select("ticker", "date", "universe_date")


@query(
    "gold_layer",
    LAKE + f""" SELECT ticker, date, {SQL_PX}, {sr('volume')} AS volume, {sr('adj_close')} AS adj_close, data_quality, sector,
 {sr('avg_volume_20d')} AS avg_volume_20d, {sr('avg_volume_60d')} AS avg_volume_60d, {sr('volume_ratio')} AS volume_ratio,
 market_cap_bucket, universe_date FROM gold""",
)
def gold_layer(spark, root):
    num = ("volume", "adj_close", "avg_volume_20d", "avg_volume_60d", "volume_ratio")
    g = rounded(gold(spark, root), *num)
    return _out(g, "volume", "adj_close", "data_quality", "sector", "avg_volume_20d", "avg_volume_60d", "volume_ratio",
                "market_cap_bucket", "universe_date")


# A frame with faults for the checks: negative lows, empty volumes, one price factor too large.
FAULTS = """faulty AS (
 SELECT ticker, date, open, high, CASE WHEN volume = 7 THEN -low ELSE low END AS low, close,
        CASE WHEN volume <= 8 THEN 0 ELSE volume END AS volume FROM bars)"""
NOBODY = "NULL::VARCHAR"


def faulty(spark, root):
    v = F.col("volume")
    return market.bars(spark, root).drop("vwap").withColumns(
        {"low": F.when(v == 7, -F.col("low")).otherwise(F.col("low")), "volume": F.when(v <= 8, 0).otherwise(v)})


Q_NEG = f"""SELECT 'error' AS level, 'negative_low' AS "check", {NOBODY} AS ticker, n, n || ' rows with negative low prices' AS message
 FROM (SELECT count(*) AS n FROM faulty WHERE low < 0) WHERE n > 0"""
Q_FUTURE = f"""SELECT 'error' AS level, 'future_dates' AS "check", {NOBODY} AS ticker, n, n || ' rows with future dates' AS message
 FROM (SELECT count(*) AS n FROM faulty WHERE date > DATE '2001-06-30') WHERE n > 0"""
Q_GAPS = """SELECT 'warning' AS level, 'date_gaps' AS "check", ticker, n, ticker || ': ' || n || ' large date gaps (>5 days)' AS message
 FROM (SELECT ticker, count(*) AS n FROM (SELECT ticker, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS d FROM faulty)
       WHERE d > 5 GROUP BY ticker)"""
Q_ZERO = """SELECT 'warning' AS level, 'zero_volume' AS "check", ticker, z AS n,
  ticker || ': ' || z || '/' || c || ' (' || CAST(round(100.0::DOUBLE * z / c) AS INTEGER) || '%) days with zero volume' AS message
 FROM (SELECT ticker, count(*) AS c, count(*) FILTER (volume = 0) AS z FROM faulty GROUP BY ticker) WHERE z / c > 0.1"""
Q_MOVES = f"""SELECT 'warning' AS level, 'price_gaps' AS "check", {NOBODY} AS ticker, n, n || ' price gaps > 20% (may indicate splits/gaps)' AS message
 FROM (SELECT count(*) AS n FROM (SELECT abs(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1) AS m FROM faulty WHERE close <> 0)
       WHERE m > 0.2) WHERE n > 0"""
Q_DATES = f"""SELECT 'info' AS level, 'unique_dates' AS "check", {NOBODY} AS ticker, n, 'Unique dates in dataset: ' || n AS message
 FROM (SELECT count(DISTINCT date) AS n FROM faulty)"""
Q_FLAGS = f"""SELECT 'warning' AS level, 'quality_flag' AS "check", {NOBODY} AS ticker, n, 'data_quality=''' || data_quality || ''': ' || n || ' rows' AS message
 FROM (SELECT data_quality, count(*) AS n FROM silver WHERE data_quality <> 'good' GROUP BY data_quality)"""


def _check(name, sql, checks):
    @query(name, ctes(BARS, FAULTS) + " " + sql)
    def run(spark, root, checks=checks):
        return quality.count_checks(faulty(spark, root), checks, today=F.lit(date(2001, 6, 30)))


_check("check_negative_prices", Q_NEG, ["negative_prices"])
_check("check_future_dates", Q_FUTURE, ["future_dates"])
_check("check_date_gaps", Q_GAPS, ["date_gaps"])
_check("check_zero_volume", Q_ZERO, ["zero_volume"])
_check("check_price_moves", Q_MOVES, ["price_gaps"])


@query("check_date_coverage", ctes(BARS, FAULTS) + " " + Q_DATES)
def check_date_coverage(spark, root):
    return quality.date_coverage(faulty(spark, root))


@query("check_quality_flags", LAKE + " " + Q_FLAGS)
def check_quality_flags(spark, root):
    return quality.quality_flags(silver(spark, root))


_SILVER_FAULTS = "faulty AS (SELECT * FROM silver)"


@query(
    "quality_run",
    LAKE + ", " + _SILVER_FAULTS + " " + " UNION ALL ".join((*(Q_NEG.replace("low", c) for c in PX), Q_GAPS, Q_ZERO, Q_MOVES, Q_DATES, Q_FLAGS)),
)
def quality_run(spark, root):
    return quality.run_all_checks(silver(spark, root))


@query(
    "quality_summary",
    ctes(BARS, FAULTS) + f""", all_rows AS ({' UNION ALL '.join((Q_NEG, Q_GAPS, Q_ZERO, Q_MOVES, Q_DATES))})
 SELECT count(*) FILTER (level = 'error') = 0 AS is_valid, count(*) FILTER (level = 'error') AS errors,
        count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (level = 'info') AS infos FROM all_rows""",
)
def quality_summary(spark, root):
    return quality.summary(quality.run_all_checks(faulty(spark, root), "bronze"))
