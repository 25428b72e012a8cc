"""Intraday bars and signals, streams, fills, equity and alerts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickerloom.operators import intraday, ledger, metrics, monitor, signals
from tickerloom.queries.portfolio import MOM, RETURNS, equity as equity_frame, returns, weights
from tickerloom.queries.portfolio import EQUITY, WP
from tickerloom.queries.registry import query, r, rounded
from tickerloom.queries.research import CORE, HORIZONS, avg_rank, ic_sql, long_sql, lean_panel, panel_sql
from tickerloom.queries.signals import FORMULAS
from tickerloom.queries.sql import BARS, ctes, frame, pct, r as sr, rm, rs, rz, stages, z60
from tickerloom.sources import market
from tickerloom.streaming import jobs

OHLC = ("open", "high", "low", "close")
PX = ", ".join(f"{sr(c)} AS {c}" for c in OHLC)
TICKS = """ticks AS (SELECT event_type AS ticker, ts, event_id AS seq, value AS price,
  coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 1) AS volume, user_id FROM events)"""


def tick_bars_sql(bucket: str, name: str) -> str:
    return f"""{name} AS (SELECT ticker, {bucket} AS datetime, arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, row(ts, seq)) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS trade_count FROM ticks GROUP BY ALL)"""


MINUTES = tick_bars_sql("date_trunc('minute', ts)", "minutes")
IN_PX = "arg_min(open, datetime) AS open, max(high) AS high, min(low) AS low, arg_max(close, datetime) AS close, CAST(sum(volume) AS BIGINT) AS volume"


def resample_sql(bucket: str, extra: str = "") -> str:
    return f"rsm AS (SELECT ticker, {bucket} AS datetime, {IN_PX}{extra} FROM minutes GROUP BY ALL)"


def minutes(spark, root):
    return intraday.bars_from_ticks(market.ticks(spark, root))


def _bars_out(df, *extra):
    return rounded(df, *OHLC).select("ticker", "datetime", *OHLC, "volume", *extra)


@query("tick_minute_bars", ctes(TICKS, MINUTES) + f" SELECT ticker, datetime, {PX}, volume, trade_count FROM minutes")
def tick_minute_bars(spark, root):
    return _bars_out(minutes(spark, root), "trade_count")


def _resample_query(name: str, timeframe: str, bucket: str, offset: str | None = None) -> None:
    @query(name, ctes(TICKS, MINUTES, resample_sql(bucket, ", CASE WHEN sum(volume) <> 0 THEN sum(close * volume) / sum(volume) END AS v"))
           + f" SELECT ticker, datetime, {PX}, volume, {sr('v')} AS vwap_raw FROM rsm")
    def run(spark, root):
        return _bars_out(rounded(intraday.resample(minutes(spark, root), timeframe, offset, with_vwap=True), "vwap_raw"), "vwap_raw")


_resample_query("resample_15m", "15m", "time_bucket(INTERVAL '15 minutes', datetime)")
_resample_query("resample_30m", "30m", "time_bucket(INTERVAL '30 minutes', datetime)")
_resample_query("resample_1h", "1h", "date_trunc('hour', datetime)")
HALF_PAST = "date_trunc('hour', datetime - INTERVAL '30 minutes') + INTERVAL '30 minutes'"
_resample_query("resample_half_past", "1h", HALF_PAST, "30 minutes")


@query(
    "completed_hours",
    ctes(TICKS, MINUTES, resample_sql(HALF_PAST), "seen AS (SELECT ticker, max(datetime) AS t FROM minutes GROUP BY ticker)")
    + f" SELECT rsm.ticker, datetime, {PX}, volume FROM rsm JOIN seen ON rsm.ticker = seen.ticker WHERE t >= datetime + INTERVAL '1 hour'",
)
def completed_hours(spark, root):
    m = minutes(spark, root)
    return _bars_out(intraday.completed_only(intraday.resample(m, "1h", "30 minutes"), m, "1h"))


@query("utc_session_filter", ctes(TICKS, MINUTES) + f" SELECT ticker, datetime, {PX}, volume FROM minutes WHERE hour(datetime) BETWEEN 14 AND 20")
def utc_session_filter(spark, root):
    return _bars_out(intraday.utc_session(minutes(spark, root)))


# January has no daylight saving: New York is UTC-5 on every row of the table
NY = "datetime - INTERVAL '5 hours'"


@query(
    "local_session_filter",
    ctes(TICKS, MINUTES) + f" SELECT ticker, datetime, {PX}, volume FROM minutes WHERE hour({NY}) * 60 + minute({NY}) BETWEEN 570 AND 959",
)
def local_session_filter(spark, root):
    return _bars_out(intraday.local_session(minutes(spark, root)))


@query("session_dates", ctes(TICKS, MINUTES) + f" SELECT ticker, datetime, CAST({NY} AS DATE) AS session_date FROM minutes")
def session_dates(spark, root):
    return intraday.with_session_date(minutes(spark, root)).select("ticker", "datetime", "session_date")


@query(
    "minute_dedupe",
    ctes(TICKS) + """ SELECT ticker, date_trunc('minute', ts) AS datetime, arg_min(price, row(ts, seq)) AS price, arg_min(volume, row(ts, seq)) AS volume
 FROM ticks WHERE date_trunc('minute', ts) < TIMESTAMP '2024-01-29 12:30:00' GROUP BY ALL""",
)
def minute_dedupe(spark, root):
    t = market.ticks(spark, root).withColumnRenamed("ts", "datetime")
    out = intraday.minute_dedupe(t, F.lit("2024-01-29 12:30:20").cast("timestamp"))
    return out.select("ticker", "datetime", "price", "volume")


K = "ticker, session_date"
T = "datetime"
SESS = f"sess AS (SELECT *, CAST({NY} AS DATE) AS session_date, (high + low + close) / 3 AS tp FROM minutes)"


def _f(n):
    return frame(n, K, T)


def _rsum(x, n):
    return f"(CASE WHEN count({x}) {_f(n)} >= {n} THEN sum({x}) {_f(n)} END)"


def _lag(x):
    return f"lag({x}) OVER (PARTITION BY {K} ORDER BY {T})"


UPTO = f"OVER (PARTITION BY {K} ORDER BY {T} ROWS UNBOUNDED PRECEDING)"
FEATS = (
    f"""f0 AS (SELECT *, close / nullif({_lag('close')}, 0) - 1 AS bar_return, high - {_lag('high')} AS u, {_lag('low')} - low AS d, {_lag('close')} AS pc,
   {_rsum('tp * volume', 100)} / nullif({_rsum('volume', 100)}, 0) AS rolling_vwap, sum(tp * volume) {UPTO} / nullif(sum(volume) {UPTO}, 0) AS session_vwap,
   volume / nullif({rm('volume', 20, None, K, T)}, 0) AS volume_ratio, row_number() OVER (PARTITION BY {K} ORDER BY {T}) AS session_bar FROM sess)""",
    """f1 AS (SELECT *, CASE WHEN u > d AND u > 0 THEN u WHEN u IS NOT NULL THEN 0 END AS up, CASE WHEN d > u AND d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS dn,
   CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM f0)""",
    f"f2 AS (SELECT *, {rs('bar_return', 20, None, K, T)} AS rolling_vol, {_rsum('up', 14)} / nullif({_rsum('tr', 14)}, 0) AS pdi, {_rsum('dn', 14)} / nullif({_rsum('tr', 14)}, 0) AS mdi FROM f1)",
    "f3 AS (SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dx FROM f2)",
    f"feats AS (SELECT *, {rm('dx', 14, None, K, T)} AS adx FROM f3)",
)
FEAT_COLS = ("bar_return", "rolling_vol", "rolling_vwap", "session_vwap", "volume_ratio", "adx")


@query(
    "intraday_features",
    ctes(TICKS, MINUTES, SESS, *FEATS) + f" SELECT ticker, datetime, session_date, {', '.join(f'{sr(c, 4)} AS {c}' for c in FEAT_COLS)}, CAST(session_bar AS INTEGER) AS session_bar FROM feats",
)
def intraday_features(spark, root):
    out = intraday.intraday_features(minutes(spark, root))
    return rounded(out, *FEAT_COLS, digits=4).select("ticker", "datetime", "session_date", *FEAT_COLS, "session_bar")


def _tsum(x, n):
    f = frame(n, "ticker", T)
    return f"(CASE WHEN count({x}) {f} >= {n} THEN sum({x}) {f} END)"


VWAP_MR = (
    f"v0 AS (SELECT *, close / nullif({_tsum('close * volume', 60)} / nullif({_tsum('volume', 60)}, 0), 0) - 1 AS dev FROM minutes)",
    f"v1 AS (SELECT ticker, datetime, -tanh({rz('dev', 60, 30, 'ticker', T)}) AS s FROM v0)",
)


@query("signal_vwap_mean_reversion", ctes(TICKS, MINUTES, *VWAP_MR) + f" SELECT ticker, datetime, {sr('s')} AS signal_vwap_mean_reversion_60b FROM v1")
def signal_vwap_mean_reversion(spark, root):
    s = "signal_vwap_mean_reversion_60b"
    return intraday.vwap_mean_reversion(minutes(spark, root)).select("ticker", "datetime", r(s).alias(s))


FILTERED_SQL = (f"f0 AS (SELECT *, high - {_lag('high')} AS u, {_lag('low')} - low AS d, {_lag('close')} AS pc, volume / nullif({rm('volume', 20, None, K, T)}, 0) AS volume_ratio FROM sess)",
                FEATS[1], f"f2 AS (SELECT *, {_rsum('up', 14)} / nullif({_rsum('tr', 14)}, 0) AS pdi, {_rsum('dn', 14)} / nullif({_rsum('tr', 14)}, 0) AS mdi FROM f1)", FEATS[3], FEATS[4],
                "flt AS (SELECT f.ticker, f.datetime, CASE WHEN s IS NOT NULL THEN CASE WHEN coalesce(adx, 0) <= 25 AND volume_ratio >= 0.5 THEN s ELSE 0.0 END END AS s FROM feats f JOIN v1 ON v1.ticker = f.ticker AND v1.datetime = f.datetime)")


@query("signal_vwap_mean_reversion_filtered", ctes(TICKS, MINUTES, *VWAP_MR, SESS, *FILTERED_SQL) + f" SELECT ticker, datetime, {sr('s')} AS signal_vwap_mean_reversion_filtered FROM flt")
def signal_vwap_filtered(spark, root):
    s = "signal_vwap_mean_reversion_filtered"
    return intraday.vwap_mean_reversion_filtered(minutes(spark, root)).select("ticker", "datetime", r(s).alias(s))


@query(
    "actionable_signal",
    ctes(TICKS, MINUTES, *VWAP_MR) + f" SELECT ticker, datetime, {sr('CASE WHEN abs(coalesce(s, 0)) < 0.3 THEN 0 ELSE s END')} AS signal_vwap_mean_reversion_60b FROM v1",
)
def actionable_signal(spark, root):
    s = "signal_vwap_mean_reversion_60b"
    return intraday.actionable(intraday.vwap_mean_reversion(minutes(spark, root)), s).select("ticker", "datetime", r(s).alias(s))


@query(
    "signal_vwap_bands",
    ctes(TICKS, MINUTES, SESS, f"b0 AS (SELECT *, sum(close * volume) {UPTO} / nullif(sum(volume) {UPTO}, 0) AS vwap FROM sess)",
         f"b1 AS (SELECT *, stddev_samp(close - vwap) {UPTO} AS sd FROM b0)", "b2 AS (SELECT *, (vwap - close) / nullif(2 * sd, 0) AS s FROM b1)")
    + f""" SELECT ticker, datetime, {sr('vwap')} AS vwap, {sr('vwap + 2 * sd')} AS upper_band, {sr('vwap - 2 * sd')} AS lower_band,
 {sr('CASE WHEN s IS NOT NULL THEN greatest(-1, least(1, s)) END')} AS signal_vwap_bands FROM b2""",
)
def signal_vwap_bands(spark, root):
    cols = ("vwap", "upper_band", "lower_band", "signal_vwap_bands")
    return rounded(intraday.vwap_bands(minutes(spark, root)), *cols).select("ticker", "datetime", *cols)


DAY = f"OVER (PARTITION BY {K})"


@query(
    "signal_opening_range_breakout",
    ctes(TICKS, MINUTES, SESS, f"r0 AS (SELECT *, datetime < min(datetime) {DAY} + INTERVAL '240 minutes' AS o FROM sess)",
         f"r1 AS (SELECT *, max(high) FILTER (o) {DAY} AS range_high, min(low) FILTER (o) {DAY} AS range_low FROM r0)")
    + f""" SELECT ticker, datetime, {sr('range_high')} AS range_high, {sr('range_low')} AS range_low,
 (CASE WHEN NOT o THEN CASE WHEN close > range_high THEN 1.0 WHEN close < range_low THEN -1.0 ELSE 0.0 END END)::DOUBLE AS signal_opening_range_breakout FROM r1""",
)
def signal_opening_range(spark, root):
    out = rounded(intraday.opening_range_breakout(minutes(spark, root), 240), "range_high", "range_low")
    return out.select("ticker", "datetime", "range_high", "range_low", "signal_opening_range_breakout")


PARTS = {"vwap_mean_reversion_60b": "v1.s", "vwap_bands": "CASE WHEN b2.s IS NOT NULL THEN greatest(-1, least(1, b2.s)) END",
         "opening_range_breakout": "CASE WHEN NOT o THEN CASE WHEN r1.close > range_high THEN 1.0 WHEN r1.close < range_low THEN -1.0 ELSE 0.0 END END"}
INTRADAY_COMBOS = {
    "vwap_mr_bands": ("vwap_mean_reversion_60b", "vwap_bands"),
    "vwap_mr_orb": ("vwap_mean_reversion_60b", "opening_range_breakout"),
    "vwap_bands_orb": ("vwap_bands", "opening_range_breakout"),
    "all_three": tuple(PARTS),
}


@query(
    "signal_intraday_combos",
    ctes(TICKS, MINUTES, *VWAP_MR, SESS, f"b0 AS (SELECT *, sum(close * volume) {UPTO} / nullif(sum(volume) {UPTO}, 0) AS vwap FROM sess)",
         f"b1 AS (SELECT *, stddev_samp(close - vwap) {UPTO} AS sd FROM b0)", "b2 AS (SELECT *, (vwap - close) / nullif(2 * sd, 0) AS s FROM b1)",
         f"r0 AS (SELECT *, datetime < min(datetime) {DAY} + INTERVAL '240 minutes' AS o FROM sess)",
         f"r1 AS (SELECT *, max(high) FILTER (o) {DAY} AS range_high, min(low) FILTER (o) {DAY} AS range_low FROM r0)")
    + " SELECT v1.ticker, v1.datetime, " + ", ".join(
        f"{sr('(' + ' + '.join(f'({PARTS[p]})' for p in parts) + f') / {len(parts)}')} AS signal_{n}" for n, parts in INTRADAY_COMBOS.items())
    + " FROM v1 JOIN b2 ON b2.ticker = v1.ticker AND b2.datetime = v1.datetime JOIN r1 ON r1.ticker = v1.ticker AND r1.datetime = v1.datetime",
)
def signal_intraday_combos(spark, root):
    """Equal-weight means of two or three of the intraday signals."""
    df = intraday.opening_range_breakout(intraday.vwap_bands(intraday.vwap_mean_reversion(minutes(spark, root))), 240)
    for name, parts in INTRADAY_COMBOS.items():
        df = signals.combo(df, parts, name)
    return df.select("ticker", "datetime", *[r(f"signal_{n}").alias(f"signal_{n}") for n in INTRADAY_COMBOS])


TOD = "OVER (PARTITION BY ticker, hour(datetime) ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "signal_time_of_day",
    ctes(TICKS, MINUTES, f"q AS (SELECT *, {pct('close', 1, 'ticker', T)} AS x FROM minutes)")
    + f" SELECT ticker, datetime, {sr(f'CASE WHEN count(x) {TOD} >= 5 THEN tanh(avg(x) {TOD} / nullif(stddev_samp(x) {TOD}, 0)) END')} AS signal_time_of_day FROM q",
)
def signal_time_of_day(spark, root):
    return intraday.time_of_day(minutes(spark, root)).select("ticker", "datetime", r("signal_time_of_day").alias("signal_time_of_day"))


@query(
    "trading_calendar",
    ctes(BARS) + """, d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM bars),
 t AS (SELECT date FROM d WHERE isodow(date) < 6 AND strftime(date, '%m-%d') NOT IN ('01-01', '07-04', '12-25'))
 SELECT t.date, count(DISTINCT bars.ticker) AS tickers FROM t LEFT JOIN bars ON bars.date = t.date GROUP BY t.date""",
)
def trading_calendar(spark, root):
    b = market.bars(spark, root).select("ticker", "date")
    lo, hi = b.agg(F.min("date"), F.max("date")).first()
    return intraday.trading_days(spark, lo, hi).join(b, "date", "left").groupBy("date").agg(F.countDistinct("ticker").alias("tickers"))


@query(
    "last_trading_days",
    ctes(BARS) + """ SELECT date, count(DISTINCT ticker) AS tickers FROM bars WHERE date IN (
  SELECT date FROM (SELECT CAST(unnest(generate_series(DATE '2001-01-01', DATE '2001-10-31', INTERVAL 1 DAY)) AS DATE) AS date)
  WHERE isodow(date) < 6 AND strftime(date, '%m-%d') NOT IN ('01-01', '07-04', '12-25') ORDER BY date DESC LIMIT 20) GROUP BY date""",
)
def last_trading_days(spark, root):
    days = intraday.last_trading_days(spark, date(2001, 10, 31), 20)
    return market.bars(spark, root).join(F.broadcast(days), "date").groupBy("date").agg(F.countDistinct("ticker").alias("tickers"))


# ── IC over ticker × timeframe × signal × horizon ──
FRAMES = {"15m": "time_bucket(INTERVAL '15 minutes', datetime)", "30m": "time_bucket(INTERVAL '30 minutes', datetime)",
          "1h": "date_trunc('hour', datetime)"}
GRID = ("roc", "volume_momentum", "hurst", "relative_volume", "cross_asset_momentum", "order_flow", "macd")
GRID_HORIZONS = (5, 20)


def grid_long(spark, root):
    """Scores are rounded to nine digits, so that equal ones are ties whatever the order of a sum."""
    out = None
    for tf, b in intraday.bar_ladder(minutes(spark, root), list(FRAMES)).items():
        s = signals.generate(signals.with_forward_returns(b, GRID_HORIZONS, ts="datetime"), GRID, ts="datetime")
        s = s.withColumns({f"signal_{g}": r(f"signal_{g}", 9) for g in GRID})
        long = metrics.to_long(s, [f"signal_{g}" for g in GRID], GRID_HORIZONS, ["ticker"]).withColumn("timeframe", F.lit(tf))
        out = long if out is None else out.unionByName(long)
    return out


def grid_sql() -> tuple[str, ...]:
    parts, cells = [], []
    for tf, bucket in FRAMES.items():
        ahead = ", ".join(f"lead(close, {h}) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1 AS f{h}" for h in GRID_HORIZONS)
        parts += [f"g{tf}0 AS (SELECT ticker, {bucket} AS date, {IN_PX} FROM minutes GROUP BY ALL)", f"g{tf} AS (SELECT *, {ahead} FROM g{tf}0)"]
        for g in GRID:
            steps, score = FORMULAS[g]
            text, last = stages(f"g{tf}", *steps, {"s": score})
            for i in range(len(steps) + 1):
                text = text.replace(f"t{i} AS (", f"{g}{tf}_{i} AS (").replace(f"FROM t{i})", f"FROM {g}{tf}_{i})")
            parts.append(text)
            cells += [f"SELECT ticker, '{tf}' AS timeframe, 'signal_{g}' AS signal, {h} AS horizon, {sr('s', 9)} AS s, f{h} AS f FROM {g}{tf}_{len(steps)}"
                      for h in GRID_HORIZONS]
    return (TICKS, MINUTES, *parts, f"long AS (SELECT * FROM ({' UNION ALL '.join(cells)}) WHERE s IS NOT NULL AND f IS NOT NULL)",
            ic_sql("ticker, timeframe, signal, horizon", 100))


@query("ic_matrix", ctes(*grid_sql()) + f" SELECT ticker, timeframe, signal, horizon, {sr('ic')} AS ic, {sr('win_rate')} AS win_rate, n_obs FROM ic")
def ic_matrix(spark, root):
    return rounded(metrics.ic_matrix(grid_long(spark, root)), "ic", "win_rate")


@query(
    "ic_ranking",
    ctes(*grid_sql(), "ag AS (SELECT signal, avg(ic) AS m, min(ic) AS lo, max(ic) AS hi, count(*) AS cells FROM ic WHERE ic IS NOT NULL GROUP BY signal)")
    + f" SELECT signal, {sr('m')} AS mean_ic, {sr('lo')} AS min_ic, {sr('hi')} AS max_ic, cells, CAST(row_number() OVER (ORDER BY m DESC, signal) AS INTEGER) AS place FROM ag",
)
def ic_ranking(spark, root):
    return rounded(metrics.ic_ranking(metrics.ic_matrix(grid_long(spark, root))), "mean_ic", "min_ic", "max_ic")


# ── streams ──
def tick_stream(spark, root):
    raw = jobs.file_stream(spark, f"{root}/events.parquet", market.table(spark, root, "events"))
    return raw.select(
        F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(1)).alias("volume"), "user_id")


CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) FROM ticks)"


@query(
    "stream_tick_bars",
    ctes(TICKS, MINUTES) + f" SELECT ticker, datetime, {PX}, volume, trade_count FROM minutes WHERE datetime + INTERVAL '1 minute' <= {CLOSED}",
)
def stream_tick_bars(spark, root):
    folder, _ = jobs.drain(jobs.tick_bars(tick_stream(spark, root)), "tick-bars")
    return _bars_out(spark.read.parquet(folder), "trade_count")


@query(
    "stream_hour_bars",
    ctes(TICKS, "minutes AS (SELECT ticker, ts AS datetime, price AS open, price AS high, price AS low, price AS close, volume FROM ticks)", resample_sql(HALF_PAST))
    + f" SELECT ticker, datetime, {PX}, volume FROM rsm WHERE datetime + INTERVAL '1 hour' <= {CLOSED}",
)
def stream_hour_bars(spark, root):
    t = tick_stream(spark, root)
    m = t.select("ticker", F.col("ts").alias("datetime"), *[F.col("price").alias(c) for c in OHLC], "volume")
    folder, _ = jobs.drain(jobs.hour_bars(m), "hour-bars")
    return _bars_out(spark.read.parquet(folder))


@query("stream_minute_dedupe", ctes(TICKS) + " SELECT DISTINCT ticker, date_trunc('minute', ts) AS minute FROM ticks")
def stream_minute_dedupe(spark, root):
    folder, _ = jobs.drain(jobs.minute_keys(tick_stream(spark, root)), "minute-dedupe")
    return spark.read.parquet(folder).select("ticker", "minute")


@query(
    "stream_force_close",
    ctes(TICKS, MINUTES) + f" SELECT ticker, datetime, {PX}, volume FROM minutes WHERE datetime + INTERVAL '1 minute' > {CLOSED}",
)
def stream_force_close(spark, root):
    folder, _ = jobs.drain(jobs.tick_bars(tick_stream(spark, root)), "tick-bars")
    return _bars_out(jobs.force_close(market.ticks(spark, root), spark.read.parquet(folder)))


def _fill_stream(t):
    # every fill is sent twice
    doubled = t.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return doubled.select(F.col("seq").alias("fill_id"), "ts", "ticker", F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"),
                          F.col("volume").cast("double").alias("shares"), "price")


@query(
    "stream_fill_metrics",
    ctes(TICKS) + f""" SELECT ticker, count(*) AS n_fills, {sr('sum(volume)')} AS shares, {sr('sum(CASE WHEN user_id % 2 = 0 THEN -volume * price ELSE volume * price END)', 3)} AS cash_flow FROM ticks GROUP BY ticker""",
)
def stream_fill_metrics(spark, root):
    folder = jobs.work_folder(spark, "fill-metrics-table")
    jobs.drain(jobs.fill_metrics(_fill_stream(tick_stream(spark, root))), "fill-metrics", "complete", jobs.snapshot_batch(folder))
    return spark.read.parquet(folder).select("ticker", "n_fills", r("shares").alias("shares"), r("cash_flow", 3).alias("cash_flow"))


@query(
    "stream_late_ticks",
    ctes(TICKS, MINUTES) + f" SELECT count(*) AS bars, CAST(0 AS BIGINT) AS late_rows FROM minutes WHERE datetime + INTERVAL '1 minute' <= {CLOSED} - INTERVAL '1 hour'",
)
def stream_late_ticks(spark, root):
    """Bars and late rows with a one-hour delay."""
    folder, late = jobs.drain(jobs.tick_bars(tick_stream(spark, root), delay="1 hour"), "late-ticks")
    return spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("bars")).withColumn("late_rows", F.lit(late).cast("long"))


def _score(df):
    return intraday.vwap_mean_reversion(df)


TICK_MR = (
    f"w0 AS (SELECT ticker, ts AS datetime, price AS close, volume, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS seen, price / nullif({_tsum('price * volume', 60).replace('datetime', 'ts')} / nullif({_tsum('volume', 60).replace('datetime', 'ts')}, 0), 0) - 1 AS dev FROM ticks)",
    f"w1 AS (SELECT *, -tanh({rz('dev', 60, 30, 'ticker', T)}) AS s FROM w0)",
)


@query(
    "stream_warm_scores",
    ctes(TICKS, *TICK_MR) + f" SELECT ticker, datetime, {sr('CASE WHEN seen >= 60 THEN coalesce(s, 0) ELSE 0 END')} AS signal_vwap_mean_reversion_60b FROM w1",
)
def stream_warm_scores(spark, root):
    folder = jobs.work_folder(spark, "warm-scores")
    t = tick_stream(spark, root)
    bars = t.select("ticker", F.col("ts").alias("datetime"), F.col("price").alias("close"), "volume")
    s = "signal_vwap_mean_reversion_60b"
    jobs.drain(bars, "warm-scores-run", "append", jobs.scoring_batch(folder, _score, s))
    return rounded(spark.read.parquet(f"{folder}/batch=*"), s).select("ticker", "datetime", s)


def _alerts(t):
    return t.filter(F.col("price") > 150).select(F.col("ticker").alias("alert_type"), "ts", F.col("seq").alias("alert_id"), F.col("price").alias("value"))


COOL = """al AS (SELECT ticker AS alert_type, ts, seq AS alert_id, price AS value FROM ticks WHERE price > 150),
ord AS (SELECT *, row_number() OVER (PARTITION BY alert_type ORDER BY ts, alert_id) AS n FROM al),
keep AS (SELECT alert_type, ts, alert_id, value, n, ts AS last_ts, TRUE AS kept FROM ord WHERE n = 1
  UNION ALL SELECT o.alert_type, o.ts, o.alert_id, o.value, o.n, CASE WHEN o.ts - k.last_ts >= INTERVAL '6 hours' THEN o.ts ELSE k.last_ts END,
    o.ts - k.last_ts >= INTERVAL '6 hours' FROM keep k JOIN ord o ON o.alert_type = k.alert_type AND o.n = k.n + 1)"""


COOL_SQL = ctes(TICKS, COOL).replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT alert_type, ts, alert_id, value FROM keep WHERE kept"


@query("stream_alert_cooldown", COOL_SQL)
def stream_alert_cooldown(spark, root):
    folder, _ = jobs.drain(jobs.alert_cooldown(_alerts(tick_stream(spark, root)), 6 * 3600), "cooldown")
    return spark.read.parquet(folder)


@query("alert_cooldown", COOL_SQL)
def alert_cooldown(spark, root):
    return monitor.cooldown(_alerts(market.ticks(spark, root)), 6 * 3600).select("alert_type", "ts", "alert_id", "value")


# ── fills and positions ──
FILLS = """fills AS (SELECT c_mktsegment AS account, 'S' || CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
  row(l_orderkey, l_linenumber, l_extendedprice) AS seq, CASE WHEN l_linenumber IN (2, 4, 6) OR l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  l_quantity AS shares, l_extendedprice / l_quantity AS price, l_quantity * 0.005::DOUBLE AS commission
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
# the entry price as an ordered fold over each key's whole list of fills
LEDGER = """fl AS (SELECT *, CASE WHEN side = 'BUY' THEN shares ELSE -shares END AS q,
  sum(CASE WHEN side = 'BUY' THEN shares ELSE -shares END) OVER w AS after, sum((CASE WHEN side = 'BUY' THEN -shares ELSE shares END) * price - commission) OVER w AS cash_flow,
  row_number() OVER w AS n FROM fills WINDOW w AS (PARTITION BY account, ticker ORDER BY date, seq)),
ab AS (SELECT *, after - q AS before, CASE WHEN after = 0 THEN 0.0 WHEN after - q = 0 OR sign(after - q) <> sign(after) THEN 0.0 WHEN after - q > 0 AND q > 0 THEN (after - q) / after ELSE 1.0 END AS a,
  CASE WHEN after = 0 THEN 0.0 WHEN after - q = 0 OR sign(after - q) <> sign(after) THEN price WHEN after - q > 0 AND q > 0 THEN price * shares / after ELSE 0.0 END AS b FROM fl),
en AS (SELECT *, list_reduce(list_prepend({'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE}, list({'a': a::DOUBLE, 'b': b::DOUBLE}) OVER (PARTITION BY account, ticker ORDER BY n)),
   lambda x, y: {'a': 0.0::DOUBLE, 'b': y.a * x.b + y.b}).b AS entry FROM ab),
pv AS (SELECT *, coalesce(lag(entry) OVER (PARTITION BY account, ticker ORDER BY n), 0) AS prev FROM en),
ledger AS (SELECT *, CASE WHEN after <> 0 THEN entry END AS avg_cost, CASE WHEN before * q < 0 THEN least(abs(before), shares) * (price - prev) * sign(before) ELSE 0.0 END AS realized_pnl FROM pv)"""


def position_ledger(spark, root):
    return ledger.position_ledger(market.fills(spark, root))


@query(
    "position_ledger",
    ctes(FILLS, LEDGER) + f""" SELECT account, ticker, date, CAST(seq[1] AS BIGINT) AS order_key, side, shares, {sr('price')} AS price, after AS quantity, {sr('avg_cost', 4)} AS avg_cost,
 {sr('realized_pnl', 3)} AS realized_pnl, {sr('cash_flow', 2)} AS cash_flow FROM ledger""",
)
def position_ledger_query(spark, root):
    out = position_ledger(spark, root)
    return out.select("account", "ticker", "date", F.col("seq.orderkey").alias("order_key"), "side", "shares", r("price").alias("price"), "quantity",
                      r("avg_cost", 4).alias("avg_cost"), r("realized_pnl", 3).alias("realized_pnl"), r("cash_flow", 2).alias("cash_flow"))


@query(
    "closing_positions",
    ctes(FILLS, LEDGER) + f""" SELECT account, ticker, arg_max(after, n) AS quantity, {sr('(SELECT l2.avg_cost FROM ledger l2 WHERE l2.account = l.account AND l2.ticker = l.ticker ORDER BY n DESC LIMIT 1)', 4)} AS avg_cost,
 {sr('arg_max(cash_flow, n)', 2)} AS cash_flow, {sr('sum(realized_pnl)', 3)} AS realized_pnl FROM ledger l GROUP BY account, ticker""",
)
def closing_positions(spark, root):
    out = ledger.closing_positions(position_ledger(spark, root))
    return out.select("account", "ticker", "quantity", r("avg_cost", 4).alias("avg_cost"), r("cash_flow", 2).alias("cash_flow"), r("realized_pnl", 3).alias("realized_pnl"))


@query(
    "order_fills",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, side, status, {sr('fill')} AS fill_price, {sr('CASE WHEN fill IS NOT NULL THEN q * 0.005 END')} AS commission FROM (
 SELECT *, CASE WHEN lim IS NULL OR (side = 'BUY' AND p <= lim) OR (side = 'SELL' AND p >= lim) THEN 'FILLED' ELSE 'PENDING' END AS status,
  CASE WHEN lim IS NULL THEN p * CASE WHEN side = 'BUY' THEN 1 + 5.0 / 10000 ELSE 1 - 5.0 / 10000 END WHEN side = 'BUY' AND p <= lim THEN p WHEN side = 'SELL' AND p >= lim THEN p END AS fill
 FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_extendedprice / l_quantity AS p, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
   CASE WHEN l_linestatus = 'O' THEN 2000 + l_discount * 10000 END AS lim FROM lineitem))""",
)
def order_fills(spark, root):
    o = market.table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.when(F.col("l_linestatus") == "O", 2000 + F.col("l_discount") * 10000).alias("limit_price"))
    return rounded(ledger.fill_orders(o), "fill_price", "commission").select("l_orderkey", "l_linenumber", "l_partkey", "side", "status", "fill_price", "commission")


VALUE = """pd AS (SELECT account, ticker, date, arg_max(after, n) AS q, arg_max(cash_flow, n) AS c FROM ledger GROUP BY ALL),
gr AS (SELECT d.account, d.date, t.ticker FROM (SELECT DISTINCT account, date FROM fills) d JOIN (SELECT DISTINCT account, ticker FROM fills) t ON d.account = t.account),
gp AS (SELECT g.account, g.date, g.ticker, b.close AS p FROM gr g ASOF LEFT JOIN bars b ON b.ticker = g.ticker AND g.date >= b.date),
kn AS (SELECT g.account, g.date, last_value(q IGNORE NULLS) OVER w AS q, last_value(c IGNORE NULLS) OVER w AS c, p
  FROM gp g LEFT JOIN pd ON pd.account = g.account AND pd.ticker = g.ticker AND pd.date = g.date WINDOW w AS (PARTITION BY g.account, g.ticker ORDER BY g.date)),
av AS (SELECT account, date, 1e8 + sum(coalesce(c, 0)) AS cash, sum(coalesce(q * p, 0)) AS positions_value FROM kn GROUP BY ALL),
acct AS (SELECT *, cash + positions_value AS portfolio_value, cash + positions_value - lag(cash + positions_value, 1, 1e8) OVER (PARTITION BY account ORDER BY date) AS daily_pnl FROM av)"""
MONEY = ("cash", "positions_value", "portfolio_value", "daily_pnl")


def account_value(spark, root):
    return ledger.account_value(ledger.daily_flows(market.fills(spark, root)), market.bars(spark, root).select("ticker", "date", "close"), 1e8)


@query("account_value", ctes(BARS, FILLS, LEDGER, VALUE) + f" SELECT account, date, {', '.join(f'{sr(c, 1)} AS {c}' for c in MONEY)} FROM acct")
def account_value_query(spark, root):
    return rounded(account_value(spark, root), *MONEY, digits=1)


# ── backtest and equity metrics ──
BT = """bt AS (SELECT b.ticker, b.date, coalesce(w.weight, 0) AS weight, coalesce(lag(coalesce(w.weight, 0)) OVER x, 0) AS held, coalesce(b.close / lag(b.close) OVER x - 1, 0) AS ret
  FROM bars b LEFT JOIN wcap w ON w.ticker = b.ticker AND w.date = b.date WINDOW x AS (PARTITION BY b.ticker ORDER BY b.date)),
bd AS (SELECT date, sum(held * ret) AS g, sum(abs(weight - held)) AS turnover, count(*) FILTER (weight <> 0) AS num_positions, count(*) FILTER (abs(weight - held) > 0) AS orders_today FROM bt GROUP BY date),
bn AS (SELECT *, greatest(g - turnover * 6.0 / 10000, -0.99) AS period_return FROM bd),
curve AS (SELECT *, 100000 * exp(sum(ln(1 + period_return)) OVER (ORDER BY date)) AS portfolio_value FROM bn)"""
WCAP = "wcap AS (SELECT ticker, date, weight / 500 AS weight FROM wts)"


def curve(spark, root):
    w = weights(spark, root).withColumn("weight", F.col("weight") / 500)
    return ledger.backtest(market.bars(spark, root), w)


@query(
    "backtest_equity",
    ctes(*WP, WCAP, BT) + f""" SELECT date, {sr('portfolio_value', 3)} AS portfolio_value, {sr('portfolio_value - lag(portfolio_value, 1, 100000) OVER (ORDER BY date)', 3)} AS daily_pnl,
 {sr('period_return')} AS period_return, {sr('turnover')} AS turnover, num_positions, orders_today FROM curve""",
)
def backtest_equity(spark, root):
    return rounded(rounded(curve(spark, root), "portfolio_value", "daily_pnl", digits=3), "period_return", "turnover")


EM = ("final_value", "win_rate", "sharpe", "max_drawdown", "total_return", "total_pnl")


@query(
    "equity_metrics",
    ctes(*WP, WCAP, BT, "em AS (SELECT date, portfolio_value AS v, portfolio_value / nullif(lag(portfolio_value) OVER (ORDER BY date), 0) - 1 AS x, max(portfolio_value) OVER (ORDER BY date) AS pk FROM curve)")
    + f""" SELECT {sr('arg_max(v, date)', 3)} AS final_value, {sr('count(*) FILTER (x > 0) / count(x) * 100', 3)} AS win_rate, {sr('avg(x) / stddev_samp(x) * sqrt(252.0)', 3)} AS sharpe,
 {sr('min((v - pk) / pk) * 100', 3)} AS max_drawdown, count(*) AS num_bars, {sr('(arg_max(v, date) - 100000) / 1000', 3)} AS total_return, {sr('arg_max(v, date) - 100000', 3)} AS total_pnl FROM em""",
)
def equity_metrics(spark, root):
    return rounded(ledger.equity_metrics(curve(spark, root), 100_000.0), *EM, digits=3)


# entries: every minute bar with a strong signal, trade of one share until first touch
ENTRIES = f"""sb AS (SELECT *, CAST({NY} AS DATE) AS session_date, row_number() OVER (PARTITION BY ticker ORDER BY datetime) AS rn FROM minutes),
entr AS (SELECT ticker || '-' || rn AS entry_id, ticker, session_date, datetime, close AS entry_price, CASE WHEN close <= open AND rn % 2 = 0 THEN 1 ELSE -1 END AS direction FROM sb),
jn AS (SELECT e.entry_id, b.datetime AS t, b.close AS px, (b.close / e.entry_price - 1) * direction AS m FROM entr e JOIN sb b ON b.ticker = e.ticker AND b.session_date = e.session_date AND b.datetime > e.datetime WHERE e.entry_price > 0),
hits AS (SELECT *, CASE WHEN m <= -0.5 THEN 'stop_loss' WHEN m >= 0.75 THEN 'take_profit' END AS h FROM jn),
ex AS (SELECT entry_id, coalesce(arg_min(h, t) FILTER (h IS NOT NULL), 'session_end') AS exit_reason, coalesce(min(t) FILTER (h IS NOT NULL), max(t)) AS exit_time,
  coalesce(arg_min(px, t) FILTER (h IS NOT NULL), arg_max(px, t)) AS exit_price, coalesce(arg_min(m, t) FILTER (h IS NOT NULL), arg_max(m, t)) AS trade_return FROM hits GROUP BY entry_id)"""


def entries_and_bars(spark, root):
    b = intraday.with_session_date(minutes(spark, root)).withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy("datetime")))
    d = F.when((F.col("close") <= F.col("open")) & (F.col("rn") % 2 == 0), 1).otherwise(-1)
    e = b.filter(F.col("close") > 0).select(F.concat_ws("-", "ticker", F.col("rn").cast("string")).alias("entry_id"), "ticker", "session_date", "datetime", F.col("close").alias("entry_price"), d.alias("direction"))
    return e, b


@query("first_touch_exits", ctes(TICKS, MINUTES, ENTRIES) + f" SELECT entry_id, exit_reason, exit_time, {sr('exit_price')} AS exit_price, {sr('trade_return')} AS trade_return FROM ex")
def first_touch_exits(spark, root):
    e, b = entries_and_bars(spark, root)
    return rounded(ledger.label_exits(e, b, 0.5, 0.75), "exit_price", "trade_return")


TRADES_SQL = "trd AS (SELECT e.session_date, ex.trade_return * e.entry_price AS pnl, 0.01::DOUBLE AS commission FROM ex JOIN entr e ON e.entry_id = ex.entry_id)"
TM = f"""tm AS (SELECT session_date, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades, sum(pnl) AS total_pnl,
  coalesce(count(*) FILTER (pnl > 0) / nullif(count(*) FILTER (pnl > 0) + count(*) FILTER (pnl < 0), 0) * 100, 0) AS win_rate_pct,
  coalesce(sum(pnl) / nullif(count(*) FILTER (pnl > 0) + count(*) FILTER (pnl < 0), 0), 0) AS avg_trade_pnl,
  sum(pnl) FILTER (pnl > 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0) AS profit_factor, sum(commission) AS total_commissions FROM trd GROUP BY session_date)"""


def trades_table(spark, root):
    e, b = entries_and_bars(spark, root)
    exits = ledger.label_exits(e, b, 0.5, 0.75)
    return exits.join(e.select("entry_id", "session_date", "entry_price"), "entry_id").select(
        "session_date", (F.col("trade_return") * F.col("entry_price")).alias("pnl"), F.lit(0.01).alias("commission"))


TMC = ("win_rate_pct", "total_pnl", "avg_trade_pnl", "profit_factor", "total_commissions")


@query("trade_metrics", ctes(TICKS, MINUTES, ENTRIES, TRADES_SQL, TM) + f" SELECT session_date, total_trades, winning_trades, losing_trades, {', '.join(f'{sr(c, 4)} AS {c}' for c in TMC)} FROM tm")
def trade_metrics(spark, root):
    return rounded(ledger.trade_metrics(trades_table(spark, root)), *TMC, digits=4)


SESSION_ROW = "total_pnl / 1000 AS total_return_pct, avg_trade_pnl / 10 AS sharpe_ratio, -total_pnl / 500 AS max_drawdown_pct"


@query(
    "session_aggregate",
    ctes(TICKS, MINUTES, ENTRIES, TRADES_SQL, TM, f"sx AS (SELECT *, {SESSION_ROW} FROM tm)")
    + f""" SELECT count(*) AS total_sessions, {sr('sum(total_pnl)', 3)} AS total_pnl, CAST(sum(total_trades) AS BIGINT) AS total_trades, CAST(sum(winning_trades) AS BIGINT) AS winning_trades, CAST(sum(losing_trades) AS BIGINT) AS losing_trades,
 {sr('sum(winning_trades) / (sum(winning_trades) + sum(losing_trades)) * 100', 4)} AS win_rate_pct, {sr('avg(total_return_pct)')} AS avg_session_return_pct, {sr('avg(sharpe_ratio)')} AS avg_sharpe_ratio, {sr('max(abs(max_drawdown_pct))', 4)} AS max_drawdown_pct FROM sx""",
)
def session_aggregate(spark, root):
    s = ledger.trade_metrics(trades_table(spark, root)).withColumns(
        {"total_return_pct": F.col("total_pnl") / 1000, "sharpe_ratio": F.col("avg_trade_pnl") / 10, "max_drawdown_pct": -F.col("total_pnl") / 500})
    out = rounded(ledger.aggregate_sessions(s), "avg_session_return_pct", "avg_sharpe_ratio")
    return rounded(out, "win_rate_pct", "max_drawdown_pct", digits=4).withColumn("total_pnl", r("total_pnl", 3))


# ── monitoring ──
SUMMARY = """s0 AS (SELECT account, date, portfolio_value AS balance, coalesce(lag(portfolio_value) OVER w, 1e8) AS st FROM acct WINDOW w AS (PARTITION BY account ORDER BY date)),
s1 AS (SELECT *, balance / st - 1 AS x FROM s0),
s2 AS (SELECT *, count(*) FILTER (x > 0) OVER w AS nw, count(*) FILTER (x < 0) OVER w AS nl, greatest(max(balance) OVER w, 1e8) AS pk, avg(x) OVER w AS mx, stddev_samp(x) OVER w AS sx, count(x) OVER w AS nx
  FROM s1 WINDOW w AS (PARTITION BY account ORDER BY date)),
s3 AS (SELECT *, (pk - balance) / pk AS dd FROM s2),
summary AS (SELECT account, date, nw AS num_wins, nl AS num_losses, round(balance / st - 1, 4) AS daily_return, coalesce(round(nw / nullif(nw + nl, 0), 4), 0) AS win_rate, round(dd, 4) AS current_drawdown,
  round(max(dd) OVER (PARTITION BY account ORDER BY date), 4) AS max_drawdown, round(coalesce(CASE WHEN nx >= 2 THEN mx / nullif(sx, 0) * sqrt(252.0) END, 0), 3) AS sharpe_ratio FROM s3)"""
SUM_COLS = ("daily_return", "win_rate", "current_drawdown", "max_drawdown", "sharpe_ratio")
ACCT = (BARS, FILLS, LEDGER, VALUE, SUMMARY)


def summary(spark, root):
    b = account_value(spark, root).select("account", "date", F.col("portfolio_value").alias("balance"), F.lit(1e8).alias("start_balance"))
    return monitor.daily_summary(b)


@query("daily_summary", ctes(*ACCT) + f" SELECT account, date, num_wins, num_losses, {', '.join(f'{sr(c)} AS {c}' for c in SUM_COLS)} FROM summary")
def daily_summary(spark, root):
    return rounded(summary(spark, root), *SUM_COLS).select("account", "date", "num_wins", "num_losses", *SUM_COLS)


ALERTS = """alerts AS (SELECT account, date, CASE WHEN current_drawdown >= 0.15 THEN 'kill_switch' ELSE 'drawdown_breach' END AS alert_type,
  CASE WHEN current_drawdown >= 0.15 THEN 'critical' ELSE 'warning' END AS severity, current_drawdown AS value, CASE WHEN current_drawdown >= 0.15 THEN 0.15 ELSE 0.10 END::DOUBLE AS threshold FROM summary WHERE current_drawdown >= 0.10
 UNION ALL SELECT account, date, 'daily_loss_limit', 'warning', daily_return, -0.02 FROM summary WHERE daily_return <= -0.02)"""


@query("account_alerts", ctes(*ACCT, ALERTS) + f" SELECT account, date, alert_type, severity, {sr('value')} AS value, threshold FROM alerts")
def account_alerts(spark, root):
    return rounded(monitor.account_alerts(summary(spark, root)), "value")


@query(
    "position_alerts",
    ctes(BARS, "pp AS (SELECT strftime(date, '%Y') AS account, ticker, date, volume / sum(volume) OVER (PARTITION BY date) AS p FROM bars)")
    + f" SELECT account, ticker, date, 'position_limit_breach' AS alert_type, 'warning' AS severity, {sr('p')} AS value, 0.25::DOUBLE AS threshold FROM pp WHERE p > 0.25",
)
def position_alerts(spark, root):
    from tickerloom.plans.crosssection import join_date_stats

    b = join_date_stats(market.bars(spark, root), {"_v": F.sum("volume")})
    p = b.select(F.date_format("date", "yyyy").alias("account"), "ticker", "date", (F.col("volume") / F.col("_v")).alias("position_pct"))
    return rounded(monitor.position_alerts(p), "value")


@query(
    "slippage_alerts",
    f"""SELECT fill_id, ticker, 'fill_mismatch' AS alert_type, 'info' AS severity, {sr('s')} AS value, 2.0::DOUBLE AS threshold FROM (
 SELECT event_id AS fill_id, event_type AS ticker, abs((value + 1) / nullif(value + user_id / 100.0::DOUBLE, 0) - 1) * 100 AS s FROM events) WHERE s > 2""",
)
def slippage_alerts(spark, root):
    e = market.table(spark, root, "events").select(F.col("event_id").alias("fill_id"), F.col("event_type").alias("ticker"), (F.col("value") + 1).alias("fill_price"),
                                                  (F.col("value") + F.col("user_id") / 100.0).alias("expected_price"))
    return rounded(monitor.slippage_alerts(e), "value")


PASTF = frame(63)


@query(
    "anomalous_returns",
    ctes(BARS, RETURNS, "a0 AS (SELECT *, lag(ret) OVER (PARTITION BY ticker ORDER BY date) AS p FROM rets)",
         f"a1 AS (SELECT *, (ret - {rm('p', 63, 20)}) / nullif({rs('p', 63, 20)}, 0) AS z FROM a0)")
    + f" SELECT ticker, date, 'anomalous_return' AS alert_type, 'warning' AS severity, {sr('z', 4)} AS value, 3.0::DOUBLE AS threshold FROM a1 WHERE abs(z) > 3",
)
def anomalous_returns(spark, root):
    return rounded(monitor.anomalous_returns(returns(spark, root)), "value", digits=4)


def _degradation_sql(drop: float) -> str:
    return (
        ctes(BARS, panel_sql(), long_sql("date"), ic_sql("date, signal, horizon"),
             "m AS (SELECT *, CASE WHEN count(ic) OVER w >= 63 THEN avg(ic) OVER w END AS m FROM ic WHERE ic IS NOT NULL WINDOW w AS (PARTITION BY signal, horizon ORDER BY date ROWS 62 PRECEDING))",
             f"l AS (SELECT *, CASE horizon {' '.join(f'WHEN {h} THEN lag(m, {h}) OVER x' for h in HORIZONS)} END AS k FROM m WINDOW x AS (PARTITION BY signal, horizon ORDER BY date))",
             "o AS (SELECT *, lag(k, 63) OVER (PARTITION BY signal, horizon ORDER BY date) AS old FROM l)", "dr AS (SELECT *, CASE WHEN old > 0 THEN (old - k) / old END AS d FROM o)")
        + f" SELECT date, signal, horizon, 'ic_degradation' AS alert_type, 'warning' AS severity, {sr('d', 4)} AS value, {drop}::DOUBLE AS threshold FROM dr WHERE d > {drop}"
    )


def _degradation(spark, root, t: monitor.Thresholds):
    cs = metrics.cross_sectional_ic(lean_panel(spark, root), CORE, HORIZONS)
    return rounded(monitor.ic_degradation(metrics.rolling_ic(cs, HORIZONS), t), "value", digits=4)


@query("ic_degradation_alerts", _degradation_sql(0.3))
def ic_degradation_alerts(spark, root):
    return _degradation(spark, root, monitor.Thresholds())


@query("ic_degradation_alerts_tenth", _degradation_sql(0.1))
def ic_degradation_alerts_tenth(spark, root):
    """A fall by a tenth, which the given tables do hold."""
    return _degradation(spark, root, monitor.Thresholds(ic_drop=0.1))


def _alert_rows(spark, root):
    return market.table(spark, root, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("alert_type"), F.when(F.col("value") > 100, "critical").otherwise("warning").alias("severity"),
        (F.col("user_id") > 50).alias("acknowledged"))


@query(
    "recent_alert_counts",
    """SELECT event_type AS alert_type, CASE WHEN value > 100 THEN 'critical' ELSE 'warning' END AS severity, count(*) AS n, count(*) FILTER (NOT user_id > 50) AS unacknowledged
 FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY ALL""",
)
def recent_alert_counts(spark, root):
    return monitor.alert_counts(monitor.recent_alerts(_alert_rows(spark, root), F.lit("2024-01-20").cast("timestamp")))
