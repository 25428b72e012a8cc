"""Minute bars, resampling, sessions and intraday signals."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.rolling import clip, nonzero, pct_change, rolling_mean, rolling_std, rolling_sum, rolling_z
from tickerloom.functions.timeframe import interval
from tickerloom.plans.scale import settled

NEW_YORK = "America/New_York"
# Days without trading, as month-day.
HOLIDAYS = ("01-01", "07-04", "12-25")
UTC_SESSION_HOURS = (14, 20)


def by_time(*keys: str):
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("datetime")


def bars_from_ticks(ticks: DataFrame, timeframe: str = "1min", offset: str | None = None) -> DataFrame:
    """Fixed-length bars. A tick on a boundary opens the next bar; empty intervals give no bar.

    min_by and max_by combine before the shuffle, so a ticker holding most of the ticks sends one
    row per bar and task.
    """
    span = interval(timeframe)
    win = F.window("ts", span, span, offset) if offset else F.window("ts", span)
    first, last = F.struct("ts", "seq"), F.struct("ts", "seq")
    return (
        ticks.groupBy("ticker", win.alias("w"))
        .agg(F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
             F.max_by("price", last).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("trade_count"))
        .select("ticker", F.col("w.start").alias("datetime"), "open", "high", "low", "close", "volume", "trade_count"))


def resample(bars: DataFrame, timeframe: str, offset: str | None = None, with_vwap: bool = False) -> DataFrame:
    """Tumbling left-labelled bars; ``offset='30 minutes'`` anchors hours at half past."""
    span = interval(timeframe)
    win = F.window("datetime", span, span, offset) if offset else F.window("datetime", span)
    aggs = [
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "datetime").alias("close"), F.sum("volume").alias("volume")]
    if with_vwap:
        aggs.append(F.try_divide(F.sum(F.col("close") * F.col("volume")), F.sum("volume")).alias("vwap_raw"))
    out = bars.groupBy("ticker", win.alias("w")).agg(*aggs)
    return out.select("ticker", F.col("w.start").alias("datetime"), *[c for c in out.columns if c not in ("ticker", "w")])


def bar_ladder(bars: DataFrame, timeframes: Sequence[str]) -> dict[str, DataFrame]:
    """Bars of several lengths, each a multiple of the one before, from one scan.

    A bar (first, max, min, last, sum) can be built from finer bars as well as from ticks: the finest ones are
    written once, and every further length is made from the one before, which has fewer rows.
    """
    out, finer = {}, bars
    for timeframe in timeframes:
        finer = settled(resample(finer, timeframe))
        out[timeframe] = finer
    return out


def completed_only(resampled: DataFrame, source: DataFrame, timeframe: str) -> DataFrame:
    """Drop each ticker's last window unless a later source bar shows that it is over."""
    seen = source.groupBy("ticker").agg(F.max("datetime").alias("_last"))
    end = F.col("datetime") + F.expr(f"INTERVAL {interval(timeframe)}")
    return resampled.join(seen, "ticker").filter(F.col("_last") >= end).drop("_last")


def utc_session(bars: DataFrame, first: int = UTC_SESSION_HOURS[0], last: int = UTC_SESSION_HOURS[1]) -> DataFrame:
    """Fixed UTC hours, both included."""
    return bars.filter(F.hour("datetime").between(first, last))


def local_session(bars: DataFrame, zone: str = NEW_YORK) -> DataFrame:
    """Regular hours 09:30–16:00 in exchange time, right in summer and winter."""
    local = F.from_utc_timestamp("datetime", zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return bars.filter((minute >= 570) & (minute < 960))


def with_session_date(bars: DataFrame, zone: str = NEW_YORK) -> DataFrame:
    return bars.withColumn("session_date", F.to_date(F.from_utc_timestamp("datetime", zone)))


def minute_dedupe(bars: DataFrame, cutoff: Column | None = None, order: str = "seq") -> DataFrame:
    """The first row of every (ticker, minute) before the cutoff's own, still open, minute."""
    minute = F.date_trunc("minute", "datetime")
    if cutoff is not None:
        bars = bars.filter(minute < F.date_trunc("minute", cutoff))
    cols = [c for c in bars.columns if c not in ("ticker", "datetime")]
    first = F.min_by(F.struct(*cols), F.struct("datetime", order))
    return bars.groupBy("ticker", minute.alias("datetime")).agg(first.alias("r")).select(
        "ticker", "datetime", *[F.col(f"r.{c}").alias(c) for c in cols])


def intraday_features(bars: DataFrame, n: int = 20, vwap_rows: int = 100) -> DataFrame:
    """Bar return, rolling volatility, rolling VWAP, volume ratio, ADX and session position.

    Every window restarts with the session, so the key is (ticker, session) and a group is one
    trading day of one ticker.
    """
    df = bars if "session_date" in bars.columns else with_session_date(bars)
    w = by_time("ticker", "session_date")
    volume = F.col("volume").cast("double")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    prev = F.lag("close").over(w)
    df = df.withColumns(
        {
            "bar_return": pct_change("close", 1, w),
            "_up": F.when((up > down) & (up > 0), up).otherwise(F.when(up.isNotNull(), F.lit(0.0))),
            "_down": F.when((down > up) & (down > 0), down).otherwise(F.when(down.isNotNull(), F.lit(0.0))),
            "_tr": F.when(prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))),
            "rolling_vwap": rolling_sum(typical * volume, vwap_rows, w) / nonzero(rolling_sum(volume, vwap_rows, w)),
            "session_vwap": F.sum(typical * volume).over(w.rowsBetween(Window.unboundedPreceding, 0))
            / nonzero(F.sum(volume).over(w.rowsBetween(Window.unboundedPreceding, 0))),
            "volume_ratio": volume / nonzero(rolling_mean(volume, n, w)),
            "session_bar": F.row_number().over(w),
        })
    tr = nonzero(rolling_sum("_tr", 14, w))
    df = df.withColumns({"rolling_vol": rolling_std("bar_return", n, w),
                         "_pdi": rolling_sum("_up", 14, w) / tr, "_mdi": rolling_sum("_down", 14, w) / tr})
    df = df.withColumn("_dx", 100 * F.abs(F.col("_pdi") - F.col("_mdi")) / nonzero(F.col("_pdi") + F.col("_mdi")))
    return df.withColumn("adx", rolling_mean("_dx", 14, w)).drop("_up", "_down", "_tr", "_pdi", "_mdi", "_dx")


def vwap_mean_reversion(bars: DataFrame, n: int = 60, keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Positive below the rolling VWAP, negative above."""
    w = by_time(*keys)
    volume = F.col("volume").cast("double")
    vwap = rolling_sum(F.col("close") * volume, n, w) / nonzero(rolling_sum(volume, n, w))
    df = bars.withColumn("_dev", F.col("close") / nonzero(vwap) - 1)
    return df.withColumn(f"signal_vwap_mean_reversion_{n}b", -F.tanh(rolling_z("_dev", n, w, n // 2))).drop("_dev")


def vwap_mean_reversion_filtered(bars: DataFrame, n: int = 60, max_adx: float = 25.0, min_volume_ratio: float = 0.5) -> DataFrame:
    """The same, only in weak trends with normal volume; NULL until warm."""
    df = intraday_features(vwap_mean_reversion(bars, n))
    ok = (F.coalesce("adx", F.lit(0.0)) <= max_adx) & (F.col("volume_ratio") >= min_volume_ratio)
    base = F.col(f"signal_vwap_mean_reversion_{n}b")
    return df.withColumn("signal_vwap_mean_reversion_filtered", F.when(base.isNotNull(), F.when(ok, base).otherwise(F.lit(0.0))))


def actionable(df: DataFrame, signal: str, threshold: float = 0.3) -> DataFrame:
    """NULL and weak signals become 0."""
    s = F.coalesce(signal, F.lit(0.0))
    return df.withColumn(signal, F.when(F.abs(s) < threshold, F.lit(0.0)).otherwise(s))


def vwap_bands(bars: DataFrame, width: float = 2.0) -> DataFrame:
    """Session VWAP ± width·σ of the close around it; the signal leans back to the VWAP."""
    df = bars if "session_date" in bars.columns else with_session_date(bars)
    w = by_time("ticker", "session_date").rowsBetween(Window.unboundedPreceding, 0)
    volume = F.col("volume").cast("double")
    vwap = F.sum(F.col("close") * volume).over(w) / nonzero(F.sum(volume).over(w))
    df = df.withColumn("vwap", vwap).withColumn("_sd", F.stddev_samp(F.col("close") - F.col("vwap")).over(w))
    return df.withColumns({
        "upper_band": F.col("vwap") + width * F.col("_sd"), "lower_band": F.col("vwap") - width * F.col("_sd"),
        "signal_vwap_bands": clip((F.col("vwap") - F.col("close")) / nonzero(width * F.col("_sd")), -1.0, 1.0)}).drop("_sd")


def opening_range_breakout(bars: DataFrame, minutes: int = 30) -> DataFrame:
    """+1 above the high of the session's first minutes, -1 below their low, 0 between; NULL inside the range."""
    df = bars if "session_date" in bars.columns else with_session_date(bars)
    day = Window.partitionBy("ticker", "session_date")
    start = F.min("datetime").over(day)
    df = df.withColumn("_opening", F.col("datetime") < start + F.expr(f"INTERVAL {minutes} MINUTES"))
    high = F.max(F.when(F.col("_opening"), F.col("high"))).over(day)
    low = F.min(F.when(F.col("_opening"), F.col("low"))).over(day)
    signal = F.when(~F.col("_opening"), F.when(F.col("close") > high, 1.0).when(F.col("close") < low, -1.0).otherwise(0.0))
    return df.withColumns({"range_high": high, "range_low": low, "signal_opening_range_breakout": signal}).drop("_opening")


def time_of_day(bars: DataFrame, min_rows: int = 5) -> DataFrame:
    """Mean past return of the same clock hour, squashed by its spread."""
    df = bars.withColumn("_ret", pct_change("close", 1, by_time()))
    w = Window.partitionBy("ticker", F.hour("datetime")).orderBy("datetime").rowsBetween(Window.unboundedPreceding, -1)
    z = F.avg("_ret").over(w) / nonzero(F.stddev_samp("_ret").over(w))
    return df.withColumn("signal_time_of_day", F.when(F.count("_ret").over(w) >= min_rows, F.tanh(z))).drop("_ret")


def trading_days(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Weekdays without the fixed holidays."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    return days.filter((F.weekday("date") < 5) & ~F.date_format("date", "MM-dd").isin(*HOLIDAYS))


def last_trading_days(spark: SparkSession, end: date, n: int) -> DataFrame:
    """The newest ``n`` trading days up to ``end``."""
    start = F.date_sub(F.lit(end), 2 * n + 10)
    days = spark.range(1).select(F.explode(F.sequence(start, F.lit(end))).alias("date"))
    days = days.filter((F.weekday("date") < 5) & ~F.date_format("date", "MM-dd").isin(*HOLIDAYS))
    return days.orderBy(F.col("date").desc()).limit(n)
