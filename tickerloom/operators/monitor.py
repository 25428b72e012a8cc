"""Daily summaries and threshold alerts over account tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.rolling import nonzero, rolling_mean, rolling_std, series
from tickerloom.plans.scale import settled


@dataclass(frozen=True)
class Thresholds:
    max_drawdown: float = 0.10
    kill_switch_drawdown: float = 0.15
    max_daily_loss: float = 0.02
    max_position_pct: float = 0.25
    max_leverage: float = 1.0
    max_fill_slippage_pct: float = 2.0
    anomalous_sigma: float = 3.0
    ic_drop: float = 0.30


def daily_summary(balances: DataFrame, key: str = "account", annualization: float = 252.0) -> DataFrame:
    """P&L, return, running wins and losses, drawdown and Sharpe per account and day.

    The first day's return is against the opening balance column ``start_balance``.
    """
    w = Window.partitionBy(key).orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.lag("balance").over(w), F.col("start_balance"))
    df = balances.withColumn("starting_balance", start)
    df = df.withColumn("_r", F.col("balance") / nonzero("starting_balance") - 1)
    df = df.withColumns(
        {"num_wins": F.count_if(F.col("_r") > 0).over(upto), "num_losses": F.count_if(F.col("_r") < 0).over(upto),
         "_peak": F.greatest(F.max("balance").over(upto), F.col("start_balance")), "_n": F.count("_r").over(upto)})
    df = df.withColumn("current_drawdown", (F.col("_peak") - F.col("balance")) / nonzero("_peak"))
    sharpe = F.when(F.col("_n") >= 2, F.avg("_r").over(upto) / nonzero(F.stddev_samp("_r").over(upto)) * annualization**0.5)
    return df.select(
        key, "date", "starting_balance", F.col("balance").alias("ending_balance"),
        F.round(F.col("balance") - F.col("starting_balance"), 2).alias("daily_pnl"), F.round("_r", 4).alias("daily_return"),
        "num_wins", "num_losses",
        F.coalesce(F.round(F.try_divide("num_wins", F.col("num_wins") + F.col("num_losses")), 4), F.lit(0.0)).alias("win_rate"),
        F.round("current_drawdown", 4).alias("current_drawdown"), F.round(F.max("current_drawdown").over(upto), 4).alias("max_drawdown"),
        F.round(F.coalesce(sharpe, F.lit(0.0)), 3).alias("sharpe_ratio"))


def _alert(cond: Column, kind: str, severity: str, value: Column, threshold: float) -> Column:
    row = F.struct(F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"))
    return F.when(cond, row)


def account_alerts(summary: DataFrame, t: Thresholds = Thresholds(), key: str = "account") -> DataFrame:
    """Drawdown (kill switch above its own level), daily loss, and leverage where the column exists."""
    dd, ret = F.col("current_drawdown"), F.col("daily_return")
    checks = [
        F.coalesce(_alert(dd >= t.kill_switch_drawdown, "kill_switch", "critical", dd, t.kill_switch_drawdown),
                   _alert(dd >= t.max_drawdown, "drawdown_breach", "warning", dd, t.max_drawdown)),
        _alert(ret <= -t.max_daily_loss, "daily_loss_limit", "warning", ret, -t.max_daily_loss)]
    if "leverage" in summary.columns:
        lev = F.col("leverage")
        checks.append(_alert(lev > t.max_leverage, "leverage_exceeded", "critical", lev, t.max_leverage))
    return summary.select(key, "date", F.explode(F.array_compact(F.array(*checks))).alias("a")).select(key, "date", "a.*")


def position_alerts(positions: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Positions above their share of the portfolio: needs position_pct."""
    p = F.col("position_pct")
    hit = _alert(p > t.max_position_pct, "position_limit_breach", "warning", p, t.max_position_pct)
    return positions.select("account", "ticker", "date", hit.alias("a")).filter(F.col("a").isNotNull()).select("account", "ticker", "date", "a.*")


def slippage_alerts(fills: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Fills further from the expected price than the limit, in percent."""
    s = F.abs(F.col("fill_price") / nonzero("expected_price") - 1) * 100
    hit = _alert(s > t.max_fill_slippage_pct, "fill_mismatch", "info", s, t.max_fill_slippage_pct)
    return fills.select("fill_id", "ticker", hit.alias("a")).filter(F.col("a").isNotNull()).select("fill_id", "ticker", "a.*")


def anomalous_returns(df: DataFrame, t: Thresholds = Thresholds(), rows: int = 63, min_rows: int = 20) -> DataFrame:
    """Returns further than ``anomalous_sigma`` from the ticker's own past mean."""
    w = series()
    past = F.lag("return").over(w)
    df = df.withColumn("_past", past)
    z = (F.col("return") - rolling_mean("_past", rows, w, min_rows)) / nonzero(rolling_std("_past", rows, w, min_rows))
    df = df.withColumn("_z", z)
    hit = _alert(F.abs("_z") > t.anomalous_sigma, "anomalous_return", "warning", F.col("_z"), t.anomalous_sigma)
    return df.select("ticker", "date", hit.alias("a")).filter(F.col("a").isNotNull()).select("ticker", "date", "a.*")


def ic_degradation(rolling: DataFrame, t: Thresholds = Thresholds(), back: int = 63) -> DataFrame:
    """Rolling IC that fell by more than the threshold against its value ``back`` dates ago."""
    w = series("date", "signal", "horizon")
    old = F.lag("rolling_ic", back).over(w)
    df = rolling.withColumn("_drop", F.when(old > 0, (old - F.col("rolling_ic")) / old))
    hit = _alert(F.col("_drop") > t.ic_drop, "ic_degradation", "warning", F.col("_drop"), t.ic_drop)
    return df.select("date", "signal", "horizon", hit.alias("a")).filter(F.col("a").isNotNull()).select("date", "signal", "horizon", "a.*")


def recent_alerts(alerts: DataFrame, since: Column, unacknowledged_only: bool = False) -> DataFrame:
    out = alerts.filter(F.col("ts") >= since)
    return out.filter(~F.col("acknowledged")) if unacknowledged_only else out


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("acknowledged")).alias("unacknowledged"))


def _next_allowed(times: np.ndarray, span: int) -> np.ndarray:
    """Index of the first instant at least ``span`` after each instant."""
    return np.searchsorted(times, times + span, side="left")


#: Children of a block when hour maps are composed: 2^6 of them, so three rounds take hours to spans of 30 years.
FAN_BITS, ROUNDS = 6, 3
#: "Nothing kept so far": earlier than any instant, with room to add a span.
NEVER = -(1 << 62)


def _step_map(ins: np.ndarray, outs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries with the same last kept instant as their successor say nothing new: the last of each run stays."""
    last = np.append(outs[1:] != outs[:-1], True)
    return ins[last], outs[last]


def _follow(ins: np.ndarray, outs: np.ndarray, kept: np.ndarray, span: int) -> np.ndarray:
    """Last kept instants behind a block, from those ahead of it; a block too young to be entered changes nothing."""
    i = np.searchsorted(ins, kept + span, side="left")
    return np.where(i < len(ins), outs[np.minimum(i, len(ins) - 1)], kept)


def _children(pdf: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    parts = pdf.sort_values(["_c", "_in"]).groupby("_c", sort=True)
    return [(int(c), p["_in"].to_numpy(), p["_out"].to_numpy()) for c, p in parts]


def cooldown(alerts: DataFrame, seconds: int = 300, key: str = "alert_type", ts: str = "ts", chunk: str = "hour") -> DataFrame:
    """Keep an alert only if the last kept one of its type is at least ``seconds`` old.

    Which rows are kept depends on the one kept before, so each (type, chunk) is first turned into a
    map "if the walk enters up to this instant, its last kept instant here is that". A walk can only
    enter within ``seconds`` of a chunk's first instant, and walks soon meet, so the maps are short.
    Maps of neighbouring chunks compose to maps of blocks of 64, of 64 blocks, and so on; going
    back down, every block and in the end every chunk learns what was kept ahead of it, and all chunks
    walk on their own. A task holds 64 maps or one chunk of one type, however many alerts a type has;
    a type as a whole has one map for every 30 years.

    Equal instants of a type give one row, the smallest by its other columns. Alerts without a type or
    an instant are dropped.
    """
    span = seconds * 1_000_000
    length = max({"hour": 3600, "day": 86400}[chunk] * 1_000_000, span)
    key_type = alerts.schema[key].dataType.simpleString()
    us = F.unix_micros(ts)
    instants = alerts.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
    instants = instants.select(key, F.floor(us / length).alias("_c"), us.alias("_us")).distinct()
    map_schema, entry_schema = f"{key} {key_type}, _c bigint, _in bigint, _out bigint", f"{key} {key_type}, _c bigint, _kept bigint"

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_us"].to_numpy())
        nxt, n = _next_allowed(times, span), len(times)
        last = np.arange(n)
        for i in range(n - 1, -1, -1):
            if nxt[i] < n:
                last[i] = last[nxt[i]]
        reach = int(np.searchsorted(times, times[0] + span, side="left")) + 1
        ins, outs = _step_map(times[:reach], times[last][:reach])
        return pd.DataFrame({key: pdf[key].iloc[0], "_c": pdf["_c"].iloc[0], "_in": ins, "_out": outs})

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        *before, (_, ins, outs) = _children(pdf)
        for _, a_in, a_out in reversed(before):
            through = _follow(ins, outs, a_out, span)
            # behind this child's own entries come those of walks too young to enter it
            ins, outs = np.concatenate([a_in, ins]), np.concatenate([through, outs])
            reach = int(np.searchsorted(ins, ins[0] + span, side="left")) + 1
            ins, outs = _step_map(ins[:reach], outs[:reach])
        return pd.DataFrame({key: pdf[key].iloc[0], "_c": pdf["_p"].iloc[0], "_in": ins, "_out": outs})

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, kept = [], pdf["_kept"].to_numpy()[:1]
        for c, ins, outs in _children(pdf):
            rows.append((c, int(kept[0])))
            kept = _follow(ins, outs, kept, span)
        return pd.DataFrame({key: pdf[key].iloc[0], "_c": [r[0] for r in rows], "_kept": [r[1] for r in rows]})

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_us"].to_numpy())
        nxt, keep = _next_allowed(times, span), []
        i = int(np.searchsorted(times, int(pdf["_kept"].iloc[0]) + span, side="left"))
        while i < len(times):
            keep.append(int(times[i]))
            i = int(nxt[i])
        return pd.DataFrame({key: pdf[key].iloc[0], "_us": keep})

    parent = F.shiftright("_c", FAN_BITS).alias("_p")
    maps = [settled(instants.groupBy(key, "_c").applyInPandas(exits, map_schema))]
    for _ in range(ROUNDS):
        maps.append(maps[-1].select("*", parent).groupBy(key, "_p").applyInPandas(composed, map_schema))
    entry = maps.pop().withColumn("_kept", F.lit(NEVER)).groupBy(key).applyInPandas(entries, entry_schema)
    while maps:
        ahead = entry.withColumnRenamed("_c", "_p")
        entry = maps.pop().select("*", parent).join(ahead, [key, "_p"]).groupBy(key, "_p").applyInPandas(entries, entry_schema)
    kept = instants.join(entry, [key, "_c"]).groupBy(key, "_c").applyInPandas(walk, f"{key} {key_type}, _us bigint")
    others = [c for c in alerts.columns if c not in (key, ts)]
    first = F.min(F.struct(*others)).alias("_r") if others else F.lit(None).alias("_r")
    rows = alerts.groupBy(key, ts).agg(first).withColumn("_us", us)
    return rows.join(kept, [key, "_us"]).select(key, ts, *[F.col(f"_r.{c}").alias(c) for c in others])
