"""Covariance, portfolio risk and portfolio weights without asset-by-asset tables.

The covariance of N assets over T dates is X'X / T with X of T rows. T is the lookback, a
small constant, so every quantity here is written with T-vectors: portfolio returns per
date, or one array of T returns per asset. Nothing of size N × N is formed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tickerloom.functions.rolling import nonzero, pct_change, series
from tickerloom.operators.features import calendar_window
from tickerloom.plans.scale import settled

DAYS = 252


def returns_from_prices(df: DataFrame, price: str = "close") -> DataFrame:
    """One-row return per ticker; NULL on the first."""
    return df.select("ticker", "date", pct_change(price, 1, series()).alias("return"))


def pivot_returns(returns: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Dates × named tickers, for a handful of tickers at the edge of the library."""
    return returns.groupBy("date").pivot("ticker", list(tickers)).agg(F.first("return"))


def weights_to_frame(spark, weights: dict[str, float], day) -> DataFrame:
    return spark.createDataFrame([(t, day, float(w)) for t, w in weights.items()], "ticker string, date date, weight double")


def rebalance_dates(df: DataFrame, lookback: int, every: int) -> DataFrame:
    """(rebalance_date, t): the dates every ``every`` dates once ``lookback`` lie behind them."""
    w = calendar_window()
    d = df.select("date").distinct().withColumn("t", F.row_number().over(w))
    return d.filter((F.col("t") >= lookback) & ((F.col("t") - lookback) % every == 0)).select(
        F.col("date").alias("rebalance_date"), "t")


def return_windows(returns: DataFrame, lookback: int = 63, every: int = 63, min_rows: int = 5) -> DataFrame:
    """One row per (rebalance_date, ticker): the ``lookback`` demeaned returns as an array ``x``.

    A date without a bar is a zero return. Each return falls in at most ceil(lookback / every)
    windows; a group is one ticker's window, at most ``lookback`` rows. Returns and windows are written once, as both
    are read several times.
    """
    w = calendar_window()
    returns = settled(returns.select("ticker", "date", "return"))
    dates = returns.select("date").distinct().withColumn("t", F.row_number().over(w))
    ends = rebalance_dates(returns, lookback, every)
    member = dates.alias("d").join(
        F.broadcast(ends.alias("e")),
        (F.col("d.t") <= F.col("e.t")) & (F.col("d.t") > F.col("e.t") - lookback)
    ).select("date", "rebalance_date", (F.col("d.t") - F.col("e.t") + lookback - 1).cast("int").alias("pos"))
    rows = returns.filter(F.col("return").isNotNull()).join(F.broadcast(member), "date")
    packed = rows.groupBy("rebalance_date", "ticker").agg(F.collect_list(F.struct("pos", F.col("return").cast("double").alias("r"))).alias("m"))
    packed = packed.filter(F.size("m") >= min_rows).select("rebalance_date", "ticker", F.col("m.pos").alias("pos"), F.col("m.r").alias("r"))
    return settled(packed.mapInArrow(_dense_windows(lookback), StructType([*packed.schema.fields[:2], StructField("x", ArrayType(DoubleType()))])))


def _dense_windows(lookback: int):
    """Listed returns laid out over the window's dates and demeaned, a batch of windows at once."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, r = batch.column(2), batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(pos.value_lengths()))
            place = row * lookback + pos.flatten().to_numpy()
            if len(np.unique(place)) < len(place):
                raise ValueError("a ticker has several returns on a date")
            x = np.zeros((batch.num_rows, lookback))
            x.ravel()[place] = r.flatten().to_numpy()
            x -= np.cumsum(x, axis=1)[:, -1:] / lookback  # added up one after another
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * lookback)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["rebalance_date", "ticker", "x"])

    return run


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)


def shrinkage(windows: DataFrame, lookback: int, constant: float | None = None) -> DataFrame:
    """Ledoit-Wolf intensity towards the diagonal, one row per rebalance date.

    Needs the sum of squared covariances, |XX'|² / T², and XX' is only T × T: partitions add up
    their own T × T blocks. With fewer dates than assets the shrunk matrix stays positive definite.
    """
    if constant is not None:
        return windows.groupBy("rebalance_date").agg(F.count(F.lit(1)).alias("n_assets")).withColumn("delta", F.lit(float(constant)))

    def gram(batches):
        sums: dict = {}
        for pdf in batches:
            for day, part in pdf.groupby("rebalance_date", sort=False):
                x = np.stack(part["x"].to_numpy())
                sq = x * x
                g, fourth, var = x.T @ x, (sq.T @ sq), (sq.mean(axis=1) ** 2).sum()
                if day in sums:
                    a = sums[day]
                    a[0] += g
                    a[1] += fourth
                    a[2] += var
                    a[3] += len(part)
                else:
                    sums[day] = [g, fourth, var, len(part)]
        for day, (g, fourth, var, n) in sums.items():
            yield pd.DataFrame({"rebalance_date": [day], "g": [g.ravel()], "q": [np.diag(fourth).copy()], "v": [var], "n": [n]})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        g, q = np.sum(np.stack(pdf["g"].to_numpy()), axis=0), np.sum(np.stack(pdf["q"].to_numpy()), axis=0)
        t, diag_sq, n = lookback, pdf["v"].sum(), int(pdf["n"].sum())
        g = g.reshape(t, t)
        all_sq = (g**2).sum() / t**2  # sum of s_ij² over all pairs
        # sum of var(x_i x_j): (1/T) Σ_t |x_t|⁴ - Σ s_ij², less its diagonal part
        spread = (np.diag(g) ** 2).sum() / t - all_sq
        diag_spread = q.sum() / t - diag_sq
        off_sq, off_spread = all_sq - diag_sq, spread - diag_spread
        delta = min(1.0, max(0.0, off_spread / t / off_sq)) if off_sq > 0 else 1.0
        return pd.DataFrame({"rebalance_date": [pdf["rebalance_date"].iloc[0]], "n_assets": [n], "delta": [delta]})

    block = "rebalance_date date, g array<double>, q array<double>, v double, n bigint"

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rebalance_date": [pdf["rebalance_date"].iloc[0]], "g": [np.sum(np.stack(pdf["g"].to_numpy()), axis=0)],
                             "q": [np.sum(np.stack(pdf["q"].to_numpy()), axis=0)], "v": [pdf["v"].sum()], "n": [int(pdf["n"].sum())]})

    # blocks of many partitions are added in two steps, so that no task receives them all
    parts = windows.select("rebalance_date", "x").mapInPandas(gram, block).withColumn("_part", F.spark_partition_id() % 64)
    parts = parts.groupBy("rebalance_date", "_part").applyInPandas(add_up, block)
    return parts.groupBy("rebalance_date").applyInPandas(combine, "rebalance_date date, n_assets bigint, delta double")


def asset_variances(windows: DataFrame, lookback: int) -> DataFrame:
    return windows.withColumn("variance", dot(F.col("x"), F.col("x")) / lookback)


def covariance_rows(windows: DataFrame, shrink: DataFrame, pairs: DataFrame, lookback: int) -> DataFrame:
    """Shrunk covariances of asked-for (ticker_a, ticker_b) pairs; the diagonal is not shrunk."""
    a = windows.select("rebalance_date", F.col("ticker").alias("ticker_a"), F.col("x").alias("_a"))
    b = windows.select("rebalance_date", F.col("ticker").alias("ticker_b"), F.col("x").alias("_b"))
    both = pairs.join(a, "ticker_a").join(b, ["rebalance_date", "ticker_b"]).join(F.broadcast(shrink), "rebalance_date")
    keep = F.when(F.col("ticker_a") == F.col("ticker_b"), F.lit(1.0)).otherwise(1 - F.col("delta"))
    return both.select("rebalance_date", "ticker_a", "ticker_b", (keep * dot(F.col("_a"), F.col("_b")) / lookback).alias("cov"))


def _portfolio_vector(weighted: DataFrame, lookback: int) -> DataFrame:
    """Σ_i w_i x_i per rebalance date, as T summed columns (map-side) packed into an array."""
    sums = [F.sum(F.col("w") * F.col("x")[i]).alias(f"p{i}") for i in range(lookback)]
    extra = [F.sum(F.col("w") * F.col("w") * F.col("variance")).alias("own"), F.sum("w").alias("w_sum"), F.count(F.lit(1)).alias("n")]
    return weighted.groupBy("rebalance_date").agg(*sums, *extra).select(
        "rebalance_date", F.array(*[f"p{i}" for i in range(lookback)]).alias("p"), "own", "w_sum", "n")


def risk_contributions(weighted: DataFrame, shrink: DataFrame, lookback: int) -> DataFrame:
    """Marginal, component and percentage risk of each asset; the percentages sum to 1 per date.

    Needs columns rebalance_date, ticker, x, w.
    """
    rows = asset_variances(weighted, lookback)
    book = _portfolio_vector(rows, lookback).join(shrink.select("rebalance_date", "delta"), "rebalance_date")
    out = rows.join(F.broadcast(book.select("rebalance_date", "p", "own", "delta")), "rebalance_date")
    d = F.col("delta")
    with_book = (1 - d) * dot(F.col("x"), F.col("p")) / lookback + d * F.col("w") * F.col("variance")
    var = (1 - d) * dot(F.col("p"), F.col("p")) / lookback + d * F.col("own")
    return out.withColumns({"_cov": with_book, "_var": var}).select(
        "rebalance_date", "ticker", F.col("w").alias("weight"),
        (F.col("_cov") / nonzero(F.sqrt("_var"))).alias("marginal"),
        (F.col("w") * F.col("_cov") / nonzero(F.sqrt("_var"))).alias("component"),
        (F.col("w") * F.col("_cov") / nonzero("_var")).alias("share"))


def portfolio_stats(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Annualised volatility, mean and Sharpe of the weighted return series; Sharpe 0 without variation."""
    daily = weights.join(returns.filter(F.col("return").isNotNull()), ["ticker", "date"]).groupBy("date").agg(
        F.sum(F.col("weight") * F.col("return")).alias("_r"))
    out = daily.agg(F.avg("_r").alias("_m"), F.coalesce(F.stddev_samp("_r"), F.lit(0.0)).alias("_s"), F.count(F.lit(1)).alias("num_dates"))
    return out.select(
        (F.col("_s") * DAYS**0.5).alias("volatility"), (F.col("_m") * DAYS).alias("mean_return"),
        F.coalesce(F.col("_m") / nonzero("_s") * DAYS**0.5, F.lit(0.0)).alias("sharpe"), "num_dates")


def inverse_volatility(windows: DataFrame, lookback: int) -> DataFrame:
    rows = asset_variances(windows, lookback).filter(F.col("variance") > 1e-18).withColumn("_i", 1 / F.sqrt("variance"))
    total = rows.groupBy("rebalance_date").agg(F.sum("_i").alias("_all"))
    return rows.join(F.broadcast(total), "rebalance_date").withColumn("w", F.col("_i") / F.col("_all")).drop("_i", "_all")


def _dual_sums(lookback: int):
    """Per rebalance date and partition: what one Newton step in the portfolio's T-vector needs."""

    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for day, part in pdf.groupby("rebalance_date", sort=False):
                x, var = np.stack(part["x"].to_numpy()), part["variance"].to_numpy()
                p, c, delta = np.asarray(part["p"].iloc[0]), float(part["c"].iloc[0]), float(part["delta"].iloc[0])
                k, b = (1 - delta) / lookback, delta * var
                a = k * (x @ p)
                root = np.sqrt(a * a + 4 * b * c)
                w = np.where(a > 0, 2 * c / (root + a), (root - a) / (2 * b))  # both are the root; neither cancels
                new = [x.T @ w, k * (x.T * (w / root)) @ x, float((a * w + b * w * w / 2 - c * np.log(w)).sum()),
                       float((w * k * np.sqrt(lookback * var)).max() / c)]
                if day in sums:
                    old = sums[day]
                    new = [old[0] + new[0], old[1] + new[1], old[2] + new[2], max(old[3], new[3])]
                sums[day] = new
        for day, (g, h, low, reach) in sums.items():
            yield pd.DataFrame({"rebalance_date": [day], "g": [g], "h": [h.ravel()], "low": [low], "reach": [reach]})

    return run


_DUAL = "rebalance_date date, g array<double>, h array<double>, low double, reach double"


def _dual_added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"rebalance_date": [pdf["rebalance_date"].iloc[0]], "g": [np.sum(np.stack(pdf["g"].to_numpy()), axis=0)],
                         "h": [np.sum(np.stack(pdf["h"].to_numpy()), axis=0)], "low": [pdf["low"].sum()], "reach": [pdf["reach"].max()]})


def _dual_solved(pdf: pd.DataFrame) -> pd.DataFrame:
    """The portfolio that the assets' answers make up, and the inverse of I + H."""
    row = _dual_added(pdf).iloc[0]
    t = len(row["g"])
    inverse = np.linalg.inv(np.eye(t) + np.asarray(row["h"]).reshape(t, t))
    return pd.DataFrame({"rebalance_date": [row["rebalance_date"]], "g": [row["g"]], "h": [inverse.ravel()], "low": [row["low"]], "reach": [row["reach"]]})


def risk_parity(
    windows: DataFrame, lookback: int, shrink: DataFrame | None = None, target_risk: float | None = None,
    tol: float = 1e-6, rounds: int = 100,
) -> DataFrame:
    """Long-only weights with equal risk contributions, one row per (rebalance_date, ticker).

    Weights minimise variance / 2 - c Σ log w. Given the portfolio's T-vector p, every asset answers with the
    root w of its own quadratic δ·v·w² + (1-δ)·(x·p/T)·w = c, and p is right when the answers' portfolio Σ w·x
    is p itself. That is the zero of the gradient of a strictly convex function of T numbers, found by
    Newton's method with halved steps: a round is one job that adds up T and T × T numbers a date by
    partitions, then over 64 groups, then a date. It ends when no asset's contribution can be off by more than
    ``tol`` of an equal one, and fails rather than return weights that are not there after ``rounds``.
    What comes to the driver is T × (T + 1) numbers per rebalance date, whatever the number of assets.
    The shrinkage is at least 1e-3, as more assets than dates have no equal contributions without it.
    """
    spark = windows.sparkSession
    shrink = shrinkage(windows, lookback, 0.1) if shrink is None else shrink
    start = inverse_volatility(windows, lookback).join(F.broadcast(shrink.select("rebalance_date", "delta")), "rebalance_date")
    start = start.withColumn("delta", F.greatest("delta", F.lit(1e-3)))
    base = settled(start)  # read once per round
    delta = {r["rebalance_date"]: r["delta"] for r in base.groupBy("rebalance_date").agg(F.max("delta").alias("delta")).collect()}
    at, trial, c = {}, {}, {}  # accepted state, point asked for, and scale of each date
    for r in _portfolio_vector(base, lookback).collect():
        day, p = r["rebalance_date"], np.array(r["p"])
        trial[day] = p
        c[day] = float(((1 - delta[day]) * p @ p / lookback + delta[day] * r["own"]) / r["n"])
    schema = "rebalance_date date, p array<double>, c double"
    done: dict = {}

    def book(points: dict) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(k, p.tolist(), c[k]) for k, p in points.items()], schema))

    for _ in range(rounds):
        if not trial:
            break
        asked = base.select("rebalance_date", "x", "variance", "delta").join(book(trial), "rebalance_date")
        parts = asked.mapInPandas(_dual_sums(lookback), _DUAL).withColumn("_part", F.spark_partition_id() % 64)
        parts = parts.groupBy("rebalance_date", "_part").applyInPandas(_dual_added, _DUAL)
        for r in parts.groupBy("rebalance_date").applyInPandas(_dual_solved, _DUAL).collect():
            day, p, g = r["rebalance_date"], trial[r["rebalance_date"]], np.array(r["g"])
            k = (1 - delta[day]) / lookback
            off, value = p - g, k * float(p @ p) / 2 - r["low"]
            if r["reach"] * float(np.sqrt(off @ off)) <= tol:
                done[day] = trial.pop(day)
                continue
            old = at.get(day)
            if old is None or value <= old["value"] + 1e-4 * old["t"] * old["slope"] + 1e-13 * abs(old["value"]):
                step = -np.array(r["h"]).reshape(lookback, lookback) @ off
                at[day] = {"p": p, "value": value, "step": step, "slope": k * float(off @ step), "t": 1.0}
            else:
                old["t"] /= 2
            trial[day] = at[day]["p"] + at[day]["t"] * at[day]["step"]
    if trial:
        raise ArithmeticError(f"risk parity has not converged on {sorted(trial)}")
    a = (1 - F.col("delta")) * dot(F.col("x"), F.col("p")) / lookback
    b = F.col("delta") * F.col("variance")
    root = F.sqrt(a * a + 4 * b * F.col("c"))
    w = F.when(a > 0, 2 * F.col("c") / (root + a)).otherwise((root - a) / (2 * b))
    out = base.drop("w").join(book(done), "rebalance_date").withColumn("w", w) if done else base.withColumns({"p": F.col("x"), "c": F.lit(0.0)})
    total = out.groupBy("rebalance_date").agg(F.sum("w").alias("_all"))
    out = out.join(F.broadcast(total), "rebalance_date").withColumn("w", F.col("w") / F.col("_all")).drop("_all", "p", "c")
    if target_risk is not None:
        held = _portfolio_vector(out, lookback).join(shrink.select("rebalance_date", "delta"), "rebalance_date")
        d = F.col("delta")
        vol = F.sqrt(((1 - d) * dot(F.col("p"), F.col("p")) / lookback + d * F.col("own")) * DAYS)
        out = out.join(F.broadcast(held.select("rebalance_date", (target_risk / nonzero(vol)).alias("_k"))), "rebalance_date")
        out = out.withColumn("w", F.col("w") * F.col("_k")).drop("_k")
    return out.select("rebalance_date", "ticker", "x", "w")


def hold_weights(panel: DataFrame, targets: DataFrame, method: str) -> DataFrame:
    """Carry each rebalance date's weights to the next one: one row per (ticker, date) of the panel, 0 where unknown."""
    days = targets.select("rebalance_date").distinct()
    w = calendar_window()
    spans = (
        panel.select("date").distinct().join(F.broadcast(days.withColumn("_r", F.col("rebalance_date"))),
                                             F.col("date") == F.col("rebalance_date"), "left")
        .select("date", F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rebalance_date")))
    return (
        panel.join(F.broadcast(spans), "date").join(targets.select("rebalance_date", "ticker", "w"), ["rebalance_date", "ticker"], "left")
        .withColumns({"weight": F.coalesce("w", F.lit(0.0)), "method": F.lit(method)}).drop("w", "rebalance_date"))


MODES = ("kelly", "risk_parity", "hrp")


def build_portfolio(
    panel: DataFrame, mode: str = "risk_parity", signal: str | None = None, lookback: int = 63, every: int = 63,
    linkage: str = "single", equity: DataFrame | None = None, windows: DataFrame | None = None,
) -> DataFrame:
    """ticker, date, weight, method; signal_value where weights follow or are modulated by a signal, leverage_scale with an equity curve.

    One row per input (ticker, date); no NULL weights. With ``equity`` (date, equity) weights are cut while the
    drawdown breaker is tripped. ``windows`` are the panel's return windows where they have been made already.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "kelly":
        from tickerloom.operators.sizing import kelly_weights

        if signal is None:
            raise ValueError("kelly needs a signal")
        out = kelly_weights(panel, signal).select("ticker", "date", F.col("position_weight").alias("weight"), F.lit("kelly").alias("method"), "signal_value")
    else:
        windows = return_windows(returns_from_prices(panel), lookback, every) if windows is None else windows
        if mode == "hrp":
            from tickerloom.operators.hierarchy import hrp

            target = hrp(windows, lookback, linkage)
        else:
            target = risk_parity(windows, lookback)
        out = hold_weights(panel.select("ticker", "date", *([signal] if signal else [])), target, mode)
        columns = ["ticker", "date", "weight", "method"]
        if signal:
            out = out.withColumn("signal_value", F.coalesce(signal, F.lit(0.0))).withColumn("weight", F.col("weight") * F.col("signal_value"))
            columns.append("signal_value")
        out = out.select(*columns)
    if equity is not None:
        from tickerloom.operators.risk import RiskConfig, drawdown_breaker, drawdown_series

        scale = drawdown_breaker(drawdown_series(equity), RiskConfig()).select("date", "leverage_scale")  # a row a date
        out = out.join(F.broadcast(scale), "date", "left").withColumn("leverage_scale", F.coalesce("leverage_scale", F.lit(1.0)))
        out = out.withColumn("weight", F.col("weight") * F.col("leverage_scale"))
    return out


def compare(panel: DataFrame, returns: DataFrame, signal: str, modes: Sequence[str] = MODES, lookback: int = 63, every: int = 63) -> DataFrame:
    """``analyze`` of several modes side by side, a row per mode."""
    from tickerloom.operators.sizing import KellyConfig

    target = f"forward_return_{KellyConfig().forward_horizon}"
    read = [c for c in ("ticker", "date", "close", signal, target) if c in panel.columns]
    panel = settled(panel.select(*read))  # read by every mode
    windows = return_windows(returns_from_prices(panel), lookback, every) if set(modes) - {"kelly"} else None
    columns = ["ticker", "date", "weight", "method"]
    books = [build_portfolio(panel, m, signal if m == "kelly" else None, lookback, every, windows=windows).select(*columns) for m in modes]
    return analyze(reduce(DataFrame.unionByName, books), returns)


def analyze(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Exposure, weight and return statistics per method."""
    book = weights.join(returns, ["ticker", "date"], "left")
    daily = book.groupBy("method", "date").agg(
        F.sum(F.abs("weight")).alias("_e"), F.sum(F.col("weight") * F.coalesce("return", F.lit(0.0))).alias("_r"), F.avg("weight").alias("_w"),
        F.count(F.lit(1)).alias("_n"))
    sd = F.coalesce(F.stddev_samp("_r"), F.lit(0.0))
    return daily.groupBy("method").agg(
        F.avg("_e").alias("exposure_mean"), F.count(F.lit(1)).alias("num_dates"),
        (F.sum(F.col("_w") * F.col("_n")) / F.sum("_n")).alias("mean_weight"), (sd * DAYS**0.5).alias("volatility"),
        F.coalesce(F.avg("_r") / F.nullif(sd, F.lit(0.0)) * DAYS**0.5, F.lit(0.0)).alias("sharpe"))
