"""How a signal's IC reacts when its window length is moved."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators.metrics import rank_ic_of, signal_stats
from tickerloom.operators.signals import (
    Signal,
    bollinger,
    generate,
    macd,
    mean_reversion,
    momentum,
    rsi,
    trend_filter,
    vol_scaled,
    with_forward_returns,
)
from tickerloom.plans.scale import discard, settled

PERCENTS = (-20, -10, 0, 10, 20)
# Names of parameters that are window lengths.
TUNABLE = ("lookback", "formation_days", "skip_days", "window", "horizon", "fast_period", "slow_period")

# Variants that are written together.
COLUMNS = 10
ROBUST_FROM, FRAGILE_TO = -20.0, -50.0


def perturbed(base: int, percents: Sequence[float] = PERCENTS) -> list[int]:
    return [max(1, round(base * (1 + p / 100))) for p in percents]


def tunable(signal: Signal) -> dict[str, int]:
    return {k: v for k, v in signal.params.items() if k in TUNABLE and isinstance(v, int) and v > 1}


#: Per signal with a window, what builds it from its parameters, named as in ``Signal.params``.
FAMILIES: dict[str, Callable[..., Signal]] = {
    "mean_reversion_21d": lambda lookback=21: mean_reversion(lookback),
    "mean_reversion_63d": lambda lookback=63: mean_reversion(lookback),
    "momentum_21d": lambda formation_days=21: momentum(formation_days),
    "momentum_63d": lambda formation_days=63: momentum(formation_days),
    "mean_reversion_ts_21d": lambda lookback=21: mean_reversion(lookback, False),
    "mean_reversion_ts_63d": lambda lookback=63: mean_reversion(lookback, False),
    "momentum_ts_21d": lambda formation_days=21: momentum(formation_days, False),
    "momentum_ts_63d": lambda formation_days=63: momentum(formation_days, False),
    "bollinger_bands": lambda lookback=20: bollinger(lookback),
    "rsi": lambda lookback=14: rsi(lookback),
    "trend_filter": lambda fast_period=20, slow_period=60: trend_filter(fast_period, slow_period),
    "vol_scaled": lambda formation_days=21: vol_scaled(formation_days),
    "macd": lambda fast_period=12, slow_period=26: macd(fast_period, slow_period),
}


def variants(families: Sequence[str], percents: Sequence[float] = PERCENTS) -> list[tuple[str, str, int, int, Signal]]:
    """(name, parameter, base, value, signal): one parameter moved at a time, the others at their base."""
    out = []
    for name in families:
        build = FAMILIES[name]
        for parameter, base in tunable(build()).items():
            for value in dict.fromkeys(perturbed(base, percents)):
                signal = build(**{parameter: value})
                if signal.name == name:  # its name doesn't tell the value
                    signal = replace(signal, name=f"{name}__{parameter}_{value}") if signal.cross_section is None else signal
                out.append((name, parameter, base, value, signal))
    return out


def perturb(df: DataFrame, families: Sequence[str] = tuple(FAMILIES), percents: Sequence[float] = PERCENTS, horizon: int = 5) -> DataFrame:
    """One row per (signal, parameter, value): IC, win rate, spread and mean, and their change against the base value.

    Prices and outcomes are written once. ``COLUMNS`` variants are columns of one pass over them; their
    panel goes when it has been measured, so the disk never holds those of all.
    """
    moves = variants(families, percents)
    signals = {v[4].column: v[4] for v in moves}
    prices, found = settled(with_forward_returns(df, [horizon])), []
    for at in range(0, len(signals), COLUMNS):
        cols = list(signals)[at:at + COLUMNS]
        panel = settled(generate(prices, [signals[c] for c in cols]).select(*cols, f"forward_return_{horizon}"))
        found.append(settled(signal_stats(panel, cols).join(rank_ic_of(panel, cols, [horizon]), "signal", "left")))
        discard(panel)
    discard(prices)
    found = reduce(DataFrame.unionByName, found)
    keys = df.sparkSession.createDataFrame(
        [(n, p, b, v, s.column) for n, p, b, v, s in moves], "name string, parameter string, base int, value int, signal string")
    rows = keys.join(found, "signal", "left")
    start = rows.filter(F.col("value") == F.col("base")).select(
        "name", "parameter", F.col("ic").alias("_ic"), F.col("win_rate").alias("_win_rate"))
    moved = lambda c: F.when(F.col("value") != F.col("base"), F.when(F.col(f"_{c}") == 0, F.lit(0.0)).otherwise(
        (F.col(c) - F.col(f"_{c}")) / F.abs(f"_{c}") * 100))
    return rows.join(start, ["name", "parameter"], "left").select(
        "name", "parameter", "base", "value", "ic", "win_rate", "std", "mean",
        moved("ic").alias("ic_change_pct"), moved("win_rate").alias("win_rate_change_pct"))


def classify(rows: DataFrame) -> DataFrame:
    """Verdict by the worst change: robust from -20 %, fragile to -50 %, else sensitive; no_data without any IC."""
    worst = F.min("ic_change_pct")
    verdict = (
        F.when(F.count("ic") == 0, "no_data").when(worst.isNull() | (worst >= ROBUST_FROM), "robust")
        .when(worst <= FRAGILE_TO, "fragile").otherwise("sensitive"))
    return rows.groupBy("name").agg(worst.alias("worst_change_pct"), verdict.alias("classification"))


def sweep_summary(classes: DataFrame) -> DataFrame:
    """Counts per verdict and the names of the weak signals."""
    c = F.col("classification")
    names = lambda v: F.array_join(F.array_sort(F.collect_set(F.when(c == v, F.col("name")))), ",")
    return classes.agg(
        F.count_if(c != "no_data").alias("tested"), F.count_if(c == "robust").alias("robust"),
        F.count_if(c == "sensitive").alias("sensitive"), F.count_if(c == "fragile").alias("fragile"),
        names("fragile").alias("fragile_signals"), names("sensitive").alias("sensitive_signals"))
