"""How well signals predict returns: information coefficients, win rates, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.rolling import rolling_mean, series
from tickerloom.operators.signals import signal_columns
from tickerloom.plans.rankic import keyed_rank_ic, pooled_rank_ic
from tickerloom.plans.ranks import average_ranks, series_rank
from tickerloom.plans.scale import settled

MIN_POOLED = 100


def to_long(
    df: DataFrame, signals: Sequence[str], horizons: Sequence[int], keys: Sequence[str], target: str = "forward_return_{h}"
) -> DataFrame:
    """One row per (key, signal, horizon) with both the signal ``s`` and the outcome ``f`` present."""
    cells = [
        F.struct(
            F.lit(s).alias("signal"), F.lit(h).alias("horizon"), F.col(s).cast("double").alias("s"),
            F.col(target.format(h=h)).cast("double").alias("f"),
        )
        for s in signals
        for h in horizons
    ]
    cells = F.filter(F.array(*cells), lambda c: c["s"].isNotNull() & c["f"].isNotNull())
    return df.select(*keys, F.inline(cells))


def safe_corr(x: str, y: str) -> Column:
    """Correlation of two complete columns; NULL where either does not vary (corr itself raises then)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def win_rate_of(s: str = "s", f: str = "f") -> Column:
    """Share of buys (s > 0) followed by a gain; 0.5 without buys."""
    buys = F.count_if(F.col(s) > 0)
    return F.coalesce(F.try_divide(F.count_if((F.col(s) > 0) & (F.col(f) > 0)), buys), F.lit(0.5))


def rank_ic_by(long: DataFrame, keys: Sequence[str], min_rows: int = 2) -> DataFrame:
    """Spearman correlation with average ties per group, with win rate and row count.

    A ticker has at most one row a date: a ticker's group is bounded by the calendar and a date's by the number of
    tickers, and either is ranked by a window. Pooled groups may be of any size.
    """
    rank = series_rank if {"ticker", "date"} & set(keys) else average_ranks
    ranked = rank(long, keys, {"s": "_rs", "f": "_rf"})
    out = ranked.groupBy(*keys).agg(
        safe_corr("_rs", "_rf").alias("ic"), win_rate_of().alias("win_rate"), F.count(F.lit(1)).alias("n_obs")
    )
    return out.withColumn("ic", F.when(F.col("n_obs") >= min_rows, F.col("ic")))


def rank_ic_of(
    df: DataFrame, signals: Sequence[str], horizons: Sequence[int], keys: Sequence[str] = (), min_rows: int = MIN_POOLED,
    target: str = "forward_return_{h}",
) -> DataFrame:
    """The same from a wide frame, all pairs of a signal and an outcome together; ``df`` is read several times where groups are pooled."""
    outcomes, keys = {h: target.format(h=h) for h in horizons}, list(keys)
    if {"ticker", "date"} & set(keys):
        out = keyed_rank_ic(df, keys, signals, outcomes)
    else:
        out = pooled_rank_ic(df, keys, signals, outcomes)
    if out is None:
        return rank_ic_by(to_long(df, signals, horizons, keys, target), [*keys, "signal", "horizon"], min_rows)
    return out.withColumn("ic", F.when(F.col("n_obs") >= min_rows, F.col("ic")))


def needed(df: DataFrame, signals: Sequence[str], horizons: Sequence[int], keys: Sequence = (), target: str = "forward_return_{h}") -> DataFrame:
    """The columns that ranks read, written once."""
    return settled(df.select(*keys, *dict.fromkeys([*signals, *[target.format(h=h) for h in horizons]])))


def rank_ic(df: DataFrame, signal: str, target: str, min_rows: int = MIN_POOLED) -> DataFrame:
    """Pooled rank IC of one signal: one row (ic, win_rate, n_obs); ic NULL under ``min_rows``."""
    pooled = settled(df.select(F.col(signal).cast("double").alias("s"), F.col(target).cast("double").alias("f")).dropna())
    return rank_ic_of(pooled, ["s"], [0], (), min_rows, "f").drop("signal", "horizon")


def ic_decay(df: DataFrame, signals: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Pooled IC of each signal at each horizon."""
    return rank_ic_of(needed(df, signals, horizons), signals, horizons)


def signal_stats(df: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Count, mean and deviation per signal, from one row of aggregates."""
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp}
    one = df.agg(*[f(s).alias(f"{m}_{k}") for k, s in enumerate(signals) for m, f in measures.items()])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("signal"), *[F.col(f"{m}_{k}").alias(m) for m in measures]) for k, s in enumerate(signals)])))


def signal_summary(df: DataFrame, signals: Sequence[str], horizons: Sequence[int] = (1, 5, 21)) -> DataFrame:
    """Wide row per signal: count, mean, std, ic_<h>d and win_rate_<h>d."""
    df = needed(df, signals, horizons)
    by_h = rank_ic_of(df, signals, horizons).groupBy("signal").agg(
        *[F.max(F.when(F.col("horizon") == h, F.col(m))).alias(f"{m}_{h}d") for h in horizons for m in ("ic", "win_rate")]
    )
    return signal_stats(df, signals).join(by_h, "signal", "left")


def cross_sectional_ic(df: DataFrame, signals: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """IC over the tickers of each date; dates with under two usable rows or no variation are left out."""
    keys = ["date", "signal", "horizon"]
    return (
        rank_ic_of(df, signals, horizons, ["date"], 2)
        .filter(F.col("ic").isNotNull()).select(*keys, F.col("ic").alias("cs_ic"), "n_obs")
    )


def rolling_ic(
    cs_ic: DataFrame, horizons: Sequence[int], window: int = 63, min_rows: int | None = None
) -> DataFrame:
    """Trailing mean of the daily IC, shown only once the horizon of each IC has passed."""
    w = series("date", "signal", "horizon")
    out = cs_ic.withColumn("_mean", rolling_mean("cs_ic", window, w, min_rows))
    shown = F.coalesce(*[F.when(F.col("horizon") == h, F.lag("_mean", h).over(w)) for h in horizons])
    return out.select("date", "signal", "horizon", "cs_ic", shown.alias("rolling_ic"))


def cs_ic_stats(cs_ic: DataFrame) -> DataFrame:
    return cs_ic.groupBy("signal", "horizon").agg(
        F.avg("cs_ic").alias("mean_ic"),
        F.coalesce(F.stddev_samp("cs_ic"), F.lit(0.0)).alias("std_ic"),
        F.avg((F.col("cs_ic") > 1e-12).cast("double")).alias("positive_share"),  # above rounding noise
        F.count(F.lit(1)).alias("n_dates"),
    )


def ic_matrix(long: DataFrame, keys: Sequence[str] = ("ticker", "timeframe", "signal", "horizon")) -> DataFrame:
    """IC of every cell of a (ticker, timeframe, signal, horizon) grid."""
    return rank_ic_by(long, list(keys), MIN_POOLED)


def ic_ranking(matrix: DataFrame) -> DataFrame:
    """Per signal: mean, min and max IC over the grid, and the place by mean."""
    summary = matrix.filter(F.col("ic").isNotNull()).groupBy("signal").agg(
        F.avg("ic").alias("mean_ic"), F.min("ic").alias("min_ic"), F.max("ic").alias("max_ic"), F.count(F.lit(1)).alias("cells"))
    # one row per signal name
    return summary.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("mean_ic").desc(), "signal")))


def tier(delta: Column, strong: float = 0.005, mild: float = 0.002) -> Column:
    size = F.abs(delta)
    return F.when(size > strong, "strong").when(size > mild, "mild").otherwise("none")


def compare_universes(
    df: DataFrame, base: Column, other: Column, signals: Sequence[str], horizons: Sequence[int]
) -> DataFrame:
    """IC of each signal in two row sets, their difference, its tier and the relative improvement."""
    sides = F.array_compact(F.array(F.when(base, F.lit("base")), F.when(other, F.lit("other"))))
    tagged = needed(df, signals, horizons, [sides.alias("_sides")]).withColumn("side", F.explode("_sides"))
    ic = rank_ic_of(tagged, signals, horizons, ["side"])
    out = ic.groupBy("signal", "horizon").agg(
        F.max(F.when(F.col("side") == "base", F.col("ic"))).alias("base_ic"),
        F.max(F.when(F.col("side") == "other", F.col("ic"))).alias("other_ic"),
    )
    delta = F.col("other_ic") - F.col("base_ic")
    return out.withColumns(
        {"delta": delta, "tier": tier(delta),
         "improvement_pct": delta / F.abs(F.nullif("base_ic", F.lit(0.0))) * 100})


def forward_test(df: DataFrame, horizons: Sequence[int] = (1, 5, 21), signals: Sequence[str] | None = None) -> DataFrame:
    """IC and win rate per signal and horizon, pooled (scope 'ALL') and per ticker."""
    signals = signal_columns(df) if signals is None else signals
    df = needed(df, signals, horizons, ["ticker"])
    pooled = rank_ic_of(df, signals, horizons).withColumn("scope", F.lit("ALL"))
    single = rank_ic_of(df, signals, horizons, ["ticker"]).withColumnRenamed("ticker", "scope")
    return pooled.unionByName(single).select("scope", "signal", "horizon", "ic", "win_rate", "n_obs")


def compare_periods(
    train: DataFrame, hold_back: DataFrame, signals: Sequence[str], horizons: Sequence[int] = (1, 5, 21)
) -> DataFrame:
    """Training against hold-back IC: change and the share of its size that is kept."""
    t = ic_decay(train, signals, horizons).select("signal", "horizon", F.coalesce("ic", F.lit(0.0)).alias("_t"), F.col("win_rate").alias("_tw"))
    h = ic_decay(hold_back, signals, horizons).select("signal", "horizon", F.coalesce("ic", F.lit(0.0)).alias("_h"), F.col("win_rate").alias("_hw"))
    kept = F.when(F.col("_t") != 0, F.abs("_h") / F.abs("_t") * 100).otherwise(F.lit(0.0))
    return t.join(h, ["signal", "horizon"]).select(
        "signal", "horizon", F.round("_t", 4).alias("train_ic"), F.round("_tw", 4).alias("train_win_rate"),
        F.round("_h", 4).alias("holdback_ic"), F.round("_hw", 4).alias("holdback_win_rate"),
        F.round(F.col("_h") - F.col("_t"), 4).alias("ic_change"), F.round(kept, 1).alias("ic_retention_pct"))


def report_lines(test: DataFrame) -> DataFrame:
    """The pooled forward test as text lines."""
    line = F.format_string(
        "%s @ %dd: IC=%+.4f win=%.1f%% n=%d", "signal", "horizon", F.coalesce("ic", F.lit(0.0)), F.col("win_rate") * 100, "n_obs")
    return test.filter(F.col("scope") == "ALL").select("signal", "horizon", line.alias("line"))
