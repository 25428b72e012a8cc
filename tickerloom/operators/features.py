"""Feature columns per ticker, per date and per market regime.

Feature groups are functions DataFrame → DataFrame. All per-ticker groups use the same
window, so a panel is shuffled by ticker once whatever groups are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.rolling import nonzero, pct_change, rolling_mean, rolling_std, rolling_z, series
from tickerloom.plans.crosssection import join_group_stats, with_cross_section_z
from tickerloom.plans.rolls import Rolls, with_rolled
from tickerloom.plans.ranks import series_rank
from tickerloom.plans.scale import settled

HURST_LAGS = (2, 4, 8, 16)
FRAC_D, FRAC_ROWS = 0.4, 20


def price_features(df: DataFrame, periods: Sequence[int] = (1, 21, 63)) -> DataFrame:
    w = series()
    out = {f"return_{n}d": pct_change("close", n, w) for n in periods}
    out["log_return_1d"] = F.ln(F.try_divide("close", F.lag("close").over(w)))
    return df.withColumns(out)


def volatility_features(df: DataFrame) -> DataFrame:
    df = df if "return_1d" in df.columns else df.withColumn("return_1d", pct_change("close", 1, series()))
    return with_rolled(
        df, lambda w: {"vol_21d": rolling_std("return_1d", 21, w, 10), "vol_63d": rolling_std("return_1d", 63, w, 30)}
    )


def volume_features(df: DataFrame) -> DataFrame:
    w = series()
    spread = F.col("high") - F.col("low")
    place = F.coalesce((2 * F.col("close") - F.col("high") - F.col("low")) / nonzero(spread), F.lit(0.0))
    volume = F.col("volume").cast("double")
    # added up as whole numbers: a running sum of doubles depends on the order in which an engine adds
    flow = F.rint(place * volume * 1e12).cast("decimal(38,0)")
    df = df.withColumn(
        "accumulation_distribution", F.sum(flow).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double") / 1e12
    )
    df = with_rolled(
        df,
        lambda w: {
            "relative_volume_21d": volume / nonzero(rolling_mean(volume, 21, w, 10)),
            "volume_zscore_63d": rolling_z(volume, 63, w, 30),
        },
    )
    return df.withColumn("volume_shock", F.coalesce((F.col("volume_zscore_63d") > 2).cast("int"), F.lit(0)))


def share_rank(df: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Average ranks scaled to [0, 1], ``value: out``; a lone row gets 0.5."""
    df = series_rank(df, keys, values, count="_count")
    for value, out in values.items():
        n = F.col(f"{out}_count")
        share = F.when(n > 1, (F.col(out) - 1) / (n - 1)).otherwise(F.lit(0.5))
        df = df.withColumn(out, F.when(F.col(value).isNotNull(), share)).drop(f"{out}_count")
    return df


def cross_sectional_features(df: DataFrame) -> DataFrame:
    w = series()
    if "return_21d" not in df.columns:
        df = df.withColumn("return_21d", pct_change("close", 21, w))
    if "vol_21d" not in df.columns:
        df = volatility_features(df)
    df = with_rolled(df, lambda w: {"_volume_21d": rolling_mean(F.col("volume").cast("double"), 21, w, 10)})
    df = with_cross_section_z(df, {"cs_return_zscore_21d": "return_21d"})
    df = share_rank(df, ["date"], {
        "return_21d": "cs_return_rank_21d", "vol_21d": "cs_vol_rank_21d", "_volume_21d": "cs_volume_rank_21d"})
    if "sector" not in df.columns:
        df = df.withColumn("sector", F.lit("Unknown"))
    df = join_group_stats(df, {"_sector_mean": F.avg("return_21d")}, ["date", "sector"])
    return df.withColumn("sector_relative_return_21d", F.col("return_21d") - F.col("_sector_mean")).drop(
        "_sector_mean", "_volume_21d"
    )


def calendar_window() -> Window:
    """Order over the dates of a one-row-per-date table, which the calendar keeps small."""
    return Window.partitionBy(F.lit(1)).orderBy("date")


def market_regime(df: DataFrame) -> DataFrame:
    """One row per date: trend, volatility state, breadth and high-volatility flag of the market."""
    if "return_1d" not in df.columns:
        df = df.withColumn("return_1d", pct_change("close", 1, series()))
    daily = df.groupBy("date").agg(
        F.avg("return_1d").alias("_mkt"),
        F.avg((F.col("return_1d") > 0).cast("double")).alias("regime_breadth"),
    )
    w = calendar_window()
    return (
        daily.withColumns(
            {"regime_market_trend": rolling_mean("_mkt", 21, w, 10), "regime_vol_state": rolling_std("_mkt", 21, w, 10)}
        )
        .withColumn("_usual", rolling_mean("regime_vol_state", 252, w, 21))
        .withColumn(
            "regime_vol_regime", F.coalesce((F.col("regime_vol_state") > F.col("_usual")).cast("int"), F.lit(0))
        )
        .select("date", "regime_market_trend", "regime_vol_state", "regime_breadth", "regime_vol_regime")
    )


def regime_features(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(market_regime(df)), "date", "left")


def hurst(df: DataFrame, rows: int = 63, min_rows: int = 30, out: str = "hurst_63d") -> DataFrame:
    """Slope of log std of lagged log differences over log lag; the lags double, so the
    least-squares slope over four points has fixed weights."""
    w = series()
    log_price = F.ln("close")
    diffs = {f"_d{k}": log_price - F.lag(log_price, k).over(w) for k in HURST_LAGS}
    df = df.withColumns(diffs)

    def slope(w: Rolls) -> Column:
        ys = [F.ln(nonzero(rolling_std(f"_d{k}", rows, w, min_rows))) for k in HURST_LAGS]
        return (-1.5 * ys[0] - 0.5 * ys[1] + 0.5 * ys[2] + 1.5 * ys[3]) / (5 * F.ln(F.lit(2.0)))

    return with_rolled(df, lambda w: {out: slope(w)}).drop(*diffs)


def frac_weights(d: float = FRAC_D, rows: int = FRAC_ROWS) -> list[float]:
    weights = [1.0]
    for k in range(1, rows):
        weights.append(-weights[-1] * (d - k + 1) / k)
    return weights


def frac_diff(df: DataFrame, d: float = FRAC_D, rows: int = FRAC_ROWS, out: str = "frac_diff_1d") -> DataFrame:
    """Fixed-width fractional difference of the close; NULL until the width is filled."""
    w = series()
    total: Column = F.lit(0.0)
    for k, weight in enumerate(frac_weights(d, rows)):
        total = total + F.lit(weight) * F.lag("close", k).over(w)
    return df.withColumn(out, total)


def kalman_gains(n: int, level_var: float, trend_var: float, noise_var: float) -> list[tuple[float, float]]:
    """Gains of a local linear trend filter; they do not depend on the data and settle quickly."""
    p00, p01, p11 = 1e3, 0.0, 1e3
    gains: list[tuple[float, float]] = []
    for _ in range(n):
        a00, a01, a11 = p00 + 2 * p01 + p11 + level_var, p01 + p11, p11 + trend_var
        s = a00 + noise_var
        g0, g1 = a00 / s, a01 / s
        p00, p01, p11 = (1 - g0) * a00, (1 - g0) * a01, a11 - g1 * a01
        gains.append((g0, g1))
        if len(gains) > 1 and abs(g0 - gains[-2][0]) < 1e-15 and abs(g1 - gains[-2][1]) < 1e-15:
            break
    return gains


#: Rows of the longest series that gains are worked out for; they settle after some hundred rows unless a variance is 0.
LONGEST = 36_525


def _stretches(gains: list[tuple[float, float]], n: pd.Series, closes: pd.Series, level: np.ndarray, trend: np.ndarray):
    """Run many stretches of rows side by side: yields which are still running and their states, row by row.

    ``n`` counts a series' rows ahead of its stretch; a series begins at its first price, whatever is ahead of it.
    """
    lens, n = np.array([len(c) for c in closes]), n.to_numpy()
    prices = np.full((lens.max(initial=0), len(lens)), np.nan)
    prices.T[np.arange(len(prices)) < lens[:, None]] = np.concatenate(closes.tolist()) if len(lens) else []
    table = np.array(gains)
    for k, price in enumerate(prices):
        live, first = lens > k, n + k == 0
        g0, g1 = table[np.minimum(n + k, len(table) - 1)].T
        ahead = level + trend
        gap = price - ahead
        level = np.where(live, np.where(first, price, ahead + g0 * gap), level)
        trend = np.where(live, np.where(first, 0.0, trend + g1 * gap), trend)
        yield live, level, trend


def kalman_features(
    df: DataFrame, level_var: float = 0.05, trend_var: float = 0.001, noise_var: float = 1.0, chunk: str = "month"
) -> DataFrame:
    """kalman_level (filtered price) and kalman_trend (its trend).

    Gains depend on a row's number alone, so a stretch of rows maps the state ahead of it to the one
    behind it by a 2 x 2 matrix and a vector. Each (ticker, month) works out its map by itself,
    the maps of the months before give its starting state, and it runs through its rows once more;
    an Arrow batch of months runs side by side. From a null close on, a ticker's values are null.
    """
    gains = kalman_gains(LONGEST, level_var, trend_var, noise_var)
    cols = [c for c in df.columns if c not in ("kalman_level", "kalman_trend")]

    @F.pandas_udf("l double, t double, a0 double, a1 double, b0 double, b1 double")
    def mapped(n: pd.Series, closes: pd.Series) -> pd.DataFrame:
        out, none = [], closes.map(np.zeros_like)
        for y, level, trend in ((closes, 0.0, 0.0), (none, 1.0, 0.0), (none, 0.0, 1.0)):
            state = np.full(len(n), level), np.full(len(n), trend)
            for _, *state in _stretches(gains, n, y, *state):
                pass
            out += state
        return pd.DataFrame(dict(zip(("l", "t", "a0", "a1", "b0", "b1"), out)))

    @F.pandas_udf("array<double>")
    def filtered(n: pd.Series, closes: pd.Series, level: pd.Series, trend: pd.Series) -> pd.Series:
        steps = list(_stretches(gains, n, closes, level.to_numpy(), trend.to_numpy()))
        levels, trends = (np.array([s[k] for s in steps]) for k in (1, 2))
        return pd.Series([np.concatenate([levels[:m, j], trends[:m, j]]) for j, m in enumerate(closes.map(len))])

    row = F.struct(F.col("date").alias("_o"), F.col("close").cast("double").alias("_y"), F.struct(*cols).alias("_r"))
    parts = df.groupBy("ticker", F.date_trunc(chunk, "date").alias("_c")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    before = Window.partitionBy("ticker").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_n", F.coalesce(F.sum(F.size("_rows")).over(before), F.lit(0)))
    parts = parts.withColumn("_map", mapped("_n", "_rows._y"))
    zero = F.when(F.col("_n") >= 0, F.lit(0.0))  # nullable, as later states are
    start = F.aggregate(
        F.collect_list("_map").over(before), F.struct(zero.alias("l"), zero.alias("t")),
        lambda s, m: F.struct((m["l"] + m["a0"] * s["l"] + m["b0"] * s["t"]).alias("l"), (m["t"] + m["a1"] * s["l"] + m["b1"] * s["t"]).alias("t")))
    parts = parts.withColumn("_start", start).withColumn("_run", filtered("_n", "_rows._y", "_start.l", "_start.t"))
    shown = [F.get("_run", k) for k in (F.col("_k"), F.col("_k") + F.col("_m"))]
    rows = parts.select("_run", F.size("_rows").alias("_m"), F.posexplode("_rows").alias("_k", "_x"))
    return rows.select("_x._r", *[F.when(~F.isnan(v), v).alias(c) for c, v in zip(("kalman_level", "kalman_trend"), shown)]).select(
        "_r.*", "kalman_level", "kalman_trend")


def compute_kalman_level(df: DataFrame) -> DataFrame:
    return kalman_features(df).drop("kalman_trend")


def compute_kalman_trend(df: DataFrame) -> DataFrame:
    return kalman_features(df).drop("kalman_level")


def advanced_features(df: DataFrame) -> DataFrame:
    return kalman_features(frac_diff(hurst(df)))


@dataclass(frozen=True)
class FeatureGroup:
    category: str
    columns: tuple[str, ...]
    build: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()


FEATURE_GROUPS = {
    g.category: g
    for g in (
        FeatureGroup("price", ("return_1d", "return_21d", "return_63d", "log_return_1d"), price_features, ("close",)),
        FeatureGroup("volatility", ("vol_21d", "vol_63d"), volatility_features, ("return_1d",)),
        FeatureGroup(
            "volume",
            ("relative_volume_21d", "volume_zscore_63d", "accumulation_distribution", "volume_shock"),
            volume_features,
            ("high", "low", "close", "volume"),
        ),
        FeatureGroup(
            "cross_sectional",
            (
                "cs_return_zscore_21d",
                "cs_return_rank_21d",
                "cs_vol_rank_21d",
                "cs_volume_rank_21d",
                "sector_relative_return_21d",
            ),
            cross_sectional_features,
            ("return_21d", "vol_21d", "volume"),
        ),
        FeatureGroup(
            "regime",
            ("regime_market_trend", "regime_vol_state", "regime_breadth", "regime_vol_regime"),
            regime_features,
            ("return_1d",),
        ),
        FeatureGroup("advanced", ("hurst_63d", "frac_diff_1d", "kalman_level", "kalman_trend"), advanced_features, ("close",)),
    )
}


def list_features(category: str | None = None) -> list[str]:
    return [c for g in FEATURE_GROUPS.values() if category in (None, g.category) for c in g.columns]


def missing_dependencies(columns: Sequence[str], categories: Sequence[str]) -> dict[str, list[str]]:
    """Per category, the inputs that neither the table nor an asked-for category supplies."""
    have = set(columns) | {c for k in categories for c in FEATURE_GROUPS[k].columns}
    return {k: sorted(set(FEATURE_GROUPS[k].needs) - have) for k in categories if set(FEATURE_GROUPS[k].needs) - have}


def compute_features(df: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Add the features of the given categories (all when None), in dependency order."""
    asked = list(FEATURE_GROUPS) if categories is None else list(categories)
    unknown = set(asked) - set(FEATURE_GROUPS)
    if unknown:
        raise ValueError(f"unknown feature categories: {sorted(unknown)}")
    for name, group in FEATURE_GROUPS.items():
        if name in asked:
            df = group.build(df)
    return df


def feature_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: NULL/NaN share, whether it holds infinities, whether it is constant; one pass."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [
            F.count_if(x.isNull() | F.isnan(x)).alias(f"_nan_{c}"),
            F.count_if(F.abs(x) == float("inf")).alias(f"_inf_{c}"),
            F.min(x).alias(f"_min_{c}"),
            F.max(x).alias(f"_max_{c}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("feature"),
            (F.col(f"_nan_{c}") / F.col("_n")).alias("nan_rate"),
            (F.col(f"_inf_{c}") > 0).alias("has_inf"),
            F.coalesce(F.col(f"_min_{c}") == F.col(f"_max_{c}"), F.lit(True)).alias("is_constant"),
        )
        for c in columns
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def compute_and_validate(df: DataFrame, categories: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """All features, and their report. The report's columns are worked out a category at a time, from rows written once."""
    out = compute_features(df, categories)
    asked = list(FEATURE_GROUPS) if categories is None else list(categories)
    by_ticker = [k for k in ("price", "volatility", "volume") if k in asked]
    shown = [c for k in by_ticker for c in FEATURE_GROUPS[k].columns]
    needs = {"ticker", "date", "sector", "close", "return_1d"}
    read = needs.union(shown, *(FEATURE_GROUPS[k].needs for k in asked if k not in by_ticker))
    base = compute_features(df, by_ticker)
    base = settled(base.select([c for c in base.columns if c in read]))
    parts = [feature_report(base, shown)] if shown else []
    for k in asked:
        if k not in by_ticker:
            group = FEATURE_GROUPS[k]
            rows = base.select([c for c in base.columns if c in needs.union(group.needs)])
            parts.append(feature_report(group.build(rows), group.columns))
    return out, reduce(DataFrame.unionByName, parts)
