"""Trading signals in [-1, 1].

A signal is declared as stages of columns over a ticker's rows. Signals asked for
together share the stages, so any number of them needs one shuffle by ticker a stage, plus one
broadcast of per-date statistics when a cross-sectional signal is among them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.rolling import (
    clip,
    ema,
    lag,
    nonzero,
    pct_change,
    rolling_max,
    rolling_mean,
    rolling_std,
    rolling_sum,
    rolling_var,
    rolling_z,
    series,
    z60,
)
from tickerloom.operators.features import frac_diff, hurst, kalman_features, market_regime, share_rank
from tickerloom.plans.crosssection import join_date_stats
from tickerloom.plans.rolls import Rolls, with_rolled
from tickerloom.plans.scale import settled

Stage = Mapping[str, Callable[[Rolls], Column]]


@dataclass(frozen=True)
class Signal:
    name: str
    category: str
    stages: tuple[Stage, ...]
    score: Callable[[Rolls], Column]
    cross_section: str | None = None  # column whose per-date z-score feeds `score` as _z_<name>
    params: Mapping[str, int] = field(default_factory=dict)

    @property
    def column(self) -> str:
        return f"signal_{self.name}"


def _ret(n: int, x: str = "close"):
    return lambda w: pct_change(x, n, w)


def _volume() -> Column:
    return F.col("volume").cast("double")


def _roc() -> Signal:
    return Signal("roc", "momentum", ({"_roc": _ret(10)},), lambda w: z60("_roc", w))


def _volume_momentum() -> Signal:
    return Signal(
        "volume_momentum",
        "volume",
        (
            {"_vmom_in": lambda w: pct_change("close", 10, w) * _volume()},
            {"_vmom": lambda w: rolling_mean("_vmom_in", 10, w, 5)},
        ),
        lambda w: z60("_vmom", w),
    )


def _hurst_proxy() -> Signal:
    return Signal(
        "hurst",
        "regime",
        (
            {"_lr": lambda w: F.ln(F.try_divide("close", lag("close", 1, w)))},
            {"_vr": lambda w: rolling_var("_lr", 5, w, 3) / nonzero(rolling_var("_lr", 10, w, 5)) - 1},
        ),
        lambda w: -z60("_vr", w),
    )


def _relative_volume() -> Signal:
    return Signal(
        "relative_volume",
        "volume",
        ({"_relvol": lambda w: _volume() / nonzero(rolling_mean(_volume(), 60, w, 30)) - 1},),
        lambda w: z60("_relvol", w),
    )


def _cross_asset_momentum() -> Signal:
    return Signal(
        "cross_asset_momentum",
        "momentum",
        (
            {"_cam_ret": _ret(10)},
            {"_cam": lambda w: F.col("_cam_ret") / nonzero(rolling_std("_cam_ret", 20, w, 10))},
        ),
        lambda w: z60("_cam", w),
    )


def _order_flow() -> Signal:
    def imbalance(w: Rolls) -> Column:
        signed = F.when(F.col("close") > F.col("open"), _volume()).otherwise(-_volume())
        return signed / nonzero(_volume())

    return Signal("order_flow", "volume", ({"_flow": imbalance},), lambda w: z60("_flow", w))


def macd(fast: int = 12, slow: int = 26, smooth: int = 9) -> Signal:
    line, gap = f"_macd_{fast}_{slow}", f"_macd_gap_{fast}_{slow}_{smooth}"
    return Signal(
        "macd",
        "momentum",
        (
            {line: lambda w: ema("close", fast, w) - ema("close", slow, w)},
            {gap: lambda w: F.col(line) - ema(line, smooth, w)},
        ),
        lambda w: z60(gap, w),
        params={"fast_period": fast, "slow_period": slow, "smooth": smooth},
    )


def mean_reversion(lookback: int = 21, cross_sectional: bool = True) -> Signal:
    raw = f"_gap_{lookback}"
    stage = {raw: lambda w: F.try_divide("close", rolling_mean("close", lookback, w)) - 1}
    if cross_sectional:
        name = f"mean_reversion_{lookback}d"
        return Signal(name, "mean_reversion", (stage,), lambda w: -F.tanh(f"_z_{name}"), raw, {"lookback": lookback})
    name = f"mean_reversion_ts_{lookback}d"
    return Signal(
        name, "time_series", (stage,), lambda w: -F.tanh(rolling_z(raw, 252, w, 63)), None, {"lookback": lookback}
    )


def momentum(formation_days: int = 21, cross_sectional: bool = True) -> Signal:
    raw = f"_mom_{formation_days}"
    stage = {raw: _ret(formation_days)}
    params = {"formation_days": formation_days}
    if cross_sectional:
        name = f"momentum_{formation_days}d"
        return Signal(name, "momentum", (stage,), lambda w: F.tanh(f"_z_{name}"), raw, params)
    name = f"momentum_ts_{formation_days}d"
    return Signal(name, "time_series", (stage,), lambda w: F.tanh(rolling_z(raw, 252, w, 63)), None, params)


def bollinger(n: int = 20, width: float = 2.0) -> Signal:
    def score(w: Rolls) -> Column:
        return clip(-rolling_z("close", n, w) / width, -1.0, 1.0)

    return Signal("bollinger_bands", "mean_reversion", (), score, params={"lookback": n})


def rsi(n: int = 14) -> Signal:
    def score(w: Rolls) -> Column:
        up, down = rolling_mean("_up", n, w), rolling_mean("_down", n, w)
        return clip((down - up) / nonzero(up + down), -1.0, 1.0)

    move = lambda w: F.col("close") - lag("close", 1, w)
    return Signal(
        "rsi",
        "mean_reversion",
        ({"_up": lambda w: F.greatest(move(w), F.lit(0.0)) + move(w) * 0,
          "_down": lambda w: F.greatest(-move(w), F.lit(0.0)) + move(w) * 0},),
        score,
        params={"lookback": n},
    )


def trend_filter(fast: int = 20, slow: int = 60) -> Signal:
    def score(w: Rolls) -> Column:
        base = rolling_mean("close", slow, w)
        gap = rolling_mean("close", fast, w) / nonzero(base) - 1
        return F.tanh(10 * gap)

    return Signal("trend_filter", "momentum", (), score, params={"fast_period": fast, "slow_period": slow})


def vol_scaled(n: int = 21) -> Signal:
    raw = f"_vs_mom_{n}"
    return Signal(
        "vol_scaled",
        "momentum",
        ({"_vs_ret": _ret(1), raw: _ret(n)},),
        lambda w: F.tanh(F.col(raw) / nonzero(rolling_std("_vs_ret", 63, w, 30) * (n**0.5))),
        params={"formation_days": n},
    )


def _volatility_regime() -> Signal:
    return Signal(
        "volatility_regime",
        "regime",
        ({"_vg_ret": _ret(1)}, {"_vg": lambda w: rolling_std("_vg_ret", 21, w, 10)}),
        lambda w: -F.tanh(rolling_z("_vg", 252, w, 63)),
    )


def _volume_anomaly() -> Signal:
    def score(w: Rolls) -> Column:
        z = rolling_z(_volume(), 63, w, 30)
        return F.when(z > 2, F.signum(F.col("_va_ret")) * F.tanh(z - 2)).when(z.isNotNull(), F.lit(0.0))

    return Signal("volume_anomaly", "volume", ({"_va_ret": _ret(1)},), score)


def _volume_price_divergence() -> Signal:
    return Signal(
        "vpd",
        "volume",
        ({"_vp_p": _ret(10), "_vp_v": lambda w: F.try_divide(_volume(), rolling_mean(_volume(), 10, w)) - 1},),
        lambda w: F.tanh(-z60("_vp_p", w) * z60("_vp_v", w)),
    )


SIGNALS: dict[str, Signal] = {
    s.name: s
    for s in (
        _roc(),
        _volume_momentum(),
        _hurst_proxy(),
        _relative_volume(),
        _cross_asset_momentum(),
        _order_flow(),
        macd(),
        mean_reversion(21),
        mean_reversion(63),
        momentum(21),
        momentum(63),
        mean_reversion(21, False),
        mean_reversion(63, False),
        momentum(21, False),
        momentum(63, False),
        bollinger(),
        rsi(),
        trend_filter(),
        vol_scaled(),
        _volatility_regime(),
        _volume_anomaly(),
        _volume_price_divergence(),
    )
}
DAILY_CORE = (
    "mean_reversion_21d",
    "mean_reversion_63d",
    "momentum_21d",
    "momentum_63d",
)


def list_signals(category: str | None = None) -> list[str]:
    return [s.name for s in SIGNALS.values() if category in (None, s.category)]


def inputs(df: DataFrame, signals: Sequence[str]) -> DataFrame:
    """The columns that signals read: what travels with a series is not pruned."""
    volume = any(SIGNALS[s].category == "volume" for s in signals)
    return df.select("ticker", "date", "close", *(["open", "volume"] if volume else []))


def generate(
    df: DataFrame, signals: Sequence[Signal | str], ts: str = "date", horizons: Sequence[int] = (), written: bool = False,
) -> DataFrame:
    """Add the signal columns and nothing else but forward returns over ``horizons``, which share the first stage's exchange.

    ``written``: per-date statistics and rows both come from a frame written ahead of them, not from the series worked out twice.
    """
    chosen = [SIGNALS[s] if isinstance(s, str) else s for s in signals]
    helpers: list[str] = []
    for depth in range(max((len(s.stages) for s in chosen), default=0)):
        stage = {n: f for s in chosen if depth < len(s.stages) for n, f in s.stages[depth].items()}
        helpers += list(stage)
        ahead = {f"forward_return_{h}": forward_return(h) for h in horizons} if depth == 0 else {}
        df = with_rolled(df, lambda w: {n: f(w) for n, f in (ahead | stage).items()}, ts)
    crossed = [s for s in chosen if s.cross_section]
    if crossed:
        df = settled(df) if written else df
        inputs = sorted({s.cross_section for s in crossed})
        aggs = {f"_avg{x}": F.avg(x) for x in inputs} | {f"_std{x}": F.stddev_samp(x) for x in inputs}
        df = join_date_stats(df, aggs)
        df = df.withColumns(
            {
                f"_z_{s.name}": (F.col(s.cross_section) - F.col(f"_avg{s.cross_section}"))
                / nonzero(f"_std{s.cross_section}")
                for s in crossed
            }
        )
        helpers += [*aggs, *(f"_z_{s.name}" for s in crossed)]
    return with_rolled(df, lambda w: {s.column: s.score(w) for s in chosen}, ts).drop(*helpers)


def signal_columns(df: DataFrame) -> list[str]:
    """Columns named signal_*, without the ensemble's own output."""
    return [c for c in df.columns if c.startswith("signal_") and c != "signal_ensemble"]


def forward_return(h: int) -> Callable[[Rolls], Column]:
    return lambda w: F.try_divide(lag("close", -h, w), "close") - 1


def with_forward_returns(df: DataFrame, horizons: Sequence[int] = (1, 5, 21), ts: str = "date") -> DataFrame:
    w = series(ts)
    return df.withColumns(
        {f"forward_return_{h}": F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1 for h in horizons}
    )


def generate_all(df: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    return generate(df, [s for s in SIGNALS.values() if categories is None or s.category in categories])


def generate_all_with_forward_returns(
    df: DataFrame, categories: Sequence[str] | None = None, horizons: Sequence[int] = (1, 5, 21)
) -> DataFrame:
    return generate_all(with_forward_returns(df, horizons), categories)


def combo(df: DataFrame, parts: Sequence[str], name: str) -> DataFrame:
    """Equal-weight mean of signals; NULL where any part is."""
    total = sum((F.col(f"signal_{p}") for p in parts[1:]), F.col(f"signal_{parts[0]}"))
    return df.withColumn(f"signal_{name}", total / len(parts))


def regime_conditional_mean_reversion(df: DataFrame, lookback: int = 21) -> DataFrame:
    """Mean reversion at full weight in calm markets, half weight in volatile ones."""
    base = mean_reversion(lookback)
    out = generate(df, [base]).join(F.broadcast(market_regime(df).select("date", "regime_vol_regime")), "date", "left")
    gate = F.when(F.col("regime_vol_regime") == 1, 0.5).otherwise(1.0)
    return out.withColumn(f"signal_regime_conditional_mr_{lookback}d", F.col(base.column) * gate).drop(
        "regime_vol_regime", base.column
    )


def cross_sectional_rank_signal(df: DataFrame, n: int = 21) -> DataFrame:
    df = df.withColumn("_ret", pct_change("close", n, series()))
    df = share_rank(df, ["date"], {"_ret": "_share"})
    return df.withColumn("signal_cross_sectional_rank", 2 * F.col("_share") - 1).drop("_ret", "_share")


def seasonality(df: DataFrame) -> DataFrame:
    """Mean daily return of the same calendar month in the ticker's past, squashed by its spread."""
    by_month = Window.partitionBy("ticker", F.month("date")).orderBy("date")
    past = by_month.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_ret", pct_change("close", 1, series()))
    enough = F.count("_ret").over(past) >= 10
    z = F.avg("_ret").over(past) / nonzero(F.stddev_samp("_ret").over(past))
    return df.withColumn("signal_seasonality", F.when(enough, F.tanh(z))).drop("_ret")


def frac_diff_signal(df: DataFrame) -> DataFrame:
    df = frac_diff(df, out="_fd")
    return with_rolled(df, lambda w: {"signal_frac_diff": -z60("_fd", w)}).drop("_fd")


def hurst_signal(df: DataFrame) -> DataFrame:
    """Positive where the rolling exponent says mean-reverting (below its own average)."""
    df = hurst(df, out="_h")
    return with_rolled(df, lambda w: {"signal_hurst_exponent": -z60("_h", w)}).drop("_h")


def kalman_signal(df: DataFrame) -> DataFrame:
    df = kalman_features(df)
    return with_rolled(df, lambda w: {"signal_kalman_filter": z60("kalman_trend", w)}).drop("kalman_level", "kalman_trend")


def pairs_spread(df: DataFrame, pairs: DataFrame, n: int = 60, min_rows: int = 30) -> DataFrame:
    """Rolling z-score of the log-price spread for the given (ticker_a, ticker_b) pairs.

    Only listed pairs are joined, on date, so the work is pairs × dates.
    """
    log_close = F.ln("close")
    a = df.select(F.col("ticker").alias("ticker_a"), "date", log_close.alias("_a"))
    b = df.select(F.col("ticker").alias("ticker_b"), "date", log_close.alias("_b"))
    both = pairs.select("ticker_a", "ticker_b").join(a, "ticker_a").join(b, ["ticker_b", "date"])
    w = series("date", "ticker_a", "ticker_b")
    f = w.rowsBetween(-(n - 1), 0)
    beta = F.when(F.count(F.lit(1)).over(f) >= min_rows, F.covar_samp("_a", "_b").over(f) / nonzero(F.var_samp("_b").over(f)))
    return (
        both.withColumn("hedge_ratio", beta)
        .withColumn("spread", F.col("_a") - F.col("hedge_ratio") * F.col("_b"))
        .withColumn("signal_pairs", -F.tanh(rolling_z("spread", n, w, min_rows)))
        .select("ticker_a", "ticker_b", "date", "hedge_ratio", "spread", "signal_pairs")
    )


def orthogonalize(df: DataFrame, target: str, regressors: Sequence[str], out: str | None = None) -> DataFrame:
    """Residual of one signal on others, date by date, one regressor after another."""
    out = out or f"{target}_orth"
    df = df.withColumn("_res", F.col(target))
    for x in regressors:
        both = F.col("_res").isNotNull() & F.col(x).isNotNull()
        y_, x_ = F.when(both, F.col("_res")), F.when(both, F.col(x))
        slope = F.try_divide(F.covar_pop(y_, x_), F.var_pop(x_))
        df = join_date_stats(df, {"_b": slope, "_a": F.avg(y_) - slope * F.avg(x_)})
        fit = F.coalesce(F.col("_a") + F.col("_b") * F.col(x), F.lit(0.0))
        df = df.withColumn("_res", F.col("_res") - fit).drop("_a", "_b")
    return df.withColumnRenamed("_res", out)


def stationarity(df: DataFrame, column: str = "close") -> DataFrame:
    """Dickey-Fuller regression per ticker: coefficient and t-statistic of Δx on lag x."""
    w = series()
    prev = F.lag(column).over(w)
    df = df.withColumns({"_x": prev, "_dx": F.col(column) - prev})
    sums = df.groupBy("ticker").agg(
        F.regr_count("_dx", "_x").alias("n_obs"),
        F.try_divide(F.regr_sxy("_dx", "_x"), F.regr_sxx("_dx", "_x")).alias("coefficient"),
        F.regr_sxx("_dx", "_x").alias("_sxx"),
        F.regr_syy("_dx", "_x").alias("_syy"),
    )
    residual = (F.col("_syy") - F.col("coefficient") ** 2 * F.col("_sxx")) / nonzero(F.col("n_obs") - 2.0)
    t = F.col("coefficient") / nonzero(F.sqrt(residual / nonzero("_sxx")))
    return sums.select("ticker", "n_obs", "coefficient", t.alias("df_stat"))
