"""One query per signal: the library's staged columns against the same formula as SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickerloom.functions.rolling import ema_rows
from tickerloom.operators import signals
from tickerloom.queries.features import KALMAN, REGIME, frac_sql, hurst_steps, _share
from tickerloom.queries.registry import query, r, rounded
from tickerloom.queries.sql import BARS, SECTORS, ctes, lag, pct, r as sr, rm, rs, rv, rz, stages, z60
from tickerloom.sources import market

VOL = "volume::DOUBLE"


def ema_sql(x: str, span: int) -> str:
    keep, n = 1 - 2 / (span + 1), ema_rows(span)
    f = f"OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"
    fold = f"list_reduce(list({x}) {f}, lambda acc, v: acc * {keep!r}::DOUBLE + v)"
    return f"({fold} * {1 - keep!r}::DOUBLE / (1 - pow({keep!r}::DOUBLE, count({x}) {f})))"


def cs_z(x: str) -> str:
    return f"(({x} - avg({x}) OVER (PARTITION BY date)) / nullif(stddev_samp({x}) OVER (PARTITION BY date), 0))"


MOVE = f"(close - {lag('close')})"
RV63 = rz(VOL, 63, 30)

# signal → (stages, score)
FORMULAS: dict[str, tuple[list[dict[str, str]], str]] = {
    "roc": ([{"a": pct("close", 10)}], z60("a")),
    "volume_momentum": ([{"a": f"{pct('close', 10)} * volume"}, {"b": rm("a", 10, 5)}], z60("b")),
    "hurst": (
        [{"a": f"ln(close / {lag('close')})"}, {"b": f"{rv('a', 5, 3)} / nullif({rv('a', 10, 5)}, 0) - 1"}],
        f"-{z60('b')}",
    ),
    "relative_volume": ([{"a": f"volume / nullif({rm(VOL, 60, 30)}, 0) - 1"}], z60("a")),
    "cross_asset_momentum": ([{"a": pct("close", 10)}, {"b": f"a / nullif({rs('a', 20, 10)}, 0)"}], z60("b")),
    "order_flow": (
        [{"a": "(CASE WHEN close > open THEN volume ELSE -volume END) / nullif(volume, 0)"}],
        z60("a"),
    ),
    "macd": (
        [{"a": f"{ema_sql('close', 12)} - {ema_sql('close', 26)}"}, {"b": f"a - {ema_sql('a', 9)}"}],
        z60("b"),
    ),
    "bollinger_bands": (
        [{"a": f"-{rz('close', 20)} / 2.0"}],
        "CASE WHEN a IS NOT NULL THEN greatest(-1.0, least(1.0, a)) END",
    ),
    "rsi": (
        [{"u": f"CASE WHEN {MOVE} > 0 THEN {MOVE} WHEN {MOVE} <= 0 THEN 0 END",
          "d": f"CASE WHEN {MOVE} < 0 THEN -{MOVE} WHEN {MOVE} >= 0 THEN 0 END"}],
        f"({rm('d', 14)} - {rm('u', 14)}) / nullif({rm('d', 14)} + {rm('u', 14)}, 0)",
    ),
    "trend_filter": ([], f"tanh(10 * ({rm('close', 20)} / nullif({rm('close', 60)}, 0) - 1))"),
    "vol_scaled": (
        [{"a": pct("close", 1), "b": pct("close", 21)}],
        f"tanh(b / nullif({rs('a', 63, 30)} * sqrt(21.0), 0))",
    ),
    "volatility_regime": ([{"a": pct("close", 1)}, {"b": rs("a", 21, 10)}], f"-tanh({rz('b', 252, 63)})"),
    "volume_anomaly": (
        [{"a": pct("close", 1)}, {"z": RV63}],
        "CASE WHEN z > 2 THEN sign(a) * tanh(z - 2) WHEN z IS NOT NULL THEN 0.0 END",
    ),
    "vpd": (
        [{"a": pct("close", 10), "b": f"volume / nullif({rm(VOL, 10)}, 0) - 1"}],
        f"tanh(-{z60('a')} * {z60('b')})",
    ),
}
for n in (21, 63):
    gap = f"close / nullif({rm('close', n)}, 0) - 1"
    FORMULAS[f"mean_reversion_{n}d"] = ([{"a": gap}], f"-tanh({cs_z('a')})")
    FORMULAS[f"momentum_{n}d"] = ([{"a": pct("close", n)}], f"tanh({cs_z('a')})")
    FORMULAS[f"mean_reversion_ts_{n}d"] = ([{"a": gap}], f"-tanh({rz('a', 252, 63)})")
    FORMULAS[f"momentum_ts_{n}d"] = ([{"a": pct("close", n)}], f"tanh({rz('a', 252, 63)})")


def sql_for(steps, score: str, out: str, parts=(BARS,)) -> str:
    text, last = stages("bars", *steps)
    return ctes(*parts, *([text] if text else [])) + f" SELECT ticker, date, {sr(score)} AS {out} FROM {last}"


def _one(name: str) -> None:
    steps, score = FORMULAS[name]
    out = f"signal_{name}"

    @query(out, sql_for(steps, score, out))
    def run(spark, root):
        return signals.generate(signals.inputs(market.bars(spark, root), [name]), [name]).select("ticker", "date", r(out).alias(out))


for _name in signals.SIGNALS:
    _one(_name)

COMBOS = {
    "roc_volume": ("roc", "volume_momentum"),
    "roc_hurst": ("roc", "hurst"),
    "relvol_flow": ("relative_volume", "order_flow"),
    "roc_volume_relvol": ("roc", "volume_momentum", "relative_volume"),
}


def combo_sql() -> str:
    used = sorted({p for parts in COMBOS.values() for p in parts})
    text, subs = [], []
    for p in used:
        steps, score = FORMULAS[p]
        body, last = stages("bars", *steps)
        for i in reversed(range(len(steps))):
            body = body.replace(f"t{i} ", f"{p}_t{i} ").replace(f"FROM t{i})", f"FROM {p}_t{i})")
        text.append(body)
        text.append(f"sig_{p} AS (SELECT ticker, date, {score} AS {p} FROM {p}_{last})")
        subs.append(f"JOIN sig_{p} USING (ticker, date)")
    cols = ", ".join(f"{sr('(' + ' + '.join(parts) + f') / {len(parts)}')} AS signal_{n}" for n, parts in COMBOS.items())
    return ctes(BARS, *text) + f" SELECT b.ticker, b.date, {cols} FROM bars b {' '.join(subs)}"


@query("signal_combos", combo_sql())
def signal_combos(spark, root):
    used = sorted({p for parts in COMBOS.values() for p in parts})
    df = signals.generate(signals.inputs(market.bars(spark, root), used), used)
    for name, parts in COMBOS.items():
        df = signals.combo(df, parts, name)
    return df.select("ticker", "date", *[r(f"signal_{n}").alias(f"signal_{n}") for n in COMBOS])


@query(
    "signal_regime_conditional_mr_21d",
    ctes(BARS, REGIME, f"g AS (SELECT *, close / nullif({rm('close', 21)}, 0) - 1 AS a FROM bars)",
         f"s AS (SELECT *, -tanh({cs_z('a')}) AS v FROM g)")
    + f" SELECT s.ticker, s.date, {sr('v * CASE WHEN regime_vol_regime = 1 THEN 0.5 ELSE 1.0 END')} AS signal_regime_conditional_mr_21d FROM s JOIN regime r ON s.date = r.date",
)
def signal_regime_conditional(spark, root):
    out = "signal_regime_conditional_mr_21d"
    return signals.regime_conditional_mean_reversion(market.bars(spark, root)).select("ticker", "date", r(out).alias(out))


@query(
    "signal_cross_sectional_rank",
    sql_for([{"x": pct("close", 21)}, {"share": _share("x")}], "2 * share - 1", "signal_cross_sectional_rank"),
)
def signal_cross_sectional_rank(spark, root):
    out = "signal_cross_sectional_rank"
    return signals.cross_sectional_rank_signal(market.bars(spark, root)).select("ticker", "date", r(out).alias(out))


PAST = "OVER (PARTITION BY ticker, month(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "signal_seasonality",
    sql_for([{"x": pct("close", 1)}],
            f"CASE WHEN count(x) {PAST} >= 10 THEN tanh(avg(x) {PAST} / nullif(stddev_samp(x) {PAST}, 0)) END", "signal_seasonality"),
)
def signal_seasonality(spark, root):
    return signals.seasonality(market.bars(spark, root)).select("ticker", "date", r("signal_seasonality").alias("signal_seasonality"))


@query("signal_frac_diff", sql_for([{"x": frac_sql()}], f"-{z60('x')}", "signal_frac_diff"))
def signal_frac_diff(spark, root):
    return signals.frac_diff_signal(market.bars(spark, root).select("ticker", "date", "close")).select("ticker", "date", r("signal_frac_diff").alias("signal_frac_diff"))


@query("signal_hurst_exponent", sql_for(hurst_steps("x"), f"-{z60('x')}", "signal_hurst_exponent"))
def signal_hurst_exponent(spark, root):
    out = "signal_hurst_exponent"
    return signals.hurst_signal(market.bars(spark, root).select("ticker", "date", "close")).select("ticker", "date", r(out).alias(out))


@query(
    "signal_kalman_filter",
    ctes(BARS, KALMAN, "kt AS (SELECT ticker, date, st.t AS x FROM kal)") + f" SELECT ticker, date, {sr(z60('x'))} AS signal_kalman_filter FROM kt",
)
def signal_kalman_filter(spark, root):
    out = "signal_kalman_filter"
    return signals.kalman_signal(market.bars(spark, root).select("ticker", "date", "close")).select("ticker", "date", r(out).alias(out))


PAIR_KEYS = "ticker_a, ticker_b"
PF = "OVER (PARTITION BY ticker_a, ticker_b ORDER BY date ROWS 59 PRECEDING)"


@query(
    "signal_pairs",
    ctes(BARS, SECTORS, """pairs AS (SELECT ticker AS ticker_a, lead(ticker) OVER (PARTITION BY sector ORDER BY ticker) AS ticker_b FROM sectors)""",
         """j AS (SELECT ticker_a, ticker_b, a.date, ln(a.close) AS a, ln(b.close) AS b FROM pairs
           JOIN bars a ON a.ticker = ticker_a JOIN bars b ON b.ticker = ticker_b AND b.date = a.date)""",
         f"h AS (SELECT *, CASE WHEN count(*) {PF} >= 30 THEN covar_samp(a, b) {PF} / nullif(var_samp(b) {PF}, 0) END AS hedge FROM j)",
         "s AS (SELECT *, a - hedge * b AS sp FROM h)")
    + f" SELECT ticker_a, ticker_b, date, {sr('hedge')} AS hedge_ratio, {sr('sp')} AS spread, {sr('-tanh(' + rz('sp', 60, 30, PAIR_KEYS) + ')')} AS signal_pairs FROM s",
)
def signal_pairs(spark, root):
    nxt = F.lead("ticker").over(Window.partitionBy("sector").orderBy("ticker"))
    pairs = market.sectors(spark, root).select(F.col("ticker").alias("ticker_a"), nxt.alias("ticker_b")).dropna()
    return rounded(signals.pairs_spread(market.bars(spark, root), pairs), "hedge_ratio", "spread", "signal_pairs")


ORTH = ["signal_momentum_63d", "signal_mean_reversion_21d"]


def _resid(y: str, x: str) -> str:
    p = "OVER (PARTITION BY date)"
    return f"{y} - coalesce(regr_intercept({y}, {x}) {p} + regr_slope({y}, {x}) {p} * {x}, 0)"


@query(
    "orthogonalize",
    sql_for([{"m21": pct("close", 21), "m63": pct("close", 63), "g": f"close / nullif({rm('close', 21)}, 0) - 1"},
             {"y": f"tanh({cs_z('m21')})", "x1": f"tanh({cs_z('m63')})", "x2": f"-tanh({cs_z('g')})"},
             {"e1": _resid("y", "x1")}], _resid("e1", "x2"), "signal_momentum_21d_orth"),
)
def orthogonalize(spark, root):
    df = signals.generate(market.bars(spark, root), ["momentum_21d", "momentum_63d", "mean_reversion_21d"])
    out = signals.orthogonalize(df, "signal_momentum_21d", ORTH)
    return out.select("ticker", "date", r("signal_momentum_21d_orth").alias("signal_momentum_21d_orth"))


@query(
    "stationarity",
    ctes(BARS, f"d AS (SELECT ticker, {lag('close')} AS x, close - {lag('close')} AS dx FROM bars)",
         "s AS (SELECT ticker, regr_count(dx, x) AS n, regr_slope(dx, x) AS b, regr_sxx(dx, x) AS sxx, regr_syy(dx, x) AS syy FROM d GROUP BY ticker)")
    + f" SELECT ticker, CAST(n AS BIGINT) AS n_obs, {sr('b')} AS coefficient, {sr('b / sqrt((syy - b * b * sxx) / (n - 2) / sxx)')} AS df_stat FROM s",
)
def stationarity(spark, root):
    return rounded(signals.stationarity(market.bars(spark, root)), "coefficient", "df_stat")
