"""Feature groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import enrich, features
from tickerloom.queries.registry import ORACLES, query, r, rounded
from tickerloom.queries.sql import BARS, SECTORS, avg_rank, ctes, frame, lag, pct, r as sr, rm, rs, rz, stages
from tickerloom.sources import market


def _panel_sql(*steps: dict[str, str], parts=(BARS,)) -> tuple[str, str]:
    text, last = stages("bars", *steps)
    return ctes(*parts, text), last


def _register(name: str, cols: tuple[str, ...], steps, build, final=None, parts=(BARS,), exact=()):
    text, last = _panel_sql(*steps, parts=parts)
    final = final or {c: c for c in cols}
    shown = ", ".join(f"{final[c] if c in exact else sr(final[c])} AS {c}" for c in cols)

    @query(name, f"{text} SELECT ticker, date, {shown} FROM {last}")
    def run(spark, root):
        df = build(spark, root)
        return df.select("ticker", "date", *[F.col(c) if c in exact else r(c).alias(c) for c in cols])


RET = {f"return_{n}d": pct("close", n) for n in (1, 21, 63)}
_register(
    "features_price",
    ("return_1d", "return_21d", "return_63d", "log_return_1d"),
    [RET | {"log_return_1d": f"ln(close / {lag('close')})"}],
    lambda s, p: features.price_features(market.bars(s, p)),
)
_register(
    "features_volatility",
    ("vol_21d", "vol_63d"),
    [{"return_1d": pct("close", 1)}],
    lambda s, p: features.volatility_features(market.bars(s, p)),
    {"vol_21d": rs("return_1d", 21, 10), "vol_63d": rs("return_1d", 63, 30)},
)
_register(
    "features_volume",
    ("relative_volume_21d", "volume_zscore_63d", "accumulation_distribution", "volume_shock"),
    [
        {
            "relative_volume_21d": f"volume / nullif({rm('volume', 21, 10)}, 0)",
            "volume_zscore_63d": rz("volume", 63, 30),
            "accumulation_distribution": "CAST(sum(CAST(round_even(coalesce((2 * close - high - low) / nullif(high - low, 0), 0) * volume * 1e12, 0) AS HUGEINT)) "
            "OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1e12",
        }
    ],
    lambda s, p: features.volume_features(market.bars(s, p)),
    {
        "relative_volume_21d": "relative_volume_21d",
        "volume_zscore_63d": "volume_zscore_63d",
        "accumulation_distribution": "accumulation_distribution",
        "volume_shock": "CAST(coalesce(volume_zscore_63d > 2, FALSE) AS INTEGER)",
    },
    exact=("volume_shock",),
)


def _share(x: str) -> str:
    rank = avg_rank(x, f"date, {x} IS NULL")
    n = f"count({x}) OVER (PARTITION BY date)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {n} > 1 THEN ({rank} - 1) / ({n} - 1) ELSE 0.5 END"


_register(
    "features_cross_sectional",
    ("cs_return_zscore_21d", "cs_return_rank_21d", "cs_vol_rank_21d", "cs_volume_rank_21d", "sector_relative_return_21d"),
    [
        {"return_1d": pct("close", 1), "return_21d": pct("close", 21), "volume_21d": rm("volume", 21, 10),
         "sector": "(SELECT coalesce(any_value(s.sector), 'Unknown') FROM sectors s WHERE s.ticker = bars.ticker)"},
        {"vol_21d": rs("return_1d", 21, 10)},
    ],
    lambda s, p: features.cross_sectional_features(enrich.enrich_with_sector(market.bars(s, p), market.sectors(s, p))),
    {
        "cs_return_zscore_21d": "(return_21d - avg(return_21d) OVER (PARTITION BY date)) / nullif(stddev_samp(return_21d) OVER (PARTITION BY date), 0)",
        "cs_return_rank_21d": _share("return_21d"),
        "cs_vol_rank_21d": _share("vol_21d"),
        "cs_volume_rank_21d": _share("volume_21d"),
        "sector_relative_return_21d": "return_21d - avg(return_21d) OVER (PARTITION BY date, sector)",
    },
    parts=(BARS, SECTORS),
)

REGIME = f"""ret AS (SELECT *, {pct('close', 1)} AS return_1d FROM bars),
daily AS (SELECT 1 AS k, date, avg(return_1d) AS mkt, avg(CAST(return_1d > 0 AS DOUBLE)) AS regime_breadth FROM ret GROUP BY date),
reg1 AS (SELECT *, {rm('mkt', 21, 10, 'k')} AS regime_market_trend, {rs('mkt', 21, 10, 'k')} AS regime_vol_state FROM daily),
regime AS (SELECT *, CAST(coalesce(regime_vol_state > {rm('regime_vol_state', 252, 21, 'k')}, FALSE) AS INTEGER) AS regime_vol_regime FROM reg1)"""
REGIME_COLS = ("regime_market_trend", "regime_vol_state", "regime_breadth")


@query(
    "features_regime",
    ctes(BARS, REGIME) + " SELECT b.ticker, b.date, " + ", ".join(f"{sr(c)} AS {c}" for c in REGIME_COLS)
    + ", regime_vol_regime FROM bars b JOIN regime r ON b.date = r.date",
)
def features_regime(spark, root):
    df = features.regime_features(market.bars(spark, root))
    return df.select("ticker", "date", *[r(c).alias(c) for c in REGIME_COLS], "regime_vol_regime")


def hurst_steps(out: str) -> list[dict[str, str]]:
    diffs = {f"d{k}": f"ln(close) - ln({lag('close', k)})" for k in (2, 4, 8, 16)}
    y = [f"ln(nullif({rs(f'd{k}', 63, 30)}, 0))" for k in (2, 4, 8, 16)]
    return [diffs, {out: f"(-1.5 * {y[0]} - 0.5 * {y[1]} + 0.5 * {y[2]} + 1.5 * {y[3]}) / (5 * ln(2.0))"}]


def frac_sql() -> str:
    w = features.frac_weights()
    return " + ".join(f"({v!r}::DOUBLE * {lag('close', k)})" if k else "close" for k, v in enumerate(w))


_register("features_hurst", ("hurst_63d",), hurst_steps("hurst_63d"), lambda s, p: features.hurst(market.bars(s, p)))
_register(
    "features_frac_diff", ("frac_diff_1d",), [{"frac_diff_1d": frac_sql()}], lambda s, p: features.frac_diff(market.bars(s, p))
)


def _kalman_sql() -> str:
    """The filter with its covariance as an ordered fold over each ticker's closes."""
    # covariance after the first row: one update from 1000 on the diagonal
    a00, a01, a11 = 2000.05, 1000.0, 1000.001
    s0 = a00 + 1.0
    p = ((1 - a00 / s0) * a00, (1 - a00 / s0) * a01, a11 - a01 / s0 * a01)
    start = f"{{'l': close, 't': 0.0::DOUBLE, 'a': {p[0]!r}::DOUBLE, 'b': {p[1]!r}::DOUBLE, 'c': {p[2]!r}::DOUBLE}}"
    m00, m01, m11 = "(s.a + 2 * s.b + s.c + 0.05::DOUBLE)", "(s.b + s.c)", "(s.c + 0.001::DOUBLE)"
    g0, g1, gap = f"({m00} / ({m00} + 1))", f"({m01} / ({m00} + 1))", "(y.l - s.l - s.t)"
    step = (f"{{'l': s.l + s.t + {g0} * {gap}, 't': s.t + {g1} * {gap}, 'a': (1 - {g0}) * {m00}, 'b': (1 - {g0}) * {m01}, "
            f"'c': {m11} - {g1} * {m01}}}")
    f = "OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"kal AS (SELECT ticker, date, close, list_reduce(list({start}) {f}, lambda s, y: {step}) AS st FROM bars)"


KALMAN = _kalman_sql()


@query(
    "features_kalman",
    ctes(BARS, KALMAN) + f" SELECT ticker, date, {sr('close')} AS close, {sr('st.l')} AS kalman_level, {sr('st.t')} AS kalman_trend FROM kal",
)
def features_kalman(spark, root):
    out = features.kalman_features(market.bars(spark, root).select("ticker", "date", "close"))
    return rounded(out, "close", "kalman_level", "kalman_trend")


def _report_sql() -> str:
    """The report over the rows of the queries of all six categories."""
    sources = {"price": ["features_price"], "volatility": ["features_volatility"], "volume": ["features_volume"],
               "cross_sectional": ["features_cross_sectional"], "regime": ["features_regime"],
               "advanced": ["features_hurst", "features_frac_diff", "features_kalman"]}
    parts = []
    for category, names in sources.items():
        for name in names:
            shown = [c for c in features.list_features(category) if len(names) == 1 or c.startswith(name.removeprefix("features_"))]
            lines = ", ".join(
                f"{{'feature': '{c}', 'nan_rate': {sr(f'count(*) FILTER ({c} IS NULL OR isnan({c}::DOUBLE)) / count(*)')}, "
                f"'has_inf': coalesce(bool_or(isinf({c}::DOUBLE)), FALSE), 'is_constant': coalesce(min({c}) = max({c}), TRUE)}}" for c in shown)
            parts.append(f"SELECT unnest(lines, recursive := true) FROM (SELECT [{lines}] AS lines FROM ({ORACLES[name]}))")
    return " UNION ALL ".join(parts)


@query("feature_report", _report_sql())
def feature_report(spark, root):
    _, report = features.compute_and_validate(enrich.enrich_with_sector(market.bars(spark, root), market.sectors(spark, root)))
    return rounded(report, "nan_rate")
