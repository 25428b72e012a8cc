"""What the library offers, beside the table it would run over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.timeframe import parse_minutes
from tickerloom.operators import features, monitor, perturbation, signals, validation
from tickerloom.queries.portfolio import MOM
from tickerloom.queries.registry import query, r, rounded
from tickerloom.queries.research import CUTS, panel, panel_sql
from tickerloom.queries.sql import BARS, ctes, r as sr
from tickerloom.sources import market


def listed(totals: DataFrame, names: Sequence[str], rows: Sequence[tuple], keep: Sequence[str] = ()) -> DataFrame:
    """A short list as rows beside the one row of totals."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return totals.select(*keep, F.inline(F.array(*cells)))


def counted(spark, root: str, *aggs: Column) -> DataFrame:
    return market.bars(spark, root).agg(F.count(F.lit(1)).alias("bars"), *aggs)


@query(
    "feature_catalogue",
    ctes(BARS) + """ SELECT category, feature, bars FROM (SELECT count(*) AS bars FROM bars), (VALUES
 ('price', 'return_1d'), ('price', 'return_21d'), ('price', 'return_63d'), ('price', 'log_return_1d'), ('volatility', 'vol_21d'), ('volatility', 'vol_63d'),
 ('volume', 'relative_volume_21d'), ('volume', 'volume_zscore_63d'), ('volume', 'accumulation_distribution'), ('volume', 'volume_shock'),
 ('cross_sectional', 'cs_return_zscore_21d'), ('cross_sectional', 'cs_return_rank_21d'), ('cross_sectional', 'cs_vol_rank_21d'),
 ('cross_sectional', 'cs_volume_rank_21d'), ('cross_sectional', 'sector_relative_return_21d'), ('regime', 'regime_market_trend'),
 ('regime', 'regime_vol_state'), ('regime', 'regime_breadth'), ('regime', 'regime_vol_regime'), ('advanced', 'hurst_63d'),
 ('advanced', 'frac_diff_1d'), ('advanced', 'kalman_level'), ('advanced', 'kalman_trend')) t(category, feature)""",
)
def feature_catalogue(spark, root):
    rows = [(k, c) for k, g in features.FEATURE_GROUPS.items() for c in g.columns]
    return listed(counted(spark, root), ("category", "feature"), rows, ["bars"])


@query(
    "signal_catalogue",
    ctes(BARS) + """ SELECT signal, category, bars FROM (SELECT count(*) AS bars FROM bars), (VALUES
 ('roc', 'momentum'), ('volume_momentum', 'volume'), ('hurst', 'regime'), ('relative_volume', 'volume'), ('cross_asset_momentum', 'momentum'),
 ('order_flow', 'volume'), ('macd', 'momentum'), ('mean_reversion_21d', 'mean_reversion'), ('mean_reversion_63d', 'mean_reversion'),
 ('momentum_21d', 'momentum'), ('momentum_63d', 'momentum'), ('mean_reversion_ts_21d', 'time_series'), ('mean_reversion_ts_63d', 'time_series'),
 ('momentum_ts_21d', 'time_series'), ('momentum_ts_63d', 'time_series'), ('bollinger_bands', 'mean_reversion'), ('rsi', 'mean_reversion'),
 ('trend_filter', 'momentum'), ('vol_scaled', 'momentum'), ('volatility_regime', 'regime'), ('volume_anomaly', 'volume'), ('vpd', 'volume')) t(signal, category)""",
)
def signal_catalogue(spark, root):
    return listed(counted(spark, root), ("signal", "category"), [(s.name, s.category) for s in signals.SIGNALS.values()], ["bars"])


@query(
    "timeframe_minutes",
    """SELECT timeframe, minutes, ceil(span / 60 / minutes)::BIGINT AS intervals FROM
 (SELECT epoch(max(ts)) - epoch(min(ts)) AS span FROM events), (VALUES ('1min', 1.0::DOUBLE), ('5m', 5.0::DOUBLE), ('15m', 15.0::DOUBLE), ('30m', 30.0::DOUBLE),
 ('1h', 60.0::DOUBLE), ('4h', 240.0::DOUBLE), ('1d', 1440.0::DOUBLE), ('30s', 0.5::DOUBLE), ('7', 7.0::DOUBLE), ('soon', 1.0::DOUBLE)) t(timeframe, minutes)""",
)
def timeframe_minutes(spark, root):
    """How many intervals of each length the tick table spans."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    span = market.table(spark, root, "events").agg(((F.max(ts) - F.min(ts)) / 1e6).alias("span"))
    rows = [(t, float(parse_minutes(t))) for t in ("1min", "5m", "15m", "30m", "1h", "4h", "1d", "30s", "7", "soon")]
    out = listed(span, ("timeframe", "minutes"), rows, ["span"])
    return out.select("timeframe", "minutes", F.ceil(F.col("span") / 60 / F.col("minutes")).alias("intervals"))


@query(
    "perturbed_parameters",
    ctes(BARS) + """ SELECT signal, parameter, base, value, bars FROM (SELECT count(*) AS bars FROM bars), (VALUES
 ('mean_reversion_21d', 'lookback', 21, 17), ('mean_reversion_21d', 'lookback', 21, 19), ('mean_reversion_21d', 'lookback', 21, 21), ('mean_reversion_21d', 'lookback', 21, 23),
 ('mean_reversion_21d', 'lookback', 21, 25), ('momentum_63d', 'formation_days', 63, 50), ('momentum_63d', 'formation_days', 63, 57), ('momentum_63d', 'formation_days', 63, 63),
 ('momentum_63d', 'formation_days', 63, 69), ('momentum_63d', 'formation_days', 63, 76), ('macd', 'fast_period', 12, 10), ('macd', 'fast_period', 12, 11), ('macd', 'fast_period', 12, 12),
 ('macd', 'fast_period', 12, 13), ('macd', 'fast_period', 12, 14), ('macd', 'slow_period', 26, 21), ('macd', 'slow_period', 26, 23), ('macd', 'slow_period', 26, 26),
 ('macd', 'slow_period', 26, 29), ('macd', 'slow_period', 26, 31)) t(signal, parameter, base, value)""",
)
def perturbed_parameters(spark, root):
    """Values a window-length parameter is moved to."""
    rows = [(s, p, base, v) for s in ("mean_reversion_21d", "momentum_63d", "macd")
            for p, base in perturbation.tunable(signals.SIGNALS[s]).items() for v in perturbation.perturbed(base)]
    return listed(counted(spark, root), ("signal", "parameter", "base", "value"), rows, ["bars"])


@query(
    "segment_defaults",
    ctes(BARS) + """ SELECT segment, start, bars FROM (VALUES ('train', DATE '2014-01-02'), ('validation', DATE '2020-01-02'), ('hold_back', DATE '2023-01-03')) t(segment, start),
 (SELECT count(*) AS bars FROM bars)""",
)
def segment_defaults(spark, root):
    b = validation.SegmentBounds()
    rows = list(zip(validation.SEGMENTS, (b.train_start, b.validation_start, b.hold_back_start)))
    return listed(counted(spark, root), ("segment", "start"), rows, ["bars"])


@query("segment_coverage", ctes(BARS, CUTS) + f" SELECT segment, {sr('count(*) / (SELECT count(*) FROM bars)')} AS share FROM tagged GROUP BY segment")
def segment_coverage(spark, root):
    tagged = validation.add_segment(market.bars(spark, root).select("ticker", "date"))
    shares = validation.assert_segment_coverage(tagged)
    return tagged.groupBy("segment").agg(F.count(F.lit(1)).alias("_n")).select(
        "segment", r(F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("segment"))).alias("share"))


@query("ticker_ranges_of_panel", ctes(BARS, panel_sql()) + f" SELECT ticker, min(date) AS first_date, max(date) AS last_date, count({MOM}) AS scored FROM panel GROUP BY ticker")
def ticker_ranges_of_panel(spark, root):
    """First and last date per ticker, and the rows that carry a signal."""
    return panel(spark, root).groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(MOM).alias("scored"))


@query(
    "leverage_alerts",
    ctes(BARS, "l AS (SELECT strftime(date, '%Y') AS account, date, sum(close * volume) / (sum(close) * 24) AS leverage FROM bars GROUP BY ALL)")
    + f" SELECT account, date, 'leverage_exceeded' AS alert_type, 'critical' AS severity, {sr('leverage')} AS value, {monitor.Thresholds().max_leverage}::DOUBLE AS threshold FROM l WHERE leverage > {monitor.Thresholds().max_leverage}",
)
def leverage_alerts(spark, root):
    """Accounts whose exposure exceeds their equity."""
    exposure, equity = F.sum(F.col("close") * F.col("volume")), F.sum("close") * 24
    book = market.bars(spark, root).groupBy(F.date_format("date", "yyyy").alias("account"), "date").agg((exposure / equity).alias("leverage"))
    book = book.withColumns({"current_drawdown": F.lit(0.0), "daily_return": F.lit(0.0)})
    return rounded(monitor.account_alerts(book), "value")
