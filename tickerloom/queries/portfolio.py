"""Sizing, limits, covariance and portfolio construction."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tickerloom.operators import construction as con
from tickerloom.operators import enrich, hierarchy, risk, signals, sizing
from tickerloom.queries.registry import query, r, rounded
from tickerloom.queries.research import CORE, fwd, panel, panel_sql
from tickerloom.queries.sql import BARS, SECTORS, ctes, frame, lag, pct, r as sr, rs
from tickerloom.sources import market

MOM = "signal_momentum_21d"


@query(
    "kelly_fraction",
    f"""SELECT event_id, {sr('''CASE WHEN w > 0 AND l > 0 THEN greatest(0.0, least(0.25, (p * (w / l) - (1 - p)) / (w / l) * 0.25)) ELSE 0.0 END''')} AS kelly
 FROM (SELECT event_id, (user_id % 100) / 100.0::DOUBLE AS p, value / 1000.0::DOUBLE AS w, (CAST(hour(ts) AS DOUBLE)) / 1000.0::DOUBLE AS l FROM events)""",
)
def kelly_fraction(spark, root):
    e = market.table(spark, root, "events")
    k = sizing.kelly_fraction((F.col("user_id") % 100) / 100.0, F.col("value") / 1000.0, F.hour("ts").cast("double") / 1000.0, 0.25)
    return e.select("event_id", r(k).alias("kelly"))


def kelly_sql(signal: str = MOM) -> tuple[str, ...]:
    f = frame(63)
    return (
        BARS, panel_sql(),
        f"k0 AS (SELECT *, {signal} AS sg, lag(sign({signal}) * forward_return_1) OVER w AS tr, lag(forward_return_1) OVER w AS pr FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date))",
        f"""k1 AS (SELECT *, count(tr) {f} AS seen, count(*) FILTER (tr > 0) {f} AS nw, count(*) FILTER (tr < 0) {f} AS nl,
   coalesce(avg(tr) FILTER (tr > 0) {f}, 0) AS g, coalesce(avg(-tr) FILTER (tr < 0) {f}, 0) AS l, {rs('pr', 63)} * sqrt(252.0) AS vol FROM k0)""",
        """k2 AS (SELECT *, coalesce(sg, 0.0) AS signal_value, CASE WHEN seen >= 63 AND g > 0 AND l > 0
   THEN greatest(0.0, least(0.25, (nw / (nw + nl) * (g / l) - (1 - nw / (nw + nl))) / (g / l) * 0.25)) ELSE 0.0 END AS kf FROM k1)""",
        "k3 AS (SELECT *, kf * coalesce(least(1.0, 0.10 / nullif(vol, 0)), 1.0) AS vf FROM k2)",
        "k4 AS (SELECT *, least(vf, 0.20) AS cf, least(vf, 0.20) * sign(signal_value) AS w FROM k3)",
        "k5 AS (SELECT *, sum(abs(w)) OVER (PARTITION BY date) AS gross FROM k4)",
    )


KELLY_COLS = ("signal_value", "kelly_fraction", "vol_targeted_fraction", "capped_fraction", "position_weight", "portfolio_exposure")
KELLY_OUT = f""" SELECT ticker, date, {sr('signal_value')} AS signal_value, {sr('kf')} AS kelly_fraction, {sr('vf')} AS vol_targeted_fraction,
 {sr('cf')} AS capped_fraction, {sr('w * least(1.0, coalesce(1.0 / nullif(gross, 0), 1.0))')} AS position_weight, {sr('least(gross, 1.0)')} AS portfolio_exposure FROM k5"""


@query("kelly_weights", ctes(*kelly_sql()) + KELLY_OUT)
def kelly_weights(spark, root):
    return rounded(sizing.kelly_weights(panel(spark, root), MOM), *KELLY_COLS)


@query("kelly_multi_signal", ctes(*kelly_sql("(" + " + ".join(f"coalesce({s}, 0)" for s in CORE[:2]) + ") / 2")) + KELLY_OUT)
def kelly_multi_signal(spark, root):
    return rounded(sizing.kelly_multi(panel(spark, root), CORE[:2]), *KELLY_COLS)


# weights under test: momentum / 4 with its sector
WEIGHTS = "wts AS (SELECT p.ticker, p.date, p.close, coalesce(signal_momentum_21d, 0) / 4 AS weight, coalesce(s.sector, 'Unknown') AS sector FROM panel p LEFT JOIN sectors s ON p.ticker = s.ticker)"
WP = (BARS, SECTORS, panel_sql(), WEIGHTS)


def weights(spark, root):
    df = enrich.enrich_with_sector(panel(spark, root), market.sectors(spark, root))
    return df.select("ticker", "date", "close", (F.coalesce(MOM, F.lit(0.0)) / 4).alias("weight"), "sector")


def _w(df):
    return df.select("ticker", "date", r("weight").alias("weight"))


def pos_cap(x="weight", lim=0.10):
    return f"greatest(least({x}, {lim}), -{lim})"


def group_cap(x: str, lim: float, keys: str) -> str:
    g = f"sum(abs({x})) OVER (PARTITION BY {keys})"
    return f"{x} * CASE WHEN {g} > {lim} THEN {lim} / ({g}) ELSE 1.0 END"


@query("cap_positions", ctes(*WP) + f" SELECT ticker, date, {sr(pos_cap())} AS weight FROM wts")
def cap_positions(spark, root):
    return _w(risk.cap_positions(weights(spark, root), 0.10))


@query("cap_sectors", ctes(*WP) + f" SELECT ticker, date, {sr(group_cap('weight', 0.30, 'date, sector'))} AS weight FROM wts")
def cap_sectors(spark, root):
    return _w(risk.cap_sectors(weights(spark, root), 0.30))


@query("cap_leverage", ctes(*WP) + f" SELECT ticker, date, {sr(group_cap('weight', 1.0, 'date'))} AS weight FROM wts")
def cap_leverage(spark, root):
    return _w(risk.cap_leverage(weights(spark, root), 1.0))


def hard_sql(source: str, name: str) -> tuple[str, ...]:
    return (
        f"{name}1 AS (SELECT * REPLACE ({pos_cap()} AS weight) FROM {source})",
        f"{name}2 AS (SELECT * REPLACE ({group_cap('weight', 0.3, 'date, sector')} AS weight) FROM {name}1)",
        f"{name} AS (SELECT * REPLACE ({group_cap('weight', 1.5, 'date')} AS weight) FROM {name}2)",
    )


@query("hard_limits", ctes(*WP, *hard_sql("wts", "hl")) + f" SELECT ticker, date, {sr('weight')} AS weight FROM hl")
def hard_limits(spark, root):
    return _w(risk.hard_limits(weights(spark, root), risk.RiskConfig()))


RETURNS = f"rets AS (SELECT ticker, date, {pct('close', 1)} AS ret FROM bars)"
RVOL = f"rvol AS (SELECT ticker, date, {rs('ret', 63)} * sqrt(252.0) AS rv FROM rets)"


def returns(spark, root):
    return con.returns_from_prices(market.bars(spark, root))


@query("returns_from_prices", ctes(BARS, RETURNS) + f' SELECT ticker, date, {sr("ret")} AS "return" FROM rets')
def returns_from_prices(spark, root):
    return rounded(returns(spark, root), "return")


@query("realized_volatility", ctes(BARS, RETURNS, RVOL) + f" SELECT ticker, date, {sr('rv')} AS realized_vol FROM rvol")
def realized_volatility(spark, root):
    return rounded(risk.realized_volatility(returns(spark, root)), "realized_vol")


VT = f"vt AS (SELECT w.* REPLACE (weight * coalesce(least(1.0, 0.10 / nullif(rv, 0)), 1.0) AS weight) FROM wts w LEFT JOIN rvol v ON w.ticker = v.ticker AND w.date = v.date)"


@query("volatility_target", ctes(*WP, RETURNS, RVOL, VT) + f" SELECT ticker, date, {sr('weight')} AS weight FROM vt")
def volatility_target(spark, root):
    return _w(risk.volatility_target(weights(spark, root), returns(spark, root), risk.RiskConfig()))


# equity curve: mean return of all tickers, damped, compounded
EQUITY = """mkt AS (SELECT date, avg(least(greatest(ret, -0.05), 0.05)) AS m FROM rets GROUP BY date),
equity AS (SELECT date, 100000 * exp(sum(coalesce(ln(1 + m - 0.02), 0)) OVER (ORDER BY date)) AS equity FROM mkt),
dd AS (SELECT *, max(equity) OVER (ORDER BY date) AS peak, (max(equity) OVER (ORDER BY date) - equity) / max(equity) OVER (ORDER BY date) AS drawdown FROM equity)"""


def equity(spark, root):
    m = F.avg(F.least(F.greatest("return", F.lit(-0.05)), F.lit(0.05)))
    daily = returns(spark, root).groupBy("date").agg(m.alias("m"))
    run = F.sum(F.coalesce(F.ln(1 + F.col("m") - 0.02), F.lit(0.0))).over(con.calendar_window())
    return daily.select("date", (100000 * F.exp(run)).alias("equity"))


@query("drawdown_series", ctes(BARS, RETURNS, EQUITY) + f" SELECT date, {sr('equity', 3)} AS equity, {sr('peak', 3)} AS peak_equity, {sr('drawdown')} AS drawdown FROM dd")
def drawdown_series(spark, root):
    out = rounded(risk.drawdown_series(equity(spark, root)), "drawdown")
    return out.withColumns({"equity": r("equity", 3), "peak_equity": r("peak_equity", 3)})


BREAK = """ev AS (SELECT date, drawdown, CASE WHEN drawdown >= 0.20 THEN 1 WHEN drawdown <= 0.10 THEN 0 END AS e FROM dd),
br AS (SELECT date, drawdown, CASE WHEN last_value(e IGNORE NULLS) OVER (ORDER BY date) = 1 THEN 0.5 ELSE 1.0 END AS leverage_scale FROM ev)"""


@query("drawdown_breaker", ctes(BARS, RETURNS, EQUITY, BREAK) + f" SELECT date, {sr('drawdown')} AS drawdown, leverage_scale::DOUBLE AS leverage_scale FROM br")
def drawdown_breaker(spark, root):
    out = risk.drawdown_breaker(risk.drawdown_series(equity(spark, root)), risk.RiskConfig())
    return rounded(out, "drawdown").select("date", "drawdown", "leverage_scale")


# the check forms the pairs the job avoids: correlations of zero-filled returns over 30 dates
CORR = """dt AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM rets)),
rt AS (SELECT ticker, t, ret AS x FROM rets JOIN dt ON rets.date = dt.date WHERE ret IS NOT NULL),
wn AS (SELECT ticker, e.t AS e, rt.t, x FROM rt JOIN dt e ON rt.t BETWEEN e.t - 29 AND e.t WHERE e.t >= 30),
ws AS (SELECT ticker, e, sum(x) / 30 AS mu, (sum(x * x) - 30 * (sum(x) / 30) * (sum(x) / 30)) / 29 AS v FROM wn GROUP BY ticker, e),
act AS (SELECT * FROM ws WHERE v > 1e-18),
xy AS (SELECT a.ticker AS i, b.ticker AS j, a.e, sum(a.x * b.x) AS sxy FROM wn a JOIN wn b ON a.e = b.e AND a.t = b.t AND a.ticker < b.ticker GROUP BY ALL),
pc AS (SELECT a.e, sum((coalesce(sxy, 0) - 30 * a.mu * b.mu) / 29 / sqrt(a.v * b.v)) AS s, count(*) AS n
  FROM act a JOIN act b ON a.e = b.e AND a.ticker < b.ticker LEFT JOIN xy ON xy.e = a.e AND xy.i = a.ticker AND xy.j = b.ticker GROUP BY a.e)"""


@query(
    "average_correlation",
    ctes(BARS, RETURNS, CORR) + f" SELECT dt.date, {sr('s / n')} AS avg_correlation, (SELECT count(*) FROM act WHERE act.e = dt.t) AS n_tickers FROM dt LEFT JOIN pc ON pc.e = dt.t WHERE dt.t >= 30",
)
def average_correlation(spark, root):
    return rounded(risk.average_correlation(returns(spark, root)), "avg_correlation")


@query(
    "correlation_spikes",
    ctes(*WP, RETURNS, CORR) + f""" SELECT w.ticker, w.date, {sr('s / n')} AS avg_correlation, coalesce(s / n > 0.02, FALSE) AS correlation_spike
 FROM wts w LEFT JOIN dt ON dt.date = w.date LEFT JOIN pc ON pc.e = dt.t""",
)
def correlation_spikes(spark, root):
    cfg = risk.RiskConfig(correlation_spike_threshold=0.02)
    out = risk.correlation_spikes(weights(spark, root), returns(spark, root), cfg)
    return rounded(out, "avg_correlation").select("ticker", "date", "avg_correlation", "correlation_spike")


@query(
    "risk_overlay",
    ctes(*WP, RETURNS, RVOL, EQUITY, BREAK, CORR, *hard_sql("wts", "ha"),
         "o1 AS (SELECT w.* REPLACE (weight * coalesce(least(1.0, 0.10 / nullif(rv, 0)), 1.0) AS weight) FROM ha w LEFT JOIN rvol v ON w.ticker = v.ticker AND w.date = v.date)",
         "o2 AS (SELECT o1.* REPLACE (weight * coalesce(leverage_scale, 1.0) AS weight), coalesce(leverage_scale, 1.0) AS leverage_scale FROM o1 LEFT JOIN br ON br.date = o1.date)",
         "o3 AS (SELECT o2.* REPLACE (CASE WHEN s / n > 0.02 THEN weight * 0.5 ELSE weight END AS weight) FROM o2 LEFT JOIN dt ON dt.date = o2.date LEFT JOIN pc ON pc.e = dt.t)",
         *hard_sql("o3", "hb")) + f" SELECT ticker, date, {sr('weight', 8)} AS weight, leverage_scale::DOUBLE AS leverage_scale FROM hb",
)
def risk_overlay(spark, root):
    cfg = risk.RiskConfig(correlation_spike_threshold=0.02)
    out = risk.apply_all(weights(spark, root), cfg, returns(spark, root), equity(spark, root))
    return out.select("ticker", "date", r("weight", 8).alias("weight"), "leverage_scale")


# ── targets, orders, checks ──
TARGETS = """strong AS (SELECT ticker, date, signal_momentum_21d AS s FROM panel WHERE abs(signal_momentum_21d) >= 0.1),
picked AS (SELECT * FROM strong QUALIFY row_number() OVER (PARTITION BY date ORDER BY s DESC, ticker) <= 10),
tg AS (SELECT ticker, date, s AS signal, round(s / sum(abs(s)) OVER (PARTITION BY date), 4) AS target_weight FROM picked)"""


def targets(spark, root):
    return sizing.targets(panel(spark, root), MOM, top_n=10)


@query("signal_targets", ctes(BARS, panel_sql(), TARGETS) + f" SELECT ticker, date, {sr('signal')} AS signal, target_weight FROM tg")
def signal_targets(spark, root):
    return rounded(targets(spark, root), "signal")


SCALED = """sc0 AS (SELECT *, sum(abs(target_weight)) OVER (PARTITION BY date) AS g, max(abs(target_weight)) OVER (PARTITION BY date) AS m FROM tg),
sc1 AS (SELECT *, CASE WHEN g > 1 THEN 1 / g ELSE 1.0 END AS k FROM sc0),
scaled AS (SELECT ticker, date, target_weight, target_weight * k * CASE WHEN m * k > 0.10 THEN 0.10 / (m * k) ELSE 1.0 END AS scaled_weight FROM sc1)"""


@query("target_scaling", ctes(BARS, panel_sql(), TARGETS, SCALED) + f" SELECT ticker, date, target_weight, {sr('scaled_weight')} AS scaled_weight FROM scaled")
def target_scaling(spark, root):
    return rounded(sizing.scale_targets(targets(spark, root)), "scaled_weight").select("ticker", "date", "target_weight", "scaled_weight")


HELD = "held AS (SELECT ticker, date, volume AS quantity FROM bars)"
ORDERS = """ord0 AS (SELECT coalesce(t.ticker, h.ticker) AS ticker, coalesce(t.date, h.date) AS date, coalesce(target_weight, 0) AS w, coalesce(quantity, 0) AS q
  FROM tg t FULL OUTER JOIN held h ON t.ticker = h.ticker AND t.date = h.date),
ord1 AS (SELECT o.*, b.close AS price, CAST(CASE WHEN w = 0 THEN 0 ELSE greatest(1, floor(abs(w) * 1000000 / b.close)) * sign(w) END AS BIGINT) - q AS gap
  FROM ord0 o JOIN bars b ON o.ticker = b.ticker AND o.date = b.date WHERE b.close > 0),
orders_ AS (SELECT ticker, date, CASE WHEN gap > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(gap) AS quantity, price, w AS target_weight FROM ord1 WHERE gap <> 0)"""


def orders(spark, root):
    b = market.bars(spark, root)
    return sizing.size_orders(
        targets(spark, root).select("ticker", "date", F.col("target_weight").alias("weight")),
        b.select("ticker", "date", F.col("volume").alias("quantity")), b.select("ticker", "date", F.col("close").alias("price")),
        1_000_000.0, keys=("ticker", "date"))


@query("order_sizing", ctes(BARS, panel_sql(), TARGETS, HELD, ORDERS) + f" SELECT ticker, date, side, quantity, {sr('price')} AS price, target_weight FROM orders_")
def order_sizing(spark, root):
    return rounded(orders(spark, root), "price")


@query(
    "pre_trade_checks",
    ctes(BARS, """o AS (SELECT strftime(date, '%Y-%m') AS account, ticker, date, CASE WHEN volume >= 25 THEN 'BUY' ELSE 'SELL' END AS side, volume AS quantity, close AS price FROM bars)""",
         """hp AS (SELECT strftime(date, '%Y-%m') AS account, ticker, sum(volume * close) / 50 AS market_value FROM bars WHERE volume >= 40 GROUP BY ALL)""",
         """sn AS (SELECT strftime(date, '%Y-%m') AS account, sum(volume * close) / 10 AS portfolio_value, sum(volume * close) / 90 AS cash, (max(close) - 90000) * 10 AS daily_pnl, sum(volume * high) / 9.3 AS peak_equity FROM bars GROUP BY ALL)""",
         "bk AS (SELECT account, count(*) AS nh, sum(market_value) AS ex FROM hp GROUP BY account)",
         """ck AS (SELECT o.*, quantity * price AS cost, s.*, coalesce(nh, 0) AS nh, coalesce(ex, 0) AS ex, h.ticker AS has FROM o JOIN sn s ON s.account = o.account
  LEFT JOIN bk ON bk.account = o.account LEFT JOIN hp h ON h.account = o.account AND h.ticker = o.ticker)""",
         """re AS (SELECT account, ticker, date, side, quantity, price, CASE
  WHEN side = 'BUY' AND has IS NULL AND nh >= 60 THEN 'MAX_POSITIONS'
  WHEN side = 'BUY' AND cost / portfolio_value > 0.10 THEN 'POSITION_WEIGHT'
  WHEN cost > portfolio_value * 0.05 THEN 'ORDER_SIZE'
  WHEN -daily_pnl / portfolio_value >= 0.05 THEN 'DAILY_LOSS'
  WHEN peak_equity > 0 AND (peak_equity - portfolio_value) / peak_equity >= 0.15 THEN 'DRAWDOWN'
  WHEN side = 'BUY' AND cash - cost < portfolio_value * 0.05 AND (cash - portfolio_value * 0.05 <= 0 OR floor((cash - portfolio_value * 0.05) / price) < quantity) THEN 'CASH_RESERVE'
  WHEN side = 'BUY' AND (ex + cost) / portfolio_value > 1.0 THEN 'LEVERAGE' ELSE 'APPROVED' END AS reason FROM ck)""")
    + f" SELECT account, ticker, date, side, quantity, {sr('price')} AS price, reason = 'APPROVED' AS approved, reason FROM re",
)
def pre_trade_checks(spark, root):
    b = market.bars(spark, root).withColumn("account", F.date_format("date", "yyyy-MM"))
    o = b.select("account", "ticker", "date", F.when(F.col("volume") >= 25, "BUY").otherwise("SELL").alias("side"),
                 F.col("volume").alias("quantity"), F.col("close").alias("price"))
    value = F.sum(F.col("volume") * F.col("close"))
    held = b.filter(F.col("volume") >= 40).groupBy("account", "ticker").agg((value / 50).alias("market_value"))
    snap = b.groupBy("account").agg((value / 10).alias("portfolio_value"), (value / 90).alias("cash"),
                                    ((F.max("close") - 90000) * 10).alias("daily_pnl"), (F.sum(F.col("volume") * F.col("high")) / 9.3).alias("peak_equity"))
    return rounded(sizing.check_orders(o, snap, held, sizing.RiskLimits(max_positions=60)), "price")


# ── covariance and construction ──
LOOK, EVERY = 63, 63
WINDOWS = f"""rd AS (SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM rets)),
re AS (SELECT date AS rebalance_date, t FROM rd WHERE t >= {LOOK} AND (t - {LOOK}) % {EVERY} = 0),
rw AS (SELECT rebalance_date, ticker, rd.t - re.t + {LOOK} - 1 AS pos, ret FROM rets JOIN rd ON rets.date = rd.date JOIN re ON rd.t <= re.t AND rd.t > re.t - {LOOK} WHERE ret IS NOT NULL),
rk AS (SELECT rebalance_date, ticker, sum(ret) / {LOOK} AS mu FROM rw GROUP BY ALL HAVING count(*) >= 5),
rx AS (SELECT k.rebalance_date, k.ticker, p.pos, coalesce(w.ret, 0) - mu AS x FROM rk k CROSS JOIN (SELECT unnest(range(0, {LOOK})) AS pos) p
  LEFT JOIN rw w ON w.rebalance_date = k.rebalance_date AND w.ticker = k.ticker AND w.pos = p.pos),
sv AS (SELECT a.rebalance_date, a.ticker AS i, b.ticker AS j, sum(a.x * b.x) / {LOOK} AS s, sum(a.x * a.x * b.x * b.x) / {LOOK} - (sum(a.x * b.x) / {LOOK}) ** 2 AS pi
  FROM rx a JOIN rx b ON a.rebalance_date = b.rebalance_date AND a.pos = b.pos GROUP BY ALL),
lw AS (SELECT rebalance_date, count(*) FILTER (i = j) AS n_assets, least(1.0, greatest(0.0, sum(pi) FILTER (i <> j) / {LOOK} / sum(s * s) FILTER (i <> j))) AS delta FROM sv GROUP BY ALL)"""
CP = (BARS, RETURNS, WINDOWS)


def windows(spark, root):
    return con.return_windows(returns(spark, root), LOOK, EVERY)


@query("covariance_shrinkage", ctes(*CP) + f" SELECT rebalance_date, n_assets, {sr('delta')} AS delta FROM lw")
def covariance_shrinkage(spark, root):
    return rounded(con.shrinkage(windows(spark, root), LOOK), "delta")


@query(
    "covariance_pairs",
    ctes(*CP, SECTORS, "prs AS (SELECT ticker AS i, coalesce(lead(ticker) OVER (PARTITION BY sector ORDER BY ticker), ticker) AS j FROM sectors)")
    + f" SELECT sv.rebalance_date, sv.i AS ticker_a, sv.j AS ticker_b, {sr('CASE WHEN sv.i = sv.j THEN s ELSE (1 - delta) * s END')} AS cov FROM sv JOIN prs ON prs.i = sv.i AND prs.j = sv.j JOIN lw ON lw.rebalance_date = sv.rebalance_date",
)
def covariance_pairs(spark, root):
    from pyspark.sql import Window

    nxt = F.lead("ticker").over(Window.partitionBy("sector").orderBy("ticker"))
    pairs = market.sectors(spark, root).select(F.col("ticker").alias("ticker_a"), F.coalesce(nxt, "ticker").alias("ticker_b"))
    w = windows(spark, root)
    return rounded(con.covariance_rows(w, con.shrinkage(w, LOOK), pairs, LOOK), "cov")


@query(
    "risk_contributions",
    ctes(*CP, "vr AS (SELECT rebalance_date, i AS ticker, s AS v, 1 / sqrt(s) / sum(1 / sqrt(s)) OVER (PARTITION BY rebalance_date) AS w FROM sv WHERE i = j)",
         """cb AS (SELECT sv.rebalance_date, sv.i AS ticker, sum(CASE WHEN sv.i = sv.j THEN s ELSE (1 - delta) * s END * b.w) AS c
  FROM sv JOIN vr b ON b.rebalance_date = sv.rebalance_date AND b.ticker = sv.j JOIN lw ON lw.rebalance_date = sv.rebalance_date GROUP BY ALL)""",
         "ct AS (SELECT a.rebalance_date, a.ticker, a.w, c, sum(a.w * c) OVER (PARTITION BY a.rebalance_date) AS pv FROM vr a JOIN cb ON cb.rebalance_date = a.rebalance_date AND cb.ticker = a.ticker)")
    + f" SELECT rebalance_date, ticker, {sr('w')} AS weight, {sr('c / sqrt(pv)')} AS marginal, {sr('w * c / sqrt(pv)')} AS component, {sr('w * c / pv')} AS share FROM ct",
)
def risk_contributions(spark, root):
    w = windows(spark, root)
    out = con.risk_contributions(con.inverse_volatility(w, LOOK), con.shrinkage(w, LOOK), LOOK)
    return rounded(out, "weight", "marginal", "component", "share")


@query(
    "portfolio_risk",
    ctes(*WP, RETURNS, 'pr AS (SELECT w.date, sum(weight * ret) AS x FROM wts w JOIN rets r ON r.ticker = w.ticker AND r.date = w.date WHERE ret IS NOT NULL GROUP BY w.date)')
    + f" SELECT {sr('stddev_samp(x) * sqrt(252.0)')} AS volatility, {sr('avg(x) * 252')} AS mean_return, {sr('avg(x) / stddev_samp(x) * sqrt(252.0)')} AS sharpe, count(*) AS num_dates FROM pr",
)
def portfolio_risk(spark, root):
    return rounded(con.portfolio_stats(weights(spark, root), returns(spark, root)), "volatility", "mean_return", "sharpe")


@query("returns_pivot", ctes(BARS, RETURNS) + " SELECT date, " + ", ".join(f"{sr(f'''max(CASE WHEN ticker = 'S{i}' THEN ret END)''')} AS S{i}" for i in range(8)) + " FROM rets GROUP BY date")
def returns_pivot(spark, root):
    names = [f"S{i}" for i in range(8)]
    return rounded(con.pivot_returns(returns(spark, root), names), *names)


# Iterated and clustered weights have no SQL: tests hold versions over the whole matrix.
@query("risk_parity_weights")
def risk_parity_weights(spark, root):
    """Weights with the share of risk that each carries."""
    w = windows(spark, root)
    shrink = con.shrinkage(w, LOOK, 0.1)
    out = con.risk_contributions(con.risk_parity(w, LOOK, shrink), shrink, LOOK)
    return rounded(out.select("rebalance_date", "ticker", "weight", "share"), "weight", "share")


@query("risk_parity_target_risk")
def risk_parity_target_risk(spark, root):
    """Weights scaled to 10 % volatility a year."""
    w = windows(spark, root)
    out = con.risk_parity(w, LOOK, con.shrinkage(w, LOOK), target_risk=0.10)
    return rounded(out.select("rebalance_date", "ticker", F.col("w").alias("weight")), "weight")


def _hrp_query(linkage: str) -> None:
    @query(f"hrp_weights_{linkage}")
    def hrp_weights(spark, root):
        return rounded(hierarchy.hrp(windows(spark, root), LOOK, linkage).withColumnRenamed("w", "weight"), "weight")


for _linkage in hierarchy.LINKAGES:
    _hrp_query(_linkage)


@query("hrp_with_clusters")
def hrp_with_clusters(spark, root):
    return rounded(hierarchy.hrp_with_clusters(windows(spark, root), LOOK, 8).withColumnRenamed("w", "weight"), "weight")


@query("portfolio_comparison")
def portfolio_comparison(spark, root):
    """Kelly, risk parity and hierarchical risk parity side by side; the first has SQL of its own below."""
    return rounded(con.compare(panel(spark, root), returns(spark, root), MOM, lookback=LOOK, every=EVERY),
                   "exposure_mean", "mean_weight", "volatility", "sharpe")


@query(
    "portfolio_kelly_analysis",
    ctes(*kelly_sql(), RETURNS, "kw AS (SELECT ticker, date, w * least(1.0, coalesce(1.0 / nullif(gross, 0), 1.0)) AS weight FROM k5)",
         """kd AS (SELECT kw.date, sum(abs(weight)) AS e, sum(weight * coalesce(ret, 0)) AS x, avg(weight) AS w, count(*) AS n
  FROM kw LEFT JOIN rets ON rets.ticker = kw.ticker AND rets.date = kw.date GROUP BY kw.date)""")
    + f""" SELECT 'kelly' AS method, {sr('avg(e)')} AS exposure_mean, count(*) AS num_dates, {sr('sum(w * n) / sum(n)')} AS mean_weight,
 {sr('stddev_samp(x) * sqrt(252.0)')} AS volatility, {sr('avg(x) / stddev_samp(x) * sqrt(252.0)')} AS sharpe FROM kd""",
)
def portfolio_kelly_analysis(spark, root):
    return rounded(con.compare(panel(spark, root), returns(spark, root), MOM, ("kelly",)), "exposure_mean", "mean_weight", "volatility", "sharpe")


@query(
    "portfolio_with_breaker",
    ctes(*kelly_sql(), RETURNS, EQUITY, BREAK, "kw AS (SELECT ticker, date, signal_value, w * least(1.0, coalesce(1.0 / nullif(gross, 0), 1.0)) AS weight FROM k5)")
    + f""" SELECT kw.ticker, kw.date, {sr('weight * coalesce(leverage_scale, 1.0)')} AS weight, 'kelly' AS method, {sr('signal_value')} AS signal_value,
 coalesce(leverage_scale, 1.0)::DOUBLE AS leverage_scale FROM kw LEFT JOIN br ON br.date = kw.date""",
)
def portfolio_with_breaker(spark, root):
    """Kelly weights under an equity curve: halved while the drawdown breaker is tripped."""
    out = con.build_portfolio(panel(spark, root), "kelly", MOM, equity=equity(spark, root))
    return rounded(out, "weight", "signal_value").select("ticker", "date", "weight", "method", "signal_value", "leverage_scale")


@query("portfolio_modulated")
def portfolio_modulated(spark, root):
    """Risk parity weights times the signal."""
    out = con.build_portfolio(panel(spark, root), "risk_parity", MOM, LOOK, EVERY)
    return rounded(out, "weight", "signal_value")


@query("portfolio_hrp_modulated")
def portfolio_hrp_modulated(spark, root):
    """Hierarchical risk parity weights times the signal, under an equity curve."""
    out = con.build_portfolio(panel(spark, root), "hrp", MOM, LOOK, EVERY, "ward", equity(spark, root))
    return rounded(out, "weight", "signal_value")
