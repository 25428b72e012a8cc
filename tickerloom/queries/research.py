"""Predictive power, segments, walk-forward, perturbation, ensembles."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tickerloom.operators import ensemble, meta, metrics, perturbation, signals, validation
from tickerloom.queries import lake
from tickerloom.queries.registry import query, r, rounded
from tickerloom.queries.signals import cs_z
from tickerloom.queries.sql import BARS, LAKE, avg_rank, ctes, lag, pct, r as sr, rm, rs, rz
from tickerloom.plans.scale import discard
from tickerloom.sources import market

CORE = [f"signal_{s}" for s in signals.DAILY_CORE]
HORIZONS = (1, 5, 21)


def panel(spark, root):
    return signals.generate(signals.with_forward_returns(market.bars(spark, root), HORIZONS), signals.DAILY_CORE)


def lean_panel(spark, root, horizons=HORIZONS, written=True):
    """The panel's close, forward returns and signals; written, its series are worked out once, however often it is read."""
    rows = market.bars(spark, root).select("ticker", "date", "close")
    return signals.generate(rows, signals.DAILY_CORE, horizons=horizons, written=written)


def fwd(h: int, keys: str = "ticker") -> str:
    return f"(lead(close, {h}) OVER (PARTITION BY {keys} ORDER BY date) / close - 1)"


def panel_sql(source: str = "bars") -> str:
    return f"""raw AS (SELECT *, {', '.join(f'{fwd(h)} AS forward_return_{h}' for h in HORIZONS)},
  close / nullif({rm('close', 21)}, 0) - 1 AS g21, close / nullif({rm('close', 63)}, 0) - 1 AS g63,
  {pct('close', 21)} AS m21, {pct('close', 63)} AS m63 FROM {source}),
panel AS (SELECT *, -tanh({cs_z('g21')}) AS signal_mean_reversion_21d, -tanh({cs_z('g63')}) AS signal_mean_reversion_63d,
  tanh({cs_z('m21')}) AS signal_momentum_21d, tanh({cs_z('m63')}) AS signal_momentum_63d FROM raw)"""


def long_sql(keys: str, source: str = "panel", sigs=CORE, horizons=HORIZONS, target: str = "forward_return_{h}") -> str:
    k = f"{keys}, " if keys else ""
    cells = " UNION ALL ".join(
        f"SELECT {k}'{s}' AS signal, {h} AS horizon, {s} AS s, {target.format(h=h)} AS f FROM {source}" for s in sigs for h in horizons)
    return f"long AS (SELECT * FROM ({cells}) WHERE s IS NOT NULL AND f IS NOT NULL)"


def ic_sql(keys: str, minimum: int = 2, source: str = "long", name: str = "ic") -> str:
    """IC, win rate and rows by group as a CTE."""
    return f"""{name}_ranked AS (SELECT *, {avg_rank('s', keys)} AS rs_, {avg_rank('f', keys)} AS rf_ FROM {source}),
{name} AS (SELECT {keys}, CASE WHEN count(*) >= {minimum} AND stddev_pop(rs_) > 0 AND stddev_pop(rf_) > 0 THEN corr(rs_, rf_) END AS ic,
  coalesce(count(*) FILTER (s > 0 AND f > 0) / nullif(count(*) FILTER (s > 0), 0), 0.5) AS win_rate, count(*) AS n_obs
  FROM {name}_ranked GROUP BY {keys})"""


@query(
    "lake_to_ic_summary",
    LAKE + f""", a AS (SELECT *, {fwd(5)} AS f, {pct('close', 21)} AS m FROM gold WHERE data_quality IS NOT NULL),
 b AS (SELECT date, 'signal_momentum_21d' AS signal, 5 AS horizon, tanh({cs_z('m')}) AS s, f FROM a),
 long AS (SELECT * FROM b WHERE s IS NOT NULL AND f IS NOT NULL), {ic_sql('date, signal, horizon')}
 SELECT signal, horizon, {sr('avg(ic)')} AS mean_ic, {sr('coalesce(stddev_samp(ic), 0)')} AS std_ic,
  {sr('avg(CAST(ic > 1e-12 AS DOUBLE))')} AS positive_share, count(*) AS n_dates FROM ic WHERE ic IS NOT NULL GROUP BY ALL""",
)
def lake_to_ic_summary(spark, root):
    """Trades → bars → adjusted silver → gold → momentum → daily IC → summary."""
    df = signals.generate(signals.with_forward_returns(lake.gold(spark, root), [5]), ["momentum_21d"])
    ic = metrics.cross_sectional_ic(df, ["signal_momentum_21d"], [5])
    return rounded(metrics.cs_ic_stats(ic), "mean_ic", "std_ic", "positive_share")


@query(
    "forward_returns",
    ctes(BARS) + f" SELECT ticker, date, {', '.join(f'{sr(fwd(h))} AS forward_return_{h}' for h in HORIZONS)} FROM bars",
)
def forward_returns(spark, root):
    cols = [f"forward_return_{h}" for h in HORIZONS]
    return rounded(signals.with_forward_returns(market.bars(spark, root), HORIZONS), *cols).select("ticker", "date", *cols)


IC_OUT = f"{sr('ic')} AS ic, {sr('win_rate')} AS win_rate, n_obs"


@query(
    "pooled_rank_ic",
    ctes(BARS, panel_sql(), "long AS (SELECT 1 AS k, signal_momentum_21d AS s, forward_return_5 AS f FROM panel WHERE signal_momentum_21d IS NOT NULL AND forward_return_5 IS NOT NULL)",
         ic_sql("k", 100)) + f" SELECT {IC_OUT} FROM ic",
)
def pooled_rank_ic(spark, root):
    return rounded(metrics.rank_ic(panel(spark, root), "signal_momentum_21d", "forward_return_5"), "ic", "win_rate")


@query("ic_decay", ctes(BARS, panel_sql(), long_sql(""), ic_sql("signal, horizon", 100)) + f" SELECT signal, horizon, {IC_OUT} FROM ic")
def ic_decay(spark, root):
    return rounded(metrics.ic_decay(panel(spark, root), CORE, HORIZONS), "ic", "win_rate")


@query(
    "signal_summary",
    ctes(BARS, panel_sql(), long_sql(""), ic_sql("signal, horizon", 100),
         "st AS (" + " UNION ALL ".join(f"SELECT '{s}' AS signal, count({s}) AS count, avg({s}) AS mean, stddev_samp({s}) AS std FROM panel" for s in CORE) + ")")
    + f""" SELECT st.signal, any_value(st.count) AS count, {sr('any_value(st.mean)')} AS mean, {sr('any_value(st.std)')} AS std, """
    + ", ".join(f"{sr(f'max(CASE WHEN horizon = {h} THEN {m} END)')} AS {m}_{h}d" for h in HORIZONS for m in ("ic", "win_rate"))
    + " FROM st JOIN ic ON st.signal = ic.signal GROUP BY st.signal",
)
def signal_summary(spark, root):
    cols = ["mean", "std", *[f"{m}_{h}d" for h in HORIZONS for m in ("ic", "win_rate")]]
    return rounded(metrics.signal_summary(panel(spark, root), CORE, HORIZONS), *cols)


CS = (BARS, panel_sql(), long_sql("date"), ic_sql("date, signal, horizon"))


@query("cross_sectional_ic", ctes(*CS) + f" SELECT date, signal, horizon, {sr('ic')} AS cs_ic, n_obs FROM ic WHERE ic IS NOT NULL")
def cross_sectional_ic(spark, root):
    return rounded(metrics.cross_sectional_ic(panel(spark, root), CORE, HORIZONS), "cs_ic")


ROLL = f"CASE WHEN count(ic) OVER w >= 63 THEN avg(ic) OVER w END"


@query(
    "rolling_ic",
    ctes(*CS) + f""", m AS (SELECT *, {ROLL} AS m FROM ic WHERE ic IS NOT NULL
   WINDOW w AS (PARTITION BY signal, horizon ORDER BY date ROWS 62 PRECEDING)),
 l AS (SELECT *, CASE horizon {' '.join(f'WHEN {h} THEN lag(m, {h}) OVER x' for h in HORIZONS)} END AS k FROM m WINDOW x AS (PARTITION BY signal, horizon ORDER BY date))
 SELECT date, signal, horizon, {sr('ic')} AS cs_ic, {sr('k')} AS rolling_ic FROM l""",
)
def rolling_ic(spark, root):
    cs = metrics.cross_sectional_ic(panel(spark, root), CORE, HORIZONS)
    return rounded(metrics.rolling_ic(cs, HORIZONS), "cs_ic", "rolling_ic")


@query(
    "cs_ic_stats",
    ctes(*CS) + f""" SELECT signal, horizon, {sr('avg(ic)')} AS mean_ic, {sr('coalesce(stddev_samp(ic), 0)')} AS std_ic,
 {sr('avg(CAST(ic > 1e-12 AS DOUBLE))')} AS positive_share, count(*) AS n_dates FROM ic WHERE ic IS NOT NULL GROUP BY signal, horizon""",
)
def cs_ic_stats(spark, root):
    cs = metrics.cross_sectional_ic(panel(spark, root), CORE, HORIZONS)
    return rounded(metrics.cs_ic_stats(cs), "mean_ic", "std_ic", "positive_share")


SIDES = """tagged AS (SELECT *, 'base' AS side FROM panel WHERE volume >= 30 UNION ALL SELECT *, 'other' AS side FROM panel WHERE date >= DATE '1998-01-01')"""


@query(
    "compare_universes",
    ctes(BARS, panel_sql(), SIDES, long_sql("side", "tagged"), ic_sql("side, signal, horizon", 100),
         "p AS (SELECT signal, horizon, max(CASE WHEN side = 'base' THEN ic END) AS b, max(CASE WHEN side = 'other' THEN ic END) AS o FROM ic GROUP BY signal, horizon)")
    + f""" SELECT signal, horizon, {sr('b')} AS base_ic, {sr('o')} AS other_ic, {sr('o - b')} AS delta,
 CASE WHEN abs(o - b) > 0.005 THEN 'strong' WHEN abs(o - b) > 0.002 THEN 'mild' ELSE 'none' END AS tier, {sr('(o - b) / abs(nullif(b, 0)) * 100', 4)} AS improvement_pct FROM p""",
)
def compare_universes(spark, root):
    out = metrics.compare_universes(
        panel(spark, root), F.col("volume") >= 30, F.col("date") >= F.lit(date(1998, 1, 1)), CORE, HORIZONS)
    return rounded(out, "base_ic", "other_ic", "delta").withColumn("improvement_pct", r("improvement_pct", 4))


FT = (BARS, panel_sql(), long_sql("ticker AS scope").replace("long AS", "single AS"),
      "both_ AS (SELECT * FROM single UNION ALL SELECT 'ALL', signal, horizon, s, f FROM single)", ic_sql("scope, signal, horizon", 100, "both_"))


@query("forward_test", ctes(*FT) + f" SELECT scope, signal, horizon, {IC_OUT} FROM ic")
def forward_test(spark, root):
    return rounded(metrics.forward_test(panel(spark, root), HORIZONS), "ic", "win_rate")


@query(
    "forward_test_report",
    ctes(*FT) + """ SELECT signal, horizon, format('{} @ {}d: IC={:+.4f} win={:.1f}% n={}', signal, horizon, coalesce(ic, 0.0), win_rate * 100, n_obs) AS line
 FROM ic WHERE scope = 'ALL'""",
)
def forward_test_report(spark, root):
    return metrics.report_lines(metrics.forward_test(panel(spark, root), HORIZONS))


@query(
    "train_vs_holdback",
    ctes(BARS, panel_sql(), "pt AS (SELECT * FROM panel WHERE date < DATE '1999-01-01')", "ph AS (SELECT * FROM panel WHERE date >= DATE '2000-06-01')",
         long_sql("", "pt").replace("long AS", "lt AS"), long_sql("", "ph").replace("long AS", "lh AS"),
         ic_sql("signal, horizon", 100, "lt", "it"), ic_sql("signal, horizon", 100, "lh", "ih"),
         "j AS (SELECT it.signal, it.horizon, coalesce(it.ic, 0) AS t, it.win_rate AS tw, coalesce(ih.ic, 0) AS h, ih.win_rate AS hw FROM it JOIN ih ON it.signal = ih.signal AND it.horizon = ih.horizon)")
    + """ SELECT signal, horizon, round(t, 4) AS train_ic, round(tw, 4) AS train_win_rate, round(h, 4) AS holdback_ic, round(hw, 4) AS holdback_win_rate,
 round(h - t, 4) AS ic_change, round(CASE WHEN t <> 0 THEN abs(h) / abs(t) * 100 ELSE 0 END, 1) AS ic_retention_pct FROM j""",
)
def train_vs_holdback(spark, root):
    p = panel(spark, root)
    return metrics.compare_periods(
        p.filter(F.col("date") < F.lit(date(1999, 1, 1))), p.filter(F.col("date") >= F.lit(date(2000, 6, 1))), CORE, HORIZONS)


# ── segments ──
CUTS = """dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)),
cut AS (SELECT min(date) AS lo, min(CASE WHEN idx = CAST(floor(n * 0.6) AS BIGINT) THEN date END) AS a, min(CASE WHEN idx = CAST(floor(n * 0.8) AS BIGINT) THEN date END) AS b FROM dates),
tagged AS (SELECT bars.*, CASE WHEN date < a THEN 'train' WHEN date < b THEN 'validation' ELSE 'hold_back' END AS segment FROM bars, cut)"""


@query("segment_bounds", ctes(BARS, CUTS) + " SELECT lo AS train_start, a AS train_end, b AS hold_back_start FROM cut")
def segment_bounds(spark, root):
    b = validation.resolve_bounds(market.bars(spark, root).select("ticker", "date"))
    return spark.range(1).select(F.lit(b.train_start).alias("train_start"), F.lit(b.train_end).alias("train_end"),
                                 F.lit(b.hold_back_start).alias("hold_back_start"))


@query("segment_tagging", ctes(BARS, CUTS) + " SELECT ticker, date, segment FROM tagged")
def segment_tagging(spark, root):
    return validation.add_segment(market.bars(spark, root)).select("ticker", "date", "segment")


@query("segment_split", ctes(BARS, CUTS) + " SELECT segment, count(*) AS rows, sum(volume)::BIGINT AS volume FROM tagged GROUP BY segment")
def segment_split(spark, root):
    market.bars(spark, root).createOrReplaceTempView("segment_source")
    parts = [df.groupBy(F.lit(s).alias("segment")).agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))
             for s, df in validation.segment_table(spark, "segment_source").items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "segment_stats",
    ctes(BARS, CUTS) + f""" SELECT segment, count(*) AS rows, min(date) AS start, max(date) AS "end", count(DISTINCT ticker) AS tickers,
 {sr('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM tagged GROUP BY segment""",
)
def segment_stats(spark, root):
    return rounded(validation.segment_stats(validation.add_segment(market.bars(spark, root))), "pct")


# ── walk-forward ──
FOLDS = """fold_dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM {source})),
folds AS (SELECT CAST(k AS INTEGER) AS fold, k * {step} AS a FROM range(0, 10000) t(k) WHERE k * {step} + {train} + {ev} <= (SELECT count(*) FROM fold_dates)),
fold_bounds AS (SELECT fold, (SELECT date FROM fold_dates WHERE idx = a) AS train_start, (SELECT date FROM fold_dates WHERE idx = a + {train} - 1) AS train_end,
  (SELECT date FROM fold_dates WHERE idx = a + {train}) AS eval_start, (SELECT date FROM fold_dates WHERE idx = a + {train} + {ev} - 1) AS eval_end FROM folds)"""


def folds_sql(source="bars", train=504, ev=63, step=21) -> str:
    return FOLDS.format(source=source, train=train, ev=ev, step=step)


def fold_ic_sql(source="panel", target=None) -> tuple[str, ...]:
    t = target or fwd("{h}", "fold, ticker").replace("{{h}}", "{h}")
    ahead = ", ".join(f"{t.format(h=h)} AS f{h}" for h in HORIZONS)
    return (
        f"fold_rows AS (SELECT p.*, fold FROM {source} p JOIN fold_bounds ON date BETWEEN eval_start AND eval_end)",
        f"fold_ahead AS (SELECT *, {ahead} FROM fold_rows)",
        long_sql("fold", "fold_ahead", target="f{h}"),
        ic_sql("fold, signal, horizon"),
    )


@query(
    "walk_forward_folds",
    ctes(BARS, folds_sql()) + """ SELECT fold, train_start, train_end, eval_start, eval_end,
 (SELECT count(*) FROM bars WHERE date BETWEEN train_start AND train_end) AS train_rows,
 (SELECT count(*) FROM bars WHERE date BETWEEN eval_start AND eval_end) AS eval_rows FROM fold_bounds""",
)
def walk_forward_folds(spark, root):
    return validation.fold_table(market.bars(spark, root))


WF = (BARS, panel_sql(), folds_sql(), *fold_ic_sql())


@query(
    "walk_forward_metrics",
    ctes(*WF) + f""" SELECT ic.fold, signal, horizon, {sr('coalesce(ic, 0)')} AS ic, {sr('win_rate')} AS win_rate, n_obs, train_start, train_end, eval_start, eval_end
 FROM ic JOIN fold_bounds b ON ic.fold = b.fold""",
)
def walk_forward_metrics(spark, root):
    return rounded(validation.fold_metrics(panel(spark, root)), "ic", "win_rate")


@query(
    "walk_forward_metrics_level",
    ctes(BARS, panel_sql(), folds_sql(), *fold_ic_sql(target="lead(close, {h}) OVER (PARTITION BY fold, ticker ORDER BY date)"))
    + f""" SELECT ic.fold, signal, horizon, {sr('coalesce(ic, 0)')} AS ic, {sr('win_rate')} AS win_rate, n_obs, train_start, train_end, eval_start, eval_end
 FROM ic JOIN fold_bounds b ON ic.fold = b.fold""",
)
def walk_forward_metrics_level(spark, root):
    return rounded(validation.fold_metrics(panel(spark, root), target="level"), "ic", "win_rate")


AGG = f"""SELECT signal, horizon, count(*) AS fold_count, {sr('avg(coalesce(ic, 0))')} AS mean_ic, {sr('stddev_pop(coalesce(ic, 0))')} AS std_ic,
 {sr('stddev_pop(coalesce(ic, 0)) / nullif(abs(avg(coalesce(ic, 0))), 0)', 3)} AS ic_cv FROM ic GROUP BY signal, horizon"""


def _agg(df):
    return rounded(df, "mean_ic", "std_ic").withColumn("ic_cv", r("ic_cv", 3))


@query("walk_forward", ctes(*WF) + " " + AGG)
def walk_forward(spark, root):
    return _agg(validation.walk_forward(panel(spark, root)))


@query(
    "walk_forward_hold_back",
    ctes(BARS, panel_sql(), CUTS, "held AS (SELECT panel.* FROM panel, cut WHERE date >= b)",
         "hn AS (SELECT count(DISTINCT date) AS hn FROM held)",
         """fold_dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM held)),
sizes AS (SELECT greatest(CAST(floor(hn * 0.6) AS BIGINT), 30) AS tr, greatest(CAST(floor(hn * 0.2) AS BIGINT), 10) AS ev, greatest(CAST(floor(hn * 0.1) AS BIGINT), 5) AS st, hn FROM hn),
folds AS (SELECT CAST(k AS INTEGER) AS fold, k * st AS a, tr, ev FROM range(0, 10000) t(k), sizes WHERE k * st + tr + ev <= hn),
fold_bounds AS (SELECT fold, (SELECT date FROM fold_dates WHERE idx = a + tr) AS eval_start, (SELECT date FROM fold_dates WHERE idx = a + tr + ev - 1) AS eval_end FROM folds)""",
         *fold_ic_sql("held")) + " " + AGG,
)
def walk_forward_hold_back(spark, root):
    return _agg(validation.walk_forward_on_hold_back(lean_panel(spark, root, ())))


# ── perturbation ──
W14, W20, W21, W63 = [11, 13, 14, 15, 17], [16, 18, 20, 22, 24], [17, 19, 21, 23, 25], [50, 57, 63, 69, 76]
LOOK, FORM, FAST, SLOW = "lookback", "formation_days", "fast_period", "slow_period"
PERTURBED = {
    "mean_reversion_21d": {LOOK: W21}, "mean_reversion_63d": {LOOK: W63}, "momentum_21d": {FORM: W21}, "momentum_63d": {FORM: W63},
    "mean_reversion_ts_21d": {LOOK: W21}, "momentum_ts_21d": {FORM: W21}}
PERTURBED_WINDOWS = {
    "bollinger_bands": {LOOK: W20}, "rsi": {LOOK: W14}, "trend_filter": {FAST: W20, SLOW: [48, 54, 60, 66, 72]}, "vol_scaled": {FORM: W21}}


def variant_sql(name: str, parameter: str, v: int, c: str) -> tuple[dict[str, str], str]:
    """Columns from the bars and the score from those, with names that begin with c."""
    if name == "bollinger_bands":
        return {c: f"-{rz('close', v)} / 2.0"}, f"CASE WHEN {c} IS NOT NULL THEN greatest(-1.0, least(1.0, {c})) END"
    if name == "rsi":
        u, d = rm(f"{c}_u", v), rm(f"{c}_d", v)
        move = f"(close - {lag('close')})"
        return ({f"{c}_u": f"CASE WHEN {move} > 0 THEN {move} WHEN {move} <= 0 THEN 0 END",
                 f"{c}_d": f"CASE WHEN {move} < 0 THEN -{move} WHEN {move} >= 0 THEN 0 END"}, f"({d} - {u}) / nullif({d} + {u}, 0)")
    if name == "trend_filter":
        fast, slow = (v, 60) if parameter == FAST else (20, v)
        return {}, f"tanh(10 * ({rm('close', fast)} / nullif({rm('close', slow)}, 0) - 1))"
    if name == "vol_scaled":
        return {f"{c}_r": pct("close", 1), c: pct("close", v)}, f"tanh({c} / nullif({rs(f'{c}_r', 63, 30)} * sqrt({v}.0), 0))"
    raw = f"close / nullif({rm('close', v)}, 0) - 1" if name.startswith("mean") else pct("close", v)
    sign = "-" if name.startswith("mean") else ""
    return {c: raw}, f"{sign}tanh({rz(c, 252, 63)})" if "_ts_" in name else f"{sign}tanh({cs_z(c)})"


def perturb_sql(families=PERTURBED) -> str:
    first, scores, cells = {}, {}, []
    for name, parameters in families.items():
        for parameter, values in parameters.items():
            base = values[2]
            for v in values:
                c = f"{name}_{parameter}_{v}"
                columns, score = variant_sql(name, parameter, v, c)
                first, scores = first | columns, scores | {f"s_{c}": score}
                cells.append(f"SELECT '{name}' AS name, '{parameter}' AS parameter, {base} AS base, {v} AS value, s_{c} AS s, f FROM vz")
    listed = lambda cols: ", ".join(f"{e} AS {n}" for n, e in cols.items())
    return ctes(
        BARS, f"vr AS (SELECT *, {fwd(5)} AS f, {listed(first)} FROM bars)",
        f"vz AS (SELECT f, {listed(scores)} FROM vr)",
        f"cells AS ({' UNION ALL '.join(cells)})", "st AS (SELECT name, parameter, value, stddev_samp(s) AS std, avg(s) AS mean FROM cells GROUP BY ALL)",
        "long AS (SELECT * FROM cells WHERE s IS NOT NULL AND f IS NOT NULL)", ic_sql("name, parameter, base, value", 100),
        "pb AS (SELECT name, parameter, base, value, ic, win_rate FROM ic)",
        """pr AS (SELECT pb.*, std, mean, CASE WHEN pb.value <> pb.base THEN CASE WHEN b.ic = 0 THEN 0 ELSE (pb.ic - b.ic) / abs(b.ic) * 100 END END AS chg,
  CASE WHEN pb.value <> pb.base THEN CASE WHEN b.win_rate = 0 THEN 0 ELSE (pb.win_rate - b.win_rate) / b.win_rate * 100 END END AS wchg
  FROM pb JOIN st USING (name, parameter, value) JOIN pb b ON b.name = pb.name AND b.parameter = pb.parameter AND b.value = b.base)""",
        "cl AS (SELECT name, min(chg) AS worst, CASE WHEN count(ic) = 0 THEN 'no_data' WHEN min(chg) IS NULL OR min(chg) >= -20 THEN 'robust' WHEN min(chg) <= -50 THEN 'fragile' ELSE 'sensitive' END AS classification FROM pr GROUP BY name)",
    )


def _perturb(spark, root, families=PERTURBED):
    return perturbation.perturb(market.bars(spark, root).select("ticker", "date", "close"), list(families))


RUN_SQL = (f" SELECT name, parameter, base, value, {sr('ic')} AS ic, {sr('win_rate')} AS win_rate, {sr('std')} AS std, {sr('mean')} AS mean, {sr('chg', 3)} AS ic_change_pct, {sr('wchg', 3)} AS win_rate_change_pct FROM pr")


def _run(spark, root, families):
    return rounded(_perturb(spark, root, families), "ic", "win_rate", "std", "mean").withColumns(
        {c: r(c, 3) for c in ("ic_change_pct", "win_rate_change_pct")})


@query("perturbation_run", perturb_sql() + RUN_SQL)
def perturbation_run(spark, root):
    return _run(spark, root, PERTURBED)


@query("perturbation_windows", perturb_sql(PERTURBED_WINDOWS) + RUN_SQL)
def perturbation_windows(spark, root):
    """The signals over bands, strength, averages and scaled momentum, both windows of the trend filter."""
    return _run(spark, root, PERTURBED_WINDOWS)


@query("perturbation_classes", perturb_sql() + f" SELECT name, {sr('worst', 3)} AS worst_change_pct, classification FROM cl")
def perturbation_classes(spark, root):
    return perturbation.classify(_perturb(spark, root)).withColumn("worst_change_pct", r("worst_change_pct", 3))


@query(
    "perturbation_summary",
    perturb_sql() + """ SELECT count(*) FILTER (classification <> 'no_data') AS tested, count(*) FILTER (classification = 'robust') AS robust,
 count(*) FILTER (classification = 'sensitive') AS sensitive, count(*) FILTER (classification = 'fragile') AS fragile,
 coalesce(string_agg(name, ',' ORDER BY name) FILTER (classification = 'fragile'), '') AS fragile_signals,
 coalesce(string_agg(name, ',' ORDER BY name) FILTER (classification = 'sensitive'), '') AS sensitive_signals FROM cl""",
)
def perturbation_summary(spark, root):
    return perturbation.sweep_summary(perturbation.classify(_perturb(spark, root)))


# ── ensembles ──
CS5 = (BARS, panel_sql(), long_sql("date", horizons=(5,)), ic_sql("date, signal, horizon"))
WIDE = "wide AS (SELECT p.date, " + ", ".join(f"max(CASE WHEN signal = '{s}' THEN ic END) AS i{k}" for k, s in enumerate(CORE)) + " FROM (SELECT DISTINCT date FROM panel) p LEFT JOIN ic ON ic.date = p.date GROUP BY p.date)"


def weights_sql(method: str, cols: list[str], source: str, keep: str = "date") -> str:
    v = [f"coalesce({c}, 0)" for c in cols]
    if method == "abs_ic":
        raw = [f"abs({x})" for x in v]
    elif method == "positive_ic":
        raw = [f"greatest({x}, 0)" for x in v]
    else:
        raw = [" + ".join(f"CASE WHEN round(abs({o}), 12) < round(abs({x}), 12) THEN 1.0 WHEN round(abs({o}), 12) = round(abs({x}), 12) THEN 0.5 ELSE 0.0 END" for o in v) + " + 0.5" for x in v]
    tot = " + ".join(f"({x})" for x in raw)
    return f"SELECT {keep}, " + ", ".join(
        f"CASE WHEN {tot} > 0 THEN ({x}) / ({tot}) ELSE 1.0 / {len(v)} END AS w{k}" for k, x in enumerate(raw)) + f" FROM {source}"


def _weights_query(method: str) -> None:
    names = ", ".join(f"{sr(f'w{k}')} AS w_{s}" for k, s in enumerate(CORE))

    @query(f"ic_weights_{method}", ctes(*CS5, WIDE, f"ws AS ({weights_sql(method, ['i0', 'i1', 'i2', 'i3'], 'wide')})") + f" SELECT date, {names} FROM ws WHERE date IN (SELECT date FROM ic WHERE ic IS NOT NULL)")
    def run(spark, root):
        wide = ensemble.wide_ic(metrics.cross_sectional_ic(panel(spark, root), CORE, [5]), CORE)
        return wide.select("date", *[r(c).alias(f"w_{s}") for s, c in ensemble.ic_weights({s: F.col(s) for s in CORE}, method).items()])


for _m in ensemble.METHODS:
    _weights_query(_m)


def ensemble_sql() -> tuple[str, ...]:
    known = ", ".join(f"lag(m{k}, 5) OVER (ORDER BY date) AS k{k}" for k in range(4))
    mean = ", ".join(f"CASE WHEN count(i{k}) OVER f >= 21 THEN avg(i{k}) OVER f END AS m{k}" for k in range(4))
    held = ", ".join(f"(SELECT coalesce(k{k}, 0) FROM kn b WHERE b.pos = a.pos - a.pos % 5) AS h{k}" for k in range(4))
    return (
        *CS5, WIDE, f"mn AS (SELECT *, {mean} FROM wide WINDOW f AS (ORDER BY date ROWS 62 PRECEDING))",
        f"kn AS (SELECT *, {known}, row_number() OVER (ORDER BY date) - 1 AS pos FROM mn)", f"hd AS (SELECT date, {held} FROM kn a)",
        f"ws AS ({weights_sql('positive_ic', ['h0', 'h1', 'h2', 'h3'], 'hd')})",
        "ens AS (SELECT panel.*, w0, w1, w2, w3, round(" + " + ".join(f"w{k} * coalesce({s}, 0)" for k, s in enumerate(CORE)) + ", 12) AS signal_ensemble FROM panel JOIN ws ON panel.date = ws.date)",
    )


ENS_W = [f"w_{s}" for s in CORE]


@query(
    "ic_weighted_ensemble",
    ctes(*ensemble_sql()) + " SELECT ticker, date, " + ", ".join(f"{sr(f'w{k}')} AS w_{s}" for k, s in enumerate(CORE)) + f", {sr('signal_ensemble')} AS signal_ensemble FROM ens",
)
def ic_weighted_ensemble(spark, root):
    out = ensemble.run_ensemble(panel(spark, root), signals=CORE)
    return rounded(out, *ENS_W, "signal_ensemble").select("ticker", "date", *ENS_W, "signal_ensemble")


@query("ensemble_scores_only", ctes(*ensemble_sql()) + f" SELECT ticker, date, {sr('signal_ensemble')} AS score FROM ens")
def ensemble_scores_only(spark, root):
    out = ensemble.run_ensemble(panel(spark, root), ensemble.EnsembleConfig(output="score", track_weights=False), CORE)
    return rounded(out, "score").select("ticker", "date", "score")


@query(
    "ensemble_weight_stats",
    ctes(*ensemble_sql()) + " " + " UNION ALL ".join(
        f"SELECT '{s}' AS signal, {sr(f'avg(w{k})')} AS mean, {sr(f'min(w{k})')} AS min, {sr(f'max(w{k})')} AS max, {sr(f'stddev_samp(w{k})')} AS std FROM ens" for k, s in enumerate(CORE)),
)
def ensemble_weight_stats(spark, root):
    return rounded(ensemble.weight_stats(ensemble.run_ensemble(panel(spark, root), signals=CORE), CORE), "mean", "min", "max", "std")


IC5 = (BARS, panel_sql(), long_sql("", horizons=(5,)), ic_sql("signal, horizon", 100))
STATIC_W = "sw AS (SELECT signal, ic, CASE WHEN sum(greatest(ic, 0)) OVER () > 0 THEN greatest(ic, 0) / sum(greatest(ic, 0)) OVER () ELSE 1.0 / count(*) OVER () END AS weight FROM ic)"


@query("static_ensemble_weights", ctes(*IC5, STATIC_W) + f" SELECT signal, {sr('ic')} AS ic, {sr('weight')} AS weight FROM sw")
def static_ensemble_weights(spark, root):
    return rounded(ensemble.static_ensemble(panel(spark, root), CORE)[0], "ic", "weight")


@query(
    "static_ensemble_ic",
    ctes(*IC5, STATIC_W, "se AS (SELECT 1 AS k, round(" + " + ".join(f"(SELECT weight FROM sw WHERE signal = '{s}') * coalesce({s}, 0)" for s in CORE) + ", 12) AS s, forward_return_5 AS f FROM panel WHERE forward_return_5 IS NOT NULL)",
         ic_sql("k", 100, "se", "sic")) + f" SELECT {sr('ic')} AS ic, {sr('win_rate')} AS win_rate, n_obs FROM sic",
)
def static_ensemble_ic(spark, root):
    _, scored = ensemble.static_ensemble(lean_panel(spark, root, [5]), CORE)
    return rounded(metrics.rank_ic(scored, "ensemble_score", "forward_return_5"), "ic", "win_rate")


ALL5 = [*CORE, "signal_ensemble"]
VAL = (*ensemble_sql(), long_sql("date", "ens", ALL5, (5,)).replace("long AS", "el AS"), ic_sql("signal", 100, "el", "fi"), ic_sql("date, signal", 2, "el", "ci"),
       "cs AS (SELECT signal, avg(ic) AS mean_ic, coalesce(stddev_samp(ic), 0) AS std_ic, avg(CAST(ic > 1e-12 AS DOUBLE)) AS ps, count(*) AS n_dates FROM ci WHERE ic IS NOT NULL GROUP BY signal)")


@query(
    "ensemble_validation",
    ctes(*VAL) + f""" SELECT fi.signal, {sr('fi.ic')} AS flat_ic, {sr('fi.win_rate')} AS win_rate, {sr('mean_ic')} AS mean_ic, {sr('std_ic')} AS std_ic, {sr('ps')} AS positive_share, n_dates,
 CASE WHEN fi.signal = 'signal_ensemble' THEN abs(fi.ic) >= (SELECT max(abs(ic)) FROM fi WHERE signal <> 'signal_ensemble') END AS dominates_all
 FROM fi JOIN cs ON fi.signal = cs.signal""",
)
def ensemble_validation(spark, root):
    p = lean_panel(spark, root, [5])
    scored = metrics.needed(ensemble.run_ensemble(p, signals=CORE), ALL5, [5], ["date"])
    discard(p)
    out = ensemble.validate_ensemble(scored, [*CORE, "signal_missing"], written=True)
    return rounded(out, "flat_ic", "win_rate", "mean_ic", "std_ic", "positive_share")


TRAIN_END = date(1999, 1, 1)


def _learner(spark, root):
    p = lean_panel(spark, root, [5])
    return meta.MetaLearner(CORE).fit(p, TRAIN_END), p


# Boosted trees have no SQL: a test walks the trees by hand and measures the evaluation by brute force.
@query("meta_learner_predictions")
def meta_learner_predictions(spark, root):
    m, p = _learner(spark, root)
    return rounded(m.predict(p).select("ticker", "date", "ml_probability", "ml_direction"), "ml_probability")


@query("meta_learner_importance")
def meta_learner_importance(spark, root):
    m, p = _learner(spark, root)
    return rounded(m.feature_importance(p), "importance")


@query("meta_learner_evaluation")
def meta_learner_evaluation(spark, root):
    """Area under the curve and log loss, in the training span and after it."""
    m, p = _learner(spark, root)
    spans = {"train": F.col("date") < F.lit(TRAIN_END), "later": F.col("date") >= F.lit(TRAIN_END)}
    parts = [m.evaluate(p.filter(c)).select(F.lit(s).alias("span"), "auc", "logloss", "n") for s, c in spans.items()]
    return rounded(parts[0].unionByName(parts[1]), "auc", "logloss")


@query("signal_lightgbm_ml")
def signal_ml(spark, root):
    m, p = _learner(spark, root)
    return rounded(m.signal(p).select("ticker", "date", "signal_lightgbm_ml"), "signal_lightgbm_ml")
