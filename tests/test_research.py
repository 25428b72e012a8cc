import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.functions.timeframe import parse_minutes, parse_seconds
from tickerloom.operators import ensemble, features, meta, metrics, perturbation, risk, signals, sizing, validation


@pytest.fixture(scope="module")
def panel(spark, make_bars):
    series = {f"T{k}": [(100 + 50 * k) * (1 + 0.02 * math.sin(0.1 * i + k)) + 0.05 * i for i in range(300)] for k in range(5)}
    df = signals.with_forward_returns(make_bars(series, dt.date(2019, 1, 3)), (1, 5, 21))
    return signals.generate(df, signals.DAILY_CORE).persist()


CORE = [f"signal_{s}" for s in signals.DAILY_CORE]


def test_feature_registry():
    assert list(features.FEATURE_GROUPS) == ["price", "volatility", "volume", "cross_sectional", "regime", "advanced"]
    assert [len(features.list_features(c)) for c in ("volume", "cross_sectional", "regime")] == [4, 5, 4]
    assert features.missing_dependencies(["close"], ["volatility"]) == {"volatility": ["return_1d"]}
    assert features.missing_dependencies(["close"], ["price", "volatility"]) == {}


def test_feature_bounds(spark, make_bars):
    series = {f"T{k}": [100 + 10 * k + 5 * math.sin(0.3 * i + k) for i in range(120)] for k in range(4)}
    out, report = features.compute_and_validate(make_bars(series))
    pdf = out.toPandas()
    for c in ("cs_return_rank_21d", "cs_vol_rank_21d", "cs_volume_rank_21d", "regime_breadth"):
        assert pdf[c].dropna().between(0, 1).all()
    assert pdf["volume_shock"].isin([0, 1]).all() and pdf["regime_vol_regime"].isin([0, 1]).all()
    assert pdf["hurst_63d"].dropna().between(-0.5, 2.0).all()
    assert {r["feature"] for r in report.collect()} == set(features.list_features())


def test_kalman_over_months_equals_a_loop(spark):
    """Stretches composed by their maps: gaps of months, a series of one row, a null close, columns beside the inputs."""
    rng, start = np.random.default_rng(3), dt.date(1999, 12, 25)
    series = {"A": sorted(rng.choice(900, 400, replace=False)), "B": [5], "C": [0, 40, 41, 200, 2000], "N": list(range(30, 50))}
    rows = [(k, start + dt.timedelta(days=int(d)), None if (k, i) == ("N", 12) else float(rng.uniform(50, 150)), i, -1.0)
            for k, days in series.items() for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, i int, kalman_level double")
    got = {(r["ticker"], r["i"]): r for r in features.kalman_features(df).collect()}
    assert len(got) == len(rows)
    gains = features.kalman_gains(500, 0.05, 0.001, 1.0)
    level = trend = None
    for k, date, close, i, _ in rows:
        r = got[k, i]
        if (k, i) >= ("N", 12):
            assert r["kalman_level"] is None and r["kalman_trend"] is None or i < 12
            if i >= 12:
                continue
        g0, g1 = gains[min(i, len(gains) - 1)]
        level, trend = (close, 0.0) if i == 0 else (level + trend + g0 * (close - level - trend), trend + g1 * (close - level - trend))
        assert (r["date"], r["close"]) == (date, close) and r["kalman_level"] == pytest.approx(level, rel=1e-10)
        assert r["kalman_trend"] == pytest.approx(trend, rel=1e-8, abs=1e-10)
    assert features.kalman_features(df.limit(0)).count() == 0


def test_kalman_gains_follow_the_matrix_recursion():
    f, h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]])
    q, p = np.diag([0.05, 0.001]), np.eye(2) * 1e3
    for g0, g1 in features.kalman_gains(50, 0.05, 0.001, 1.0):
        p = f @ p @ f.T + q
        k = p @ h.T / (h @ p @ h.T + 1.0)
        assert (g0, g1) == pytest.approx((k[0, 0], k[1, 0]), rel=1e-9)
        p = (np.eye(2) - k @ h) @ p


def test_signals_are_bounded_and_keep_rows(spark, make_bars, panel):
    out = signals.generate_all(make_bars({"A": [100 + math.sin(i) * 5 for i in range(150)], "B": [50 + math.cos(i) for i in range(150)]}))
    cols = signals.signal_columns(out)
    assert len(cols) == len(signals.SIGNALS) and out.count() == 300
    top = out.agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first().asDict()
    assert all(v is None or v <= 1.0 for v in top.values())
    assert not [c for c in out.columns if c.startswith("_")]
    empty = signals.generate_all_with_forward_returns(make_bars({}), ["momentum"])
    assert empty.count() == 0 and "signal_roc" in empty.columns


def test_rank_ic_needs_a_hundred_rows(panel):
    few = panel.filter(F.col("signal_momentum_21d").isNotNull()).limit(50)
    assert metrics.rank_ic(few, "signal_momentum_21d", "forward_return_1").first()["ic"] is None
    row = metrics.rank_ic(panel, "signal_momentum_21d", "forward_return_1").first()
    pdf = panel.select("signal_momentum_21d", "forward_return_1").dropna().toPandas().rank()
    assert row["ic"] == pytest.approx(pdf.corr().iloc[0, 1], abs=1e-9)


def test_single_ticker_has_no_cross_section(panel):
    assert metrics.cross_sectional_ic(panel.filter("ticker = 'T0'"), CORE, [5]).count() == 0


def test_folds_and_walk_forward(panel):
    cfg = validation.FoldConfig(100, 40, 20)
    folds = validation.fold_table(panel, cfg).orderBy("fold").collect()
    days = [r["date"] for r in panel.select("date").distinct().orderBy("date").collect()]
    assert len(folds) == (300 - 140) // 20 + 1
    for i, f in enumerate(folds):
        assert (f["train_start"], f["train_end"]) == (days[20 * i], days[20 * i + 99])
        assert (f["eval_start"], f["eval_end"]) == (days[20 * i + 100], days[20 * i + 139])
        assert (f["train_rows"], f["eval_rows"]) == (500, 200)
    m = validation.fold_metrics(panel, cfg, (5,)).collect()
    assert {r["n_obs"] for r in m if r["signal"] == "signal_momentum_21d"} == {5 * (40 - 5)}
    level = validation.fold_metrics(panel, cfg, (5,), target="level").filter(F.col("win_rate") != 0.5)
    assert {r["win_rate"] for r in level.collect()} == {1.0}
    with pytest.raises(ValueError, match="No signal columns"):
        validation.fold_metrics(panel.select("ticker", "date", "close"))
    assert validation.FoldConfig().shrunk(100) == validation.FoldConfig(60, 20, 10)
    assert validation.walk_forward_lines(validation.aggregate_folds(validation.fold_metrics(panel, cfg, (5,)))).count() == 4


def test_segments(spark, make_bars):
    parts = [make_bars({"A": [100.0] * n}, start) for n, start in ((200, dt.date(2014, 1, 2)), (100, dt.date(2020, 1, 2)), (100, dt.date(2023, 1, 3)))]
    df = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert {k: v.count() for k, v in validation.split_segments(df).items()} == {"train": 200, "validation": 100, "hold_back": 100}
    tagged = validation.add_segment(df)
    assert validation.assert_segment_coverage(tagged)["train"] == 0.5
    with pytest.raises(ValueError):
        validation.assert_segment_coverage(tagged, 0.3)
    with pytest.raises(ValueError):
        validation.SegmentBounds(dt.date(2021, 1, 1), dt.date(2020, 1, 1))
    with pytest.raises(ValueError):
        validation.split_segments(df.drop("date"))
    short = validation.resolve_bounds(parts[0])
    assert short.description == "proportional" and short.train_start == dt.date(2014, 1, 2)


def test_perturbed_values():
    assert perturbation.perturbed(21) == [17, 19, 21, 23, 25]
    assert perturbation.perturbed(1) == [1, 1, 1, 1, 1]
    assert perturbation.tunable(signals.mean_reversion(21)) == {"lookback": 21}


def test_perturbation_classes(spark):
    rows = spark.createDataFrame(
        [("ok", 0.1, -5.0), ("frail", 0.1, -60.0), ("soft", 0.1, -30.0), ("none", None, None)], "name string, ic double, ic_change_pct double")
    got = {r["name"]: r["classification"] for r in perturbation.classify(rows).collect()}
    assert got == {"ok": "robust", "frail": "fragile", "soft": "sensitive", "none": "no_data"}
    assert perturbation.sweep_summary(perturbation.classify(rows)).first()["tested"] == 3


@pytest.mark.parametrize("method,ics,want", [
    ("abs_ic", (0.1, -0.3), (0.25, 0.75)), ("positive_ic", (0.2, -0.1), (1.0, 0.0)), ("positive_ic", (-0.1, -0.2), (0.5, 0.5)),
    ("unknown", (0.1, 0.2), (0.5, 0.5)), ("rank_ic", (0.05, 0.15), (1 / 3, 2 / 3))])
def test_ic_weights(spark, method, ics, want):
    w = ensemble.ic_weights({"a": F.lit(ics[0]), "b": F.lit(ics[1])}, method)
    row = spark.range(1).select(w["a"].alias("a"), w["b"].alias("b")).first()
    assert (row["a"], row["b"]) == pytest.approx(want)
    assert ensemble.ic_weights({}) == {}


def test_ensemble_contract(panel):
    ens = ensemble.IcWeightedEnsemble(ensemble.EnsembleConfig(lookback=21, horizon=1))
    with pytest.raises(RuntimeError, match="Call transform"):
        ens.predict(panel, CORE)
    out = ens.transform(panel, CORE, "forward_return_1")
    pdf = out.select("ensemble_score", *[f"w_{s}" for s in CORE]).toPandas()
    assert len(pdf) == panel.count() and np.allclose(pdf[[f"w_{s}" for s in CORE]].sum(axis=1), 1.0)
    assert pdf["ensemble_score"].abs().max() <= 1.0 and pdf["ensemble_score"].std() > 0
    assert "ensemble_score" in ens.predict(panel.select("date", *CORE), CORE).columns
    with pytest.raises(ValueError):
        ensemble.run_ensemble(panel.drop(*CORE))


def test_meta_learner(panel):
    with pytest.raises(ValueError, match="hold-back"):
        meta.MetaLearner(CORE).fit(panel, dt.date(2024, 1, 1))
    with pytest.raises(ValueError, match="missing"):
        meta.MetaLearner(["nope"]).fit(panel, dt.date(2020, 1, 1))
    with pytest.raises(ValueError, match="no training data"):
        meta.MetaLearner(CORE).fit(panel, dt.date(2018, 1, 1))
    m = meta.MetaLearner(CORE, maxIter=3).fit(panel, dt.date(2019, 12, 1))
    out = m.predict(panel).select("ml_probability", "ml_direction").toPandas()
    assert out["ml_probability"].between(0, 1).all() and set(out["ml_direction"]) <= {-1, 0, 1}
    assert sum(r["importance"] for r in m.feature_importance(panel).collect()) == pytest.approx(1.0)
    assert m.evaluate(panel).first()["auc"] > 0.5


def test_meta_learner_against_a_walk_of_its_trees(panel):
    m = meta.MetaLearner(CORE, maxIter=4).fit(panel, dt.date(2019, 12, 1))
    rows = m.signal(panel).join(m.predict(panel).select("ticker", "date", "ml_probability"), ["ticker", "date"]).toPandas()

    def walk(node, x):
        while node.subtreeDepth() > 0:
            split = node.split()
            node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    trees = [t._java_obj.rootNode() for t in m._model.trees]
    few = rows.sample(40, random_state=1)
    for _, r in few.iterrows():
        x = [0.0 if np.isnan(r[c]) else r[c] for c in CORE]
        margin = sum(w * walk(t, x) for w, t in zip(m._model.treeWeights, trees))
        assert r["ml_probability"] == pytest.approx(1 / (1 + np.exp(-2 * margin)))
        assert r["signal_lightgbm_ml"] == pytest.approx(2 * r["ml_probability"] - 1)
    known = rows.dropna(subset=["forward_return_5"])
    y, p = (known["forward_return_5"] > 0).to_numpy(), known["ml_probability"].to_numpy()
    rank = known["ml_probability"].rank().to_numpy()
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    got = m.evaluate(panel).first()
    assert got["n"] == len(known) and got["auc"] == pytest.approx(auc, abs=2e-3)
    assert got["logloss"] == pytest.approx(-np.log(np.where(y, p, 1 - p)).mean())


def test_kelly_numbers(spark):
    k = lambda *a: spark.range(1).select(sizing.kelly_fraction(*[F.lit(x) for x in a[:3]], a[3]).alias("k")).first()["k"]
    assert k(0.6, 0.02, 0.01, 0.25) == pytest.approx(0.1)
    assert k(0.4, 0.01, 0.02, 0.25) == 0.0 and k(0.6, 0.0, 0.01, 0.25) == 0.0 and k(0.6, 0.02, 0.0, 0.25) == 0.0
    assert k(0.9, 0.10, 0.01, 0.25) <= 0.25
    for bad in ({"kelly_fraction": 0.0}, {"kelly_fraction": 1.5}, {"lookback": 1}, {"target_vol": 0.0}, {"forward_horizon": 0}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            sizing.KellyConfig(**bad)


def test_kelly_weights_follow_direction_and_caps(panel):
    edge = panel.withColumn("signal_test", F.when(F.col("forward_return_1") > 0.0005, 0.5).when(F.col("forward_return_1") < -0.0005, -0.5).otherwise(0.0))
    edge = edge.withColumn("signal_test", F.when(F.dayofmonth("date") == 13, -F.col("signal_test")).otherwise(F.col("signal_test")))
    cfg = sizing.KellyConfig(max_position=0.10, max_portfolio_exposure=0.3)
    out = sizing.kelly_weights(edge, "signal_test", cfg).toPandas()
    assert out["position_weight"].abs().max() <= 0.10 + 1e-9 and (out["position_weight"] * out["signal_value"] >= 0).all()
    assert out.groupby("date")["position_weight"].apply(lambda s: s.abs().sum()).max() <= 0.3 + 1e-9
    assert (out.sort_values("date").groupby("ticker").head(63)["kelly_fraction"] == 0).all() and (out["kelly_fraction"] > 0).any()
    with pytest.raises(ValueError):
        sizing.kelly_weights(edge, "signal_nope")
    with pytest.raises(ValueError):
        sizing.kelly_multi(edge, [])


def weight_frame(spark, rows):
    return spark.createDataFrame([(t, dt.date(2023, 1, 3), w, s) for t, w, s in rows], "ticker string, date date, weight double, sector string")


def test_limits(spark):
    df = weight_frame(spark, [("A", 0.2, "tech"), ("B", -0.2, "tech"), ("C", 0.2, "tech"), ("J", 0.2, "fin")])
    capped = risk.cap_sectors(df, 0.30).groupBy("sector").agg(F.sum(F.abs("weight")).alias("w"))
    assert {r["sector"]: round(r["w"], 9) for r in capped.collect()} == {"tech": 0.3, "fin": 0.2}
    two = weight_frame(spark, [("A", 1.0, "x"), ("B", 1.0, "y")])
    assert [r["weight"] for r in risk.cap_leverage(two, 1.0).collect()] == [0.5, 0.5]
    assert risk.cap_positions(df, 0.1).agg(F.max(F.abs("weight"))).first()[0] == 0.1
    with pytest.raises(ValueError):
        risk.RiskConfig(lookback_vol=5)
    with pytest.raises(Exception):
        risk.RiskConfig().max_leverage = 3


def test_breaker_matches_a_state_machine(spark):
    rng = np.random.default_rng(0)
    dd = np.abs(np.sin(np.arange(400) / 17)) * 0.3 * rng.random(400)
    rows = [(dt.date(2022, 1, 1) + dt.timedelta(days=i), float(d)) for i, d in enumerate(dd)]
    got = [r["leverage_scale"] for r in risk.drawdown_breaker(spark.createDataFrame(rows, "date date, drawdown double"), risk.RiskConfig()).orderBy("date").collect()]
    on, want = False, []
    for d in dd:
        on = True if d >= 0.20 else False if d <= 0.10 else on
        want.append(0.5 if on else 1.0)
    assert got == want and 0.5 in got


def test_average_correlation_without_gaps_is_the_pairwise_mean(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 40)) + rng.normal(size=40)
    days = [dt.date(2023, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    df = spark.createDataFrame([(f"T{i}", d, float(x[i, j])) for i in range(6) for j, d in enumerate(days)], "ticker string, date date, return double")
    got = {r["date"]: r["avg_correlation"] for r in risk.average_correlation(df, 30).collect()}
    assert len(got) == 11
    c = np.corrcoef(x[:, 5:35])
    assert got[days[34]] == pytest.approx(c[np.triu_indices(6, 1)].mean(), abs=1e-9)


def test_targets_and_orders(spark):
    s = spark.createDataFrame([("A", dt.date(2023, 1, 3), 0.5), ("B", dt.date(2023, 1, 3), -0.3), ("C", dt.date(2023, 1, 3), 0.05)], "ticker string, date date, s double")
    got = {r["ticker"]: r["target_weight"] for r in sizing.targets(s, "s").collect()}
    assert got == {"A": 0.625, "B": -0.375}
    assert [r["ticker"] for r in sizing.targets(s, "s", top_n=1).collect()] == ["A"]
    w = spark.createDataFrame([("A", 0.5), ("B", -0.25)], "ticker string, weight double")
    held = spark.createDataFrame([("A", 100), ("D", 7)], "ticker string, quantity bigint")
    px = spark.createDataFrame([("A", 10.0), ("B", 20.0), ("D", 5.0)], "ticker string, price double")
    orders = {r["ticker"]: (r["side"], r["quantity"]) for r in sizing.size_orders(w, held, px, 1000.0).collect()}
    assert orders == {"A": ("SELL", 50), "B": ("SELL", 12), "D": ("SELL", 7)}


def test_timeframes():
    assert [parse_minutes(t) for t in ("1min", "5m", "1h", "30s", "15", "nonsense")] == [1, 5, 60, 0.5, 15, 1]
    assert parse_seconds("1h") == 3600
