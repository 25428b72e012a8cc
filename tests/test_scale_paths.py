"""The paths for large inputs give what the small ones and plain loops give."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickerloom.functions.rolling import ema
from tickerloom.operators import construction as con
from tickerloom.operators import ensemble, ledger, monitor, perturbation
from tickerloom.operators.scan import affine_scan
from tickerloom.plans import rankic, ranks
from tickerloom.plans.ranks import average_ranks, series_rank
from tickerloom.plans.scale import discard, settled
from tickerloom.sources import market


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value of one group; signs, zeros and NULLs mixed in."""
    rng = np.random.default_rng(1)
    g = rng.integers(0, 4, 3000)
    v = np.round(rng.normal(size=3000) * 10.0 ** rng.integers(-6, 6, 3000), 8)
    g[:1000], v[:1000] = 0, 0.5
    v[1000:1100] = 0.0
    pdf = pd.DataFrame({"g": g, "v": v, "i": range(3000)})
    pdf.loc[::97, "v"] = None
    return pdf


@pytest.mark.parametrize("rank,rows", [(average_ranks, 1_000_000), (average_ranks, 40), (average_ranks, 7), (series_rank, 0)])
def test_average_rank_matches_pandas(spark, monkeypatch, skewed, rank, rows):
    monkeypatch.setattr(ranks, "BAND_ROWS", rows)
    df = spark.createDataFrame(skewed.astype(object).where(skewed.notna(), None), "g bigint, v double, i bigint")
    df = df.withColumn("u", F.when(F.col("v") > 0, F.round("v", 1))).withColumn("g", F.nullif("g", F.lit(3)))
    got = rank(df, ["g"], {"v": "rk", "u": "ru"}, count="_n").toPandas().sort_values("i")
    assert len(got) == len(skewed)
    for value, out in (("v", "rk"), ("u", "ru")):
        groups = got.groupby(got["g"].fillna(-1))[value]
        assert np.allclose(got[out].to_numpy(), groups.rank(method="average").to_numpy(), equal_nan=True)
        known = got[value].notna()
        assert (got[out + "_n"][known] == groups.transform("count")[known]).all()


def test_hot_values_and_narrow_ranges_fall_into_small_bands(spark, monkeypatch):
    """Half of the rows equal, the rest in a narrow range far from zero with outliers: exact ranks, no large band to sort."""
    monkeypatch.setattr(ranks, "BAND_ROWS", 50)
    rng = np.random.default_rng(7)
    v = np.concatenate([np.full(3000, 1001.5), rng.uniform(1000, 1003, 2000), rng.uniform(-5e6, -5e6 + 1, 1000), [1e12, -1e12, 0.0]])
    pdf = pd.DataFrame({"g": 1, "v": rng.permutation(v), "i": range(len(v))})
    df = spark.createDataFrame(pdf)
    got = average_ranks(df, ["g"], {"v": "rk"}, count="_n").toPandas().sort_values("i")
    assert np.allclose(got["rk"], pdf["v"].rank()) and set(got["rk_n"]) == {len(v)}
    cuts = df.agg(F.array_distinct(F.percentile_approx("v", [(j + 1) / 121 for j in range(120)], 10_000))).first()[0]
    band = ranks._band(F.col("v"), F.array(*[F.lit(c) for c in cuts]), 120)
    sizes = df.groupBy(band.alias("b"), (band % 2 == 1).alias("cut")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("v").alias("values")).toPandas()
    assert sizes[~sizes["cut"]]["n"].max() < 150 and (sizes[sizes["cut"]]["values"] == 1).all() and sizes["n"].max() >= 3000
    ordered = df.select("v", band.alias("b")).toPandas().sort_values("v")["b"]
    assert (np.diff(ordered) >= 0).all()


@pytest.mark.parametrize("chunk", [None, "c"])
def test_affine_scan_matches_a_loop(spark, chunk):
    rng, rows, want = random.Random(3), [], {}
    for k in "xyz":
        y = 0.0
        for i in range(300):
            a = rng.choice([0.0, 1.0, 1.0, 0.5, 1e-30, rng.random()])
            b = rng.random()
            rows.append((k, i // 40, i, a, b))
            prev, y = y, a * y + b
            want[k, i] = (y, prev)
    df = spark.createDataFrame(rows, "k string, c int, i int, _a double, _b double")
    order = ["i"] if chunk else ["c", "i"]
    got = affine_scan(df, ["k"], chunk, order, "y", "before").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["y"], r["before"]) == pytest.approx(want[r["k"], r["i"]], rel=1e-9)


def looped_ledger(fills):
    state, out = {}, {}
    for key, seq, side, n, px in fills:
        q, e = state.get(key, (0.0, 0.0))
        signed = n if side == "BUY" else -n
        after, realized = q + signed, 0.0
        if q * signed < 0:
            realized = min(abs(q), n) * (px - e) * (1 if q > 0 else -1)
        if q == 0 or q * after < 0:
            e = px
        elif q > 0 and signed > 0:
            e = (e * q + px * n) / after
        state[key] = (after, e if after else 0.0)
        out[key, seq] = (after, e if after else None, realized)
    return out


def test_ledger_matches_a_loop(spark):
    rng = random.Random(5)
    fills = [(rng.choice(["p", "q"]), i, rng.choice(["BUY", "SELL"]), float(rng.randint(1, 9)), round(rng.uniform(50, 150), 2)) for i in range(600)]
    rows = [("acc", k, dt.date(2024, 1, 1) + dt.timedelta(days=i // 50), i, s, n, p, 0.0) for k, i, s, n, p in fills]
    df = spark.createDataFrame(rows, "account string, ticker string, date date, seq bigint, side string, shares double, price double, commission double")
    want = looped_ledger(fills)
    for r in ledger.position_ledger(df).collect():
        q, e, realized = want[r["ticker"], r["seq"]]
        assert r["quantity"] == q and r["realized_pnl"] == pytest.approx(realized, abs=1e-7)
        assert (r["avg_cost"] is None) == (e is None) and (e is None or r["avg_cost"] == pytest.approx(e))


def test_ledger_cases(spark):
    cols = "account string, ticker string, date date, seq bigint, side string, shares double, price double, commission double"
    d = dt.date(2024, 1, 2)
    rows = [("a", "SHORT", d, 1, "SELL", 500.0, 100.0, 0.0), ("a", "SHORT", d, 2, "BUY", 200.0, 98.0, 0.0),
            ("a", "FLIP", d, 1, "BUY", 500.0, 100.0, 0.0), ("a", "FLIP", d, 2, "SELL", 800.0, 101.0, 0.0)]
    out = {r["ticker"]: r for r in ledger.closing_positions(ledger.position_ledger(spark.createDataFrame(rows, cols))).collect()}
    assert (out["SHORT"]["quantity"], out["SHORT"]["realized_pnl"], out["SHORT"]["avg_cost"]) == (-300.0, 400.0, 100.0)
    assert (out["FLIP"]["quantity"], out["FLIP"]["realized_pnl"], out["FLIP"]["avg_cost"]) == (-300.0, 500.0, 101.0)


def test_cooldown_matches_a_walk(spark):
    rng, t0 = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(rng.choice("ab"), t0 + dt.timedelta(seconds=rng.randint(0, 40_000)), i) for i in range(800)]
    want = []
    for kind in "ab":
        last = None
        for _, ts, i in sorted((r for r in rows if r[0] == kind), key=lambda r: (r[1], r[2])):
            if last is None or (ts - last).total_seconds() >= 300:
                want.append((kind, ts, i))
                last = ts
    df = spark.createDataFrame(rows, "alert_type string, ts timestamp, alert_id bigint")
    got = monitor.cooldown(df, 300).collect()
    assert sorted((r["alert_type"], r["ts"], r["alert_id"]) for r in got) == sorted(want)


@pytest.mark.parametrize("seconds, chunk", [(300, "hour"), (5 * 3600, "hour")])
def test_cooldown_over_hours_days_and_decades(spark, seconds, chunk):
    """Maps composed in every round: gaps of seconds to decades, instants of before 1970, exact distances, one hot type."""
    rng, rows = random.Random(seconds), []
    for kind, n, gaps in (("hot", 3000, (1, 400)), ("slow", 400, (seconds - 1, seconds + 1)), ("rare", 60, (1, 10**8)), ("mixed", 500, None), ("one", 1, (1, 2))):
        at = dt.datetime(1969, 12, 1)
        for i in range(n):
            at += dt.timedelta(seconds=rng.randint(*gaps) if gaps else rng.choice([0, 1, 60, seconds, 7200, 10**6]))
            rows.append((kind, at, i))
    want = []
    for kind in {r[0] for r in rows}:
        last = None
        for _, ts, i in sorted(r for r in rows if r[0] == kind):
            if last is None or (ts - last).total_seconds() >= seconds:
                want.append((kind, ts, i))
                last = ts
    rows += [(None, dt.datetime(2024, 1, 1), 1), ("hot", None, 2)]
    df = spark.createDataFrame(rows, "alert_type string, ts timestamp, alert_id bigint")
    got = [tuple(r) for r in monitor.cooldown(df, seconds, chunk=chunk).collect()]
    assert sorted(got) == sorted(want)
    assert monitor.cooldown(df.limit(0), seconds).count() == 0


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(4)
    t, n = 30, 24
    x = rng.normal(size=(n, t)) * rng.uniform(0.5, 2, n)[:, None] + rng.normal(size=t)
    x -= x.mean(axis=1, keepdims=True)
    rows = [(dt.date(2024, 1, 31), f"T{i:02d}", [float(v) for v in x[i]]) for i in range(n)]
    return x, spark.createDataFrame(rows, "rebalance_date date, ticker string, x array<double>")


def test_shrinkage_matches_the_pairwise_formula(blocks):
    x, df = blocks
    n, t = x.shape
    s = x @ x.T / t
    pi = ((x[:, None, :] * x[None, :, :]) ** 2).mean(axis=2) - s**2
    off = ~np.eye(n, dtype=bool)
    want = np.clip(pi[off].sum() / t / (s[off] ** 2).sum(), 0, 1)
    row = con.shrinkage(df, t).first()
    assert row["n_assets"] == n and row["delta"] == pytest.approx(want, rel=1e-9)
    assert con.shrinkage(df, t, 0.3).first()["delta"] == 0.3


def test_risk_parity_equalises_contributions(blocks):
    x, df = blocks
    t = x.shape[1]
    shrink = con.shrinkage(df, t, 0.2)
    w = con.risk_parity(df, t, shrink)
    share = con.risk_contributions(w, shrink, t).toPandas()
    assert (share["weight"] > 0).all() and share["weight"].sum() == pytest.approx(1.0)
    assert np.allclose(share["share"], 1 / len(x), rtol=1e-5) and share["share"].sum() == pytest.approx(1.0)
    scaled = con.risk_parity(df, t, shrink, target_risk=0.1).toPandas()
    w = scaled.set_index("ticker")["w"].sort_index().to_numpy()
    cov = 0.8 * x @ x.T / t + 0.2 * np.diag((x * x).mean(axis=1))
    assert np.sqrt(w @ cov @ w * 252) == pytest.approx(0.1)


@pytest.mark.parametrize("delta", [0.0, 0.1, 1.0])
def test_risk_parity_with_more_assets_than_dates(spark, delta):
    """Against a plain fixed-point on the whole matrix: cyclical descent, one asset at a time."""
    rng = np.random.default_rng(8)
    n, t = 60, 12
    x = 0.01 * (rng.normal(size=(n, t)) + 1.5 * rng.normal(size=(1, t))) * rng.uniform(0.2, 4, (n, 1))
    x -= x.mean(axis=1, keepdims=True)
    days = [dt.date(2024, 1, 31), dt.date(2024, 2, 29)]
    rows = [(days[0], f"T{i:02d}", x[i].tolist()) for i in range(n)] + [(days[1], f"T{i:02d}", (3 * x[i]).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "rebalance_date date, ticker string, x array<double>").repartition(3)
    got = con.risk_parity(df, t, con.shrinkage(df, t, delta)).toPandas()
    for day, m, scale in ((days[0], n, 1), (days[1], 5, 3)):
        d, y = max(delta, 1e-3), scale * x[:m]
        cov = (1 - d) * y @ y.T / t + d * np.diag((y * y).mean(axis=1))
        c, w = np.trace(cov) / m, 1 / np.sqrt(np.diag(cov))
        for _ in range(3000):
            for i in range(m):
                a = cov[i] @ w - cov[i, i] * w[i]
                w[i] = (-a + np.sqrt(a * a + 4 * cov[i, i] * c)) / (2 * cov[i, i])
        mine = got[got["rebalance_date"] == day].set_index("ticker")["w"].sort_index().to_numpy()
        assert np.allclose(mine, w / w.sum(), rtol=1e-4)
        share = mine * (cov @ mine) / (mine @ cov @ mine)
        assert np.allclose(share, 1 / m, rtol=1e-4)


def test_trade_order_holds_at_large_keys_and_prices(spark):
    rows = [(80_000_000_000, 1, 900.0), (80_000_000_000, 2, 250_000.0), (70_000_000_000, 7, 300_000.0), (70_000_000_000, 7, 299_999.99)]
    df = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_extendedprice double")
    got = [tuple(r) for r in df.orderBy(market.trade_seq()).collect()]
    assert got == sorted(rows)


def test_ema_ages_over_gaps(spark):
    values = [9.0, None, 12.0, 10.5, None, None, 11.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").withColumn("k", F.lit(1))
    got = [r["e"] for r in df.withColumn("e", ema("x", 3, Window.partitionBy("k").orderBy("i"))).orderBy("i").collect()]
    assert np.allclose(got, pd.Series(values, dtype=float).ewm(span=3).mean())


def test_a_written_frame_leaves_no_shuffle_behind(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    kept = settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert kept.count() == 7 and files() <= before + 2 * 8  # at most the last count's own
    discard(kept)
    with pytest.raises(Exception):
        kept.collect()


def test_a_sweep_never_holds_all_variants(spark, make_bars, monkeypatch):
    """30 variants were one panel of 30 columns, ranked in one go."""
    rng = np.random.default_rng(5)
    df = make_bars({f"T{i}": (100 * np.exp(np.cumsum(0.02 * rng.normal(size=60)))).tolist() for i in range(6)}).select("ticker", "date", "close")
    plain, widths, gone = perturbation.settled, [], []
    monkeypatch.setattr(perturbation, "settled", lambda f: widths.append(len(f.columns)) or plain(f))
    monkeypatch.setattr(perturbation, "discard", lambda f: gone.append(len(f.columns)))
    families = ["momentum_21d", "bollinger_bands", "momentum_ts_21d"]
    rows = lambda: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in perturbation.perturb(df, families).collect())
    whole = rows()
    assert max(widths) <= perturbation.COLUMNS + 1 and len(gone) == 3  # two panels and the prices
    monkeypatch.setattr(perturbation, "COLUMNS", 4)
    assert rows() == whole


def test_signals_ranked_a_few_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(9)
    signals = [f"s{k}" for k in range(5)]
    rows = [(*[None if rng.random() < 0.1 else float(v) for v in rng.integers(-9, 9, 5)], *rng.normal(size=2).tolist()) for _ in range(600)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in (*signals, "f1", "f5")))
    outcomes, found = {1: "f1", 5: "f5"}, []
    plain, written = rankic.settled, []
    monkeypatch.setattr(rankic, "settled", lambda f: written.append(1) or plain(f))
    monkeypatch.setattr(rankic, "TOGETHER", 2)
    for values in (200, 10**7):
        rows = rankic.pooled_rank_ic(df, [], signals, outcomes, values, 50).collect()
        found.append({(r["signal"], r["horizon"]): (round(r["ic"], 12), r["win_rate"], r["n_obs"]) for r in rows})
    assert len(written) == 6 and len(found[0]) == 10 and found[0] == found[1]


def test_an_ensemble_is_validated_on_rows_written_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(d), *rng.normal(size=3).tolist()) for d in range(30) for _ in range(5)]
    df = spark.createDataFrame(rows, "date date, signal_a double, signal_ensemble double, forward_return_5 double")
    plain, made = ensemble.needed, []
    monkeypatch.setattr(ensemble, "needed", lambda *a: made.append(1) or plain(*a))
    rows = lambda f: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in f.collect())
    out = [rows(ensemble.validate_ensemble(df, ["signal_a"], written=w)) for w in (False, True)]
    assert len(made) == 1 and out[0] == out[1] and len(out[0]) == 2
