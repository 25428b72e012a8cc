import datetime as dt
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import construction as con
from tickerloom.operators import hierarchy as H
from tickerloom.operators.signals import with_forward_returns
from tickerloom.plans import linkage as linkage_plan

DAYS, T = (dt.date(2024, 1, 31), dt.date(2024, 4, 30)), 30


def naive_tree(x, linkage):
    """Merges of the whole matrix, each distance measured from the members; clusters are tuples of members."""
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(np.maximum((1 - z @ z.T) / 2, 0))

    def far(a, b):
        if linkage == "ward":
            gap = z[list(a)].mean(axis=0) - z[list(b)].mean(axis=0)
            return gap @ gap / 2 * len(a) * len(b) / (len(a) + len(b))
        part = d[np.ix_(a, b)]
        return {"single": part.min, "complete": part.max, "average": part.mean}[linkage]()

    clusters, merges = [(i,) for i in range(len(x))], []
    while len(clusters) > 1:
        height, a, b = min((far(a, b), a, b) for i, a in enumerate(clusters) for b in clusters[i + 1:])
        a, b = (a, b) if min(a) < min(b) else (b, a)
        merges.append((height, a, b))
        clusters = [c for c in clusters if c not in (a, b)] + [a + b]
    return clusters[0], merges


def naive_bisect(order, x):
    cov, w = x @ x.T / x.shape[1], np.ones(len(x))

    def risk(block):
        v = 1 / np.diag(cov)[block]
        v /= v.sum()
        return v @ cov[np.ix_(block, block)] @ v

    todo = [list(order)]
    while todo:
        block = todo.pop()
        if len(block) > 1:
            left, right = block[:len(block) // 2], block[len(block) // 2:]
            a, b = risk(left), risk(right)
            w[left] *= 1 - a / (a + b)
            w[right] *= a / (a + b)
            todo += [left, right]
    return w


@pytest.fixture(scope="module")
def universe(spark):
    rng = np.random.default_rng(4)
    out, rows = {}, []
    for day, n in zip(DAYS, (40, 23)):
        common = rng.normal(size=(5, T))
        x = 0.01 * (rng.normal(size=(n, T)) + common[rng.integers(0, 5, n)]) * rng.uniform(0.5, 3, (n, 1))
        x -= x.mean(axis=1, keepdims=True)
        out[day] = x
        rows += [(day, f"T{i:02d}", x[i].tolist()) for i in range(n)] + [(day, "flat", [0.0] * T)]
    rows.append((dt.date(2024, 7, 31), "alone", out[DAYS[0]][0].tolist()))
    return out, spark.createDataFrame(rows, "rebalance_date date, ticker string, x array<double>").repartition(3).cache()


def by_day(df):
    out = defaultdict(dict)
    for r in df.collect():
        assert r["ticker"] not in out[r["rebalance_date"]]
        out[r["rebalance_date"]][r["ticker"]] = r["w"]
    return out


# rounds over several blocks down to one cluster; rounds and then one task; all in one task
@pytest.mark.parametrize("linkage,block,finish", [("single", 7, 1), ("complete", 7, 1), ("average", 14, 5), ("ward", 14, 5), ("complete", 1024, 64), ("single", 1024, 64)])
def test_weights_equal_a_naive_version(universe, linkage, block, finish):
    data, df = universe
    got = by_day(H.hrp(df, T, linkage, block, finish))
    assert got.pop(dt.date(2024, 7, 31)) == {"alone": 1.0}
    assert set(got) == set(data)
    for day, x in data.items():
        order, _ = naive_tree(x, linkage)
        want = naive_bisect(order, x)
        assert set(got[day]) == {f"T{i:02d}" for i in range(len(x))}
        assert np.allclose([got[day][f"T{i:02d}"] for i in range(len(x))], want, atol=1e-12)
        assert sum(got[day].values()) == pytest.approx(1.0)


def test_clusters_share_by_bisection_and_inverse_variance(universe):
    data, df = universe
    got = by_day(H.hrp_with_clusters(df, T, 4, "ward", 7, 3))
    for day, x in data.items():
        order, merges = naive_tree(x, "ward")
        clusters = [(i,) for i in range(len(x))]
        for _, a, b in sorted(merges)[:len(x) - 4]:
            clusters = [c for c in clusters if not set(c) & set(a + b)] + [a + b]
        var = (x * x).mean(axis=1)
        clusters.sort(key=lambda c: min(order.index(i) for i in c))
        books = np.stack([(x[list(c)] / var[list(c)][:, None]).sum(axis=0) / (1 / var[list(c)]).sum() for c in clusters])
        share = naive_bisect(range(4), books)
        for s, c in zip(share, clusters):
            for i in c:
                assert got[day][f"T{i:02d}"] == pytest.approx(s / var[i] / (1 / var[list(c)]).sum())


def test_equal_assets_and_unknown_linkage(spark):
    x = [0.01, -0.01, 0.02, -0.02]
    df = spark.createDataFrame([(DAYS[0], f"T{i}", x) for i in range(9)], "rebalance_date date, ticker string, x array<double>")
    for linkage in ("single", "average"):
        got = by_day(H.hrp(df, 4, linkage, 4, 2))[DAYS[0]]
        assert len(got) == 9 and sum(got.values()) == pytest.approx(1.0) and min(got.values()) > 0
    with pytest.raises(ValueError):
        H.hrp(df, 4, "median")


def test_portfolio_modes(spark, make_bars):
    rng = np.random.default_rng(2)
    bars = make_bars({f"T{i}": (100 * np.exp(np.cumsum(0.01 * rng.normal(size=70)))).tolist() for i in range(5)})
    panel = with_forward_returns(bars.withColumn("sig", bars["close"] / 100 - 1), [1]).cache()
    equity = panel.select("date").distinct().toPandas().sort_values("date")
    equity["equity"] = [100.0] * 40 + [70.0] * 30
    equity = spark.createDataFrame(equity, "date date, equity double")
    plain = con.build_portfolio(panel, "hrp", None, 30, 30, "ward")
    assert plain.columns == ["ticker", "date", "weight", "method"]
    rows = plain.toPandas()
    assert len(rows) == 350 and rows["weight"].notna().all() and set(rows["method"]) == {"hrp"}
    totals = rows.groupby("date")["weight"].sum().to_numpy()
    assert np.allclose(totals[:29], 0) and np.allclose(totals[29:], 1)
    cut = con.build_portfolio(panel, "hrp", "sig", 30, 30, "ward", equity).toPandas()
    assert set(cut["leverage_scale"][cut["weight"] != 0]) == {0.5, 1.0}
    both = cut.merge(rows, on=["ticker", "date"])
    assert np.allclose(both["weight_x"], both["weight_y"] * both["signal_value"] * both["leverage_scale"])
    result = con.compare(panel, con.returns_from_prices(panel), "sig", lookback=30, every=30).toPandas()
    assert set(result["method"]) == set(con.MODES) and (result["num_dates"] == 70).all()
    with pytest.raises(ValueError):
        con.build_portfolio(panel, "median")


@pytest.mark.parametrize("linkage", ["single", "average"])
def test_a_date_in_one_task_merges_as_rounds_do(spark, monkeypatch, linkage):
    """Rounds took minutes of small jobs on 6,000 assets; a date of some blocks is one task's, with the same tree."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(10, 12))
    x -= x.mean(axis=1, keepdims=True)
    rows = [(dt.date(2020, 1, 1), f"T{i:02d}", [float(v) for v in r]) for i, r in enumerate(x)]
    windows = spark.createDataFrame(rows, "rebalance_date date, ticker string, x array<double>")
    found = []
    for whole in (8, 0):
        monkeypatch.setattr(H, "WHOLE", whole)
        tree = H.merge_tree(windows, linkage, block=4, finish=6)
        rows = tree.collect()
        assert len(rows) == 9
        found.append(sorted(round(r["height"], 9) for r in rows))
    assert found[0] == found[1]


def test_equal_assets_merge_first_in_order_of_name():
    z = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    pdf = pd.DataFrame({"rebalance_date": [dt.date(2020, 1, 1)] * 5, "ticker": list("ABCDE"), "z": list(z)})
    for linkage in H.LINKAGES:
        out = H._whole(linkage)(pdf)
        assert list(zip(out["a"], out["b"])) == [("A", "C"), ("A", "E"), ("B", "D"), ("A", "B")]


def test_single_linkage_by_blocks_is_the_whole_tree(spark, universe):
    """Blocks of 8 and trees merged in several steps; copies of an asset join it at height 0."""
    data, df = universe
    x = data[DAYS[0]]
    copies = spark.createDataFrame([(DAYS[0], f"{c}{i:02d}", x[i].tolist()) for c in "UV" for i in (3, 7)], df.schema)
    merges = H.merge_tree(df.filter("ticker <> 'flat'").unionByName(copies), "single", 2, 1).toPandas()
    assert set(merges["rebalance_date"]) == set(DAYS)  # a date of one asset has no merge
    for day, x in data.items():
        own = merges[merges["rebalance_date"] == day].sort_values("height")
        zero = own[own["height"] == 0]
        assert sorted(zip(zero["a"], zero["b"])) == ([("T03", "U03"), ("T03", "V03"), ("T07", "U07"), ("T07", "V07")] if day == DAYS[0] else [])
        assert np.allclose(own["height"][own["height"] > 0], sorted(m[0] for m in naive_tree(x, "single")[1]), atol=1e-12)
    got = by_day(H.hrp(df, T, "single", 2, 1))
    for day, x in data.items():
        want = naive_bisect(naive_tree(x, "single")[0], x)
        assert np.allclose([got[day][f"T{i:02d}"] for i in range(len(x))], want, atol=1e-12)


def test_equal_distances_go_by_name(spark):
    z = np.array([[1.0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    d = np.sqrt(np.maximum((1 - z @ z.T) / 2, 0))
    a, b, _ = H._spanning_pair(d, np.array([2, 0, 3, 1]), False)
    assert sorted((min(p), max(p)) for p in zip(a, b)) == [(0, 1), (0, 2), (0, 3)]


def test_compare_measures_windows_once(spark, universe, monkeypatch):
    made, plain = [], con.return_windows
    monkeypatch.setattr(con, "return_windows", lambda *a, **k: made.append(1) or plain(*a, **k))
    bars = [(f"T{i}", dt.date(2024, 1, 1) + dt.timedelta(d), 100.0 + (7 * i + 3 * d * (i + 1)) % 11) for i in range(4) for d in range(70)]
    panel = with_forward_returns(spark.createDataFrame(bars, "ticker string, date date, close double"), [1]).withColumn("sig", F.lit(0.5))
    rows = con.compare(panel, con.returns_from_prices(panel), "sig", lookback=30, every=30).collect()
    assert len(made) == 1 and sorted(r["method"] for r in rows) == ["hrp", "kelly", "risk_parity"] and {r["num_dates"] for r in rows} == {70}


# dates of a task each (the default, above) and by blocks, rounds and levels give the same
@pytest.mark.parametrize("linkage,block,finish", [("single", 7, 1), ("complete", 7, 1), ("average", 14, 5), ("ward", 14, 5)])
def test_dates_beyond_a_task_go_by_rounds(universe, monkeypatch, linkage, block, finish):
    data, df = universe
    monkeypatch.setattr(H, "ALONE", 0)
    got = by_day(H.hrp(df, T, linkage, block, finish))
    assert got.pop(dt.date(2024, 7, 31)) == {"alone": 1.0}
    for day, x in data.items():
        want = naive_bisect(naive_tree(x, linkage)[0], x)
        assert np.allclose([got[day][f"T{i:02d}"] for i in range(len(x))], want, atol=1e-12)
    got = by_day(H.hrp_with_clusters(df, T, 4, linkage, block, finish))
    for day in data:
        assert sum(got[day].values()) == pytest.approx(1.0)


@pytest.mark.parametrize("linkage", H.LINKAGES)
def test_a_date_over_its_matrix_is_still_one_task(spark, universe, monkeypatch, linkage):
    """60,000 assets a date went by rounds whose blocks met again and again; now their vectors travel once."""
    data, df = universe
    monkeypatch.setattr(H, "WHOLE", 0)  # no matrix at all
    monkeypatch.setattr(H, "leaf_order", lambda *a: pytest.fail("a date that fits a task went by blocks"))
    copies = [(DAYS[1], f"V{i}", data[DAYS[1]][i].tolist()) for i in (3, 7, 7)]
    got = by_day(H.hrp(df.unionByName(spark.createDataFrame([(d, f"{t}{k}", x) for k, (d, t, x) in enumerate(copies)], df.schema)), T, linkage))
    x = data[DAYS[0]]
    assert np.allclose([got[DAYS[0]][f"T{i:02d}"] for i in range(len(x))], naive_bisect(naive_tree(x, linkage)[0], x), atol=1e-12)
    assert len(got[DAYS[1]]) == 26 and sum(got[DAYS[1]].values()) == pytest.approx(1.0)
    assert len({round(got[DAYS[1]][t], 12) for t in ("V71", "V72")}) == 1


@pytest.mark.parametrize("linkage", H.LINKAGES)
@pytest.mark.parametrize("kind", ["noise", "groups", "copies", "ties"])
def test_lists_make_the_tree_of_the_matrix(monkeypatch, linkage, kind):
    """Short lists, small blocks and few gathered pairs; trees by the sets of members that they merge."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 12))
    if kind == "groups":
        x += 3 * rng.normal(size=(6, 12))[rng.integers(0, 6, 150)]
    if kind == "copies":
        x = x[rng.integers(0, 60, 150)]
    if kind == "ties":
        x = np.eye(12)[rng.integers(0, 12, 150)]
    x -= x.mean(axis=1, keepdims=True)
    z = x / np.linalg.norm(x, axis=1, keepdims=True)
    for name, value in {"LISTED": 3, "SAMPLE": 40, "ROWS": 7, "COLUMNS": 32, "GATHERED": 50, "LARGE": 9}.items():
        monkeypatch.setattr(linkage_plan, name, value)

    def sets(a, b):
        of, out = {i: frozenset([i]) for i in range(150)}, set()
        at = list(range(150))
        for u, v in zip(a, b):
            u, v = at[u], at[v]
            of[u] |= of[v]
            at = [u if i == v else i for i in at]
            out.add(of[u])
        return out

    whole, lists, mixed = (linkage_plan.merges(z, linkage, dense) for dense in (1000, 0, 20))
    for a, b, heights in (lists, mixed):
        assert len(heights) == 149 and np.allclose(np.sort(heights), np.sort(whole[2]), atol=1e-7)
        assert kind in ("copies", "ties") or sets(a, b) == sets(*whole[:2])
