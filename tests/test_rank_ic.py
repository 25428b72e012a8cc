import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import metrics
from tickerloom.plans import rankic


def _frame(spark, n=3000):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"i": np.arange(n), "g": np.where(np.arange(n) % 7 == 0, None, np.where(np.arange(n) % 2, "a", "b"))})
    pdf["s1"] = np.where(rng.random(n) < 0.5, 0.25, np.round(rng.normal(size=n), 2))  # half of the rows are equal
    pdf["s2"] = rng.normal(size=n)
    pdf["o1"], pdf["o5"] = np.round(pdf["s1"] + rng.normal(size=n), 1), pdf["s2"] + rng.normal(size=n)
    pdf.loc[rng.random(n) < 0.1, "s2"] = None
    pdf.loc[rng.random(n) < 0.1, "o5"] = None
    pdf.loc[5:8, "s1"] = [np.inf, -np.inf, -0.0, 0.0]
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "i long, g string, s1 double, s2 double, o1 double, o5 double")


def _want(pdf, keys):
    out = {}
    for key, part in (pdf.groupby(keys, dropna=False) if keys else [((), pdf)]):
        for s in ("s1", "s2"):
            for h in (1, 5):
                both = part[[s, f"o{h}"]].dropna()
                buys = both[both[s] > 0]
                key_ = tuple(None if isinstance(k, float) else k for k in key) if keys else ()
                out[*key_, s, h] = (both[s].rank().corr(both[f"o{h}"].rank()), (buys[f"o{h}"] > 0).mean(), len(both))
    return out


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("values,band", [(8_000_000, 1_000_000), (900, 200), (60, 25)])
def test_wide_rank_ic_in_bands_of_any_size(spark, keys, values, band):
    pdf, df = _frame(spark)
    got = rankic.pooled_rank_ic(df.repartition(5), keys, ["s1", "s2"], {1: "o1", 5: "o5"}, values, band)
    got = {(*[r[c] for c in keys], r["signal"], r["horizon"]): (r["ic"], r["win_rate"], r["n_obs"]) for r in got.collect()}
    want = _want(pdf, keys)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_constant_signal_has_no_ic(spark):
    df = spark.range(300).select(F.lit(1.0).alias("s1"), F.col("id").cast("double").alias("o1"))
    for values in (10_000, 100):
        (row,) = rankic.pooled_rank_ic(df, [], ["s1"], {1: "o1"}, values, 50).collect()
        assert row["ic"] is None and row["n_obs"] == 300


def test_more_groups_than_the_driver_takes(spark, monkeypatch):
    pdf, df = _frame(spark, 600)
    monkeypatch.setattr(rankic, "FEW_SIZES", 1)
    monkeypatch.setattr(rankic, "VALUES", 10)
    assert rankic.pooled_rank_ic(df, ["g"], ["s1"], {1: "o1"}, 10, 10) is None
    monkeypatch.setattr(metrics, "pooled_rank_ic", lambda *a: None)
    got = {r["g"]: r["ic"] for r in metrics.rank_ic_of(df, ["s1"], [1], ["g"], 2, "o{h}").collect()}
    want = _want(pdf, ["g"])
    assert got == {g: pytest.approx(want[g, "s1", 1][0], abs=1e-12) for g in (None, "a", "b")}
