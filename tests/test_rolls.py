"""Trailing statistics over whole series beside Spark's own sliding frames."""

import datetime as dt
import math
import random

import pytest
from conftest import weekdays

from tickerloom.functions import rolling
from tickerloom.operators import signals
from tickerloom.plans import rolls

ODD = (None, None, float("nan"), float("inf"), 0.0, -0.0, 1e300, 5.0, 5.0)


def rows_of(seed: int) -> list[tuple]:
    rnd, out = random.Random(seed), []
    for ticker, n in (("A", 1), ("B", 140), ("C", 33), (None, 40), ("E", 90)):
        for d in weekdays(dt.date(2020, 1, 1), n):
            x = rnd.choice(ODD) if ticker == "B" and rnd.random() < 0.1 else 7.3 if ticker == "C" else rnd.gauss(100, 5)
            out.append((ticker, d, x, rnd.randrange(10**6)))
    rnd.shuffle(out)
    return out


def same(a, b) -> bool:
    return a is b is None or (a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b))))


@pytest.mark.parametrize("piece", [1, 50, 20_000])
def test_statistics_equal_sliding_frames_to_the_last_bit(spark, monkeypatch, piece):
    monkeypatch.setattr(rolls, "PIECE", piece)
    df = spark.createDataFrame(rows_of(piece), "ticker string, date date, x double, v bigint")

    def columns(w):
        return {
            "mean": rolling.rolling_mean("x", 5, w), "few": rolling.rolling_mean("x", 21, w, 1), "std": rolling.rolling_std("x", 21, w, 1),
            "var": rolling.rolling_var("x", 3, w, 0), "z": rolling.rolling_z("x", 200, w, 2), "whole": rolling.rolling_z("v", 10, w, 4),
            "back": rolling.lag("x", 3, w), "long": rolling.lag("x", 500, w), "ahead": rolling.lag("v", -2, w).cast("double")}

    got = rolls.with_rolled(df, columns)
    want = df.withColumns(columns(rolling.series()))
    assert got.columns == want.columns
    key = lambda r: (r["ticker"] or "", r["date"])
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(a) == len(b) == 304
    assert [(key(x), c, x[c], y[c]) for x, y in zip(a, b) for c in columns(rolling.series()) if not same(x[c], y[c])] == []


def test_an_empty_frame(spark):
    df = spark.createDataFrame([], "ticker string, date date, x double")
    assert rolls.with_rolled(df, lambda w: {"z": rolling.rolling_z("x", 5, w)}).collect() == []


def frames(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["mean_reversion_ts_63d", "momentum_ts_21d", "volatility_regime", "vol_scaled"])
def test_signals_go_through_no_sliding_frame(make_bars, name):
    """252 rows were gone through again for every row."""
    bars = make_bars({"A": [100.0 + i % 7 for i in range(90)]})
    assert "currentrow" not in frames(signals.generate(bars, [name]))
