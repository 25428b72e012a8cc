import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tickerloom.operators import signals
from tickerloom.plans import rankic


def _bars(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(90)]
    rows = [(f"T{i}", day, 100.0 + (7 * i + 3 * d * (i + 1)) % 11 if (i, d) != (2, 40) else None) for i in range(5) for d, day in enumerate(days[i * 3:])]
    return spark.createDataFrame(rows, "ticker string, date date, close double").repartition(3)


def test_series_worked_out_once_give_the_same_panel(spark):
    bars = _bars(spark)
    want = signals.generate(signals.with_forward_returns(bars, (1, 5, 21)), signals.DAILY_CORE)
    got = signals.generate(bars, signals.DAILY_CORE, horizons=(1, 5, 21), written=True)
    assert set(got.columns) == set(want.columns)
    cells = [c if c in ("ticker", "date") else F.round(c, 12).alias(c) for c in sorted(want.columns)]
    key = lambda r: (r["ticker"], r["date"])
    assert sorted(got.select(cells).collect(), key=key) == sorted(want.select(cells).collect(), key=key)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # both readers of the date statistics find files


def test_a_column_is_ranked_once_for_the_same_rows(monkeypatch):
    calls, plain = [], rankic._ranked
    monkeypatch.setattr(rankic, "_ranked", lambda *a: calls.append(1) or plain(*a))
    rng = np.random.default_rng(3)
    table = pa.table({"date": pa.array([1] * 50)} | {c: pa.array(rng.integers(0, 9, 50).astype(float)) for c in ("_s0", "_s1", "_f0", "_f1", "_f2")})
    out = rankic._whole_group(["date"], 2, 3)(table).to_pandas()
    assert len(out) == 6 and len(calls) == 5
    for r in out.itertuples():
        x, y = (table.column(c).to_pandas().rank() for c in (f"_s{r._2}", f"_f{r._3}"))
        assert np.isclose(r._7 / np.sqrt(r._8 * r._9), np.corrcoef(x, y)[0, 1])
