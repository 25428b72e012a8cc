"""Cases in which a query and its SQL once gave different rows."""

import datetime as dt

import duckdb
from conftest import weekdays
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from tickerloom.operators import features, ledger, quality


def test_zero_volume_percentage_rounds_halves_up(spark):
    """29 of 200 days are 14.5 %; 29 / 200 * 100 in doubles is 14.499999999999998."""
    days = weekdays(dt.date(2020, 1, 1), 200)
    df = spark.createDataFrame([("A", d, 10.0, 0 if i < 29 else 5) for i, d in enumerate(days)], "ticker string, date date, close double, volume long")
    (row,) = quality.count_checks(df, ["zero_volume"]).collect()
    want = duckdb.connect().execute("SELECT CAST(round(100.0::DOUBLE * 29 / 200) AS INTEGER)").fetchone()[0]
    assert row["message"] == f"A: 29/200 ({want}%) days with zero volume"


def test_accumulation_does_not_depend_on_the_order_of_sums(spark, make_bars):
    bars = make_bars({"A": [5.5] * 10}, volume=1).withColumns({"high": F.lit(10.0), "low": F.lit(0.0)})
    got = [r[0] for r in features.volume_features(bars).orderBy("date").select("accumulation_distribution").collect()]
    assert got == [(i + 1) / 10 for i in range(10)]


def test_periods_after_ruin_are_no_wins(spark):
    """0 / 0 is no return: it was NaN in the SQL, which sorts above 0 and counted as a win."""
    days = weekdays(dt.date(2020, 1, 1), 6)
    values = [100.0, 110.0, 99.0, 0.0, 0.0, 0.0]
    curve = spark.createDataFrame(list(zip(days, values)), "date date, portfolio_value double")
    got = ledger.equity_metrics(curve, 100.0).first()
    text = oracle_sql()["equity_metrics"]
    em = text[text.rindex("em AS (") :]
    con = duckdb.connect()
    con.execute("CREATE TABLE curve (date DATE, portfolio_value DOUBLE)")
    con.executemany("INSERT INTO curve VALUES (?, ?)", list(zip(days, values)))
    want = dict(zip(*(lambda c: ([d[0] for d in c.description], c.fetchone()))(con.execute("WITH " + em))))
    assert round(got["win_rate"], 3) == want["win_rate"] == 33.333
    assert round(got["sharpe"], 3) == want["sharpe"]
