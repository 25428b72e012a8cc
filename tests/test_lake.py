import datetime as dt
import random

import pytest
from conftest import weekdays
from pyspark.sql import functions as F

from tickerloom.operators import adjust, enrich, quality
from tickerloom.sources import lake, vendor


def rows(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_split_halves_prices_up_to_and_on_the_event_day(spark, make_bars):
    bars = make_bars({"AAPL": range(100, 160), "MSFT": range(250, 310)})
    splits = spark.createDataFrame([("AAPL", dt.date(2023, 2, 15), "split", 2.0)], "ticker string, date date, action_type string, factor double")
    out = rows(adjust.adjust_for_splits(bars, splits), "ticker", "date")
    before = [r for r in out if r["ticker"] == "AAPL" and r["date"] <= dt.date(2023, 2, 15)]
    assert max(r["close"] for r in before) == 65.5
    assert {r["volume"] for r in before} == {2_000_000.0}
    assert [r["close"] for r in out if r["ticker"] == "MSFT"] == [float(x) for x in range(250, 310)]
    strict = rows(adjust.adjust_for_splits(bars, splits, inclusive=False), "ticker", "date")
    assert [r["close"] for r in strict if r["date"] == dt.date(2023, 2, 15) and r["ticker"] == "AAPL"] == [131.0]


def test_reverse_splits_are_ignored_unless_asked_for(spark, make_bars):
    bars = make_bars({"AAPL": range(100, 110)})
    splits = spark.createDataFrame([("AAPL", dt.date(2023, 1, 10), "split", 0.5)], "ticker string, date date, action_type string, factor double")
    assert rows(adjust.adjust_for_splits(bars, splits), "date")[0]["close"] == 100.0
    assert rows(adjust.adjust_for_splits(bars, splits, reverse_splits=True), "date")[0]["close"] == 200.0


def looped_dividends(bars, divs):
    """The definition taken literally: newest dividend first, on already adjusted prices."""
    bars = [dict(b) for b in bars]
    for ex, amount in sorted(divs, reverse=True):
        if amount <= 0:
            continue
        prior = [b for b in bars if b["date"] < ex]
        if not prior or prior[-1]["close"] <= 0:
            continue
        c = prior[-1]["close"]
        for b in bars:
            if b["date"] <= ex:
                b["close"] *= (c - amount) / c
    return [b["close"] for b in bars]


@pytest.mark.parametrize("seed", range(4))
def test_dividends_match_the_sequential_definition(spark, make_bars, seed):
    rng = random.Random(seed)
    closes = [round(rng.uniform(2, 60), 2) for _ in range(40)]
    days = weekdays(dt.date(2023, 1, 3), 40)
    divs = [(rng.choice(days), rng.choice([-1.0, 0.2, 1.5, 9.0, 40.0])) for _ in range(6)]
    divs = list({d: (d, a) for d, a in divs}.values())
    df = spark.createDataFrame([("A", d, a) for d, a in divs], "ticker string, ex_date date, amount double")
    got = [r["close"] for r in rows(adjust.adjust_for_dividends(make_bars({"A": closes}), df), "date")]
    want = looped_dividends([{"date": d, "close": c} for d, c in zip(days, closes)], divs)
    assert got == pytest.approx(want, abs=1e-9)


def test_silver_flags(spark, make_bars):
    bars = make_bars({"A": [100, 101, 150, 151]}).withColumn("volume", F.when(F.col("close") == 101, 0).otherwise(F.col("volume")))
    out = rows(adjust.build_silver(bars), "date")
    assert [r["data_quality"] for r in out] == ["good", "thin", "suspicious", "good"]
    assert all(r["is_market_date"] and r["split_factor"] == 1.0 for r in out)


def test_gold_columns_and_warm_up(spark, make_bars):
    gold = enrich.build_gold(adjust.build_silver(make_bars({"AAPL": [100] * 70, "XYZ": [5] * 70})))
    out = rows(gold, "ticker", "date")
    assert out[0]["sector"] == "Technology" and out[-1]["sector"] == "Unknown"
    assert out[0]["market_cap_bucket"] == "mega" and out[-1]["market_cap_bucket"] == "etf"
    assert out[18]["avg_volume_20d"] is None and out[19]["avg_volume_20d"] == 1e6
    assert all(r["volume_ratio"] == 1.0 and r["universe_date"] for r in out)


def test_quality_messages(spark, make_bars):
    bars = make_bars({"A": [100.0] * 20})
    bad = bars.withColumn("close", F.when(F.col("date").between("2023-01-10", "2023-01-12"), -10.0).otherwise(F.col("close")))
    bad = bad.withColumn("volume", F.when(F.col("date") < "2023-01-09", 0).otherwise(F.col("volume")))
    found = {r["check"]: r for r in rows(quality.run_all_checks(bad, "bronze"), "check")}
    assert found["negative_close"]["message"] == "3 rows with negative close prices"
    assert found["zero_volume"]["message"] == "A: 4/20 (20%) days with zero volume"
    assert found["price_gaps"]["n"] == 2
    assert not quality.summary(quality.run_all_checks(bad, "bronze")).first()["is_valid"]
    assert quality.summary(quality.run_all_checks(bars, "bronze")).first()["is_valid"]


def test_lake_round_trip_upsert_and_views(spark, make_bars, tmp_path):
    path, staging = str(tmp_path / "gold"), str(tmp_path / "staging")
    gold = enrich.build_gold(adjust.build_silver(make_bars({"A": range(100, 130)})))
    lake.upsert_by_year(spark, gold, path, staging)
    lake.upsert_by_year(spark, gold.filter(F.col("date") > "2023-02-01").withColumn("close", F.lit(1.0)), path, staging)
    back = spark.read.parquet(path)
    assert back.count() == 30 and back.select("ticker", "date").distinct().count() == 30
    assert back.filter("close = 1.0").count() == gold.filter(F.col("date") > "2023-02-01").count()
    assert lake.register_views(spark, {"gold_daily": path, "silver_daily": str(tmp_path / "none")}) == ["gold_daily", "universe_daily"]
    assert lake.run_sql(spark, "SELECT count(*) AS n FROM universe_daily WHERE ticker = ?", ["A"]).first()["n"] > 0
    n = lake.load_gold(spark, path, dt.date(2023, 1, 3), dt.date(2023, 1, 5)).count()
    assert n == 2
    assert lake.load_range(spark, path, ["A"], dt.date(2023, 1, 3), dt.date(2023, 1, 5)).count() == 3
    plan = lake.load_gold(spark, path, dt.date(2023, 1, 3))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in plan and "PartitionFilters: [isnotnull(year" in plan


def test_bronze_load_without_files_is_empty(spark, tmp_path):
    out = lake.load_bronze(spark, str(tmp_path), ["A"], dt.date(2023, 1, 1), dt.date(2023, 12, 31))
    assert {k: v.count() for k, v in out.items()} == {"daily": 0, "dividends": 0, "corporate_actions": 0}


def test_fetch_plan_labels(spark):
    u = spark.createDataFrame([("NEW",), ("OLD",), ("FRESH",)], "ticker string")
    stored = spark.createDataFrame([("OLD", dt.date(2024, 1, 10)), ("FRESH", dt.date(2024, 3, 1))], "ticker string, date date")
    got = {r["ticker"]: r for r in lake.fetch_plan(u, stored, dt.date(2023, 1, 1), dt.date(2024, 3, 1)).collect()}
    assert (got["NEW"]["label"], got["OLD"]["label"], got["FRESH"]["label"]) == ("full", "incremental", "fresh")
    assert got["OLD"]["effective_start"] == dt.date(2024, 1, 11) and not got["FRESH"]["should_fetch"]
    assert {r["label"] for r in lake.fetch_plan(u, stored, dt.date(2023, 1, 1), dt.date(2024, 3, 1), force=True).collect()} == {"full"}


def test_vendor_bars_need_a_date_column(spark):
    with pytest.raises(ValueError):
        vendor.normalise_bars(spark.createDataFrame([("A", 1.0)], "ticker string, Open double"), "x")
