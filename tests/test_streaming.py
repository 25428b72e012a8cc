import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import intraday
from tickerloom.streaming import jobs

T0 = dt.datetime(2024, 1, 2, 15, 0)
TICK = "ticker string, ts timestamp, seq bigint, price double, volume bigint"


@pytest.fixture(scope="module")
def tick_folder(spark, tmp_path_factory):
    """Three files in order of time, the last with one tick far too late."""
    root = tmp_path_factory.mktemp("ticks")
    seq = 0
    for part in range(3):
        rows = []
        for i in range(40):
            rows.append(("A", T0 + dt.timedelta(seconds=600 * part + 15 * i), seq, 100.0 + seq, 1))
            seq += 1
        if part == 2:
            rows.append(("A", T0, 9999, 1.0, 1))
        spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(str(root))
    return str(root)


def stream(spark, folder):
    return jobs.file_stream(spark, folder, spark.read.parquet(folder), files_per_trigger=1)


def test_stream_bars_equal_batch_and_late_rows_are_counted(spark, tick_folder):
    out, late = jobs.drain(jobs.tick_bars(stream(spark, tick_folder)), "t")
    got = {r["datetime"]: r for r in spark.read.parquet(out).collect()}
    ticks = spark.read.parquet(tick_folder)
    want = {r["datetime"]: r for r in intraday.bars_from_ticks(ticks.filter("seq <> 9999")).collect()}
    assert late >= 1
    assert set(got) <= set(want) and len(got) >= len(want) - 1
    for k in got:
        assert (got[k]["open"], got[k]["close"], got[k]["volume"]) == (want[k]["open"], want[k]["close"], want[k]["volume"])


def test_boundary_tick_opens_the_next_bar(spark):
    rows = [("A", T0, 1, 10.0, 1), ("A", T0 + dt.timedelta(seconds=59), 2, 11.0, 1), ("A", T0 + dt.timedelta(seconds=60), 3, 12.0, 1)]
    bars = intraday.bars_from_ticks(spark.createDataFrame(rows, TICK)).orderBy("datetime").collect()
    assert [(b["open"], b["close"], b["volume"]) for b in bars] == [(10.0, 11.0, 2), (12.0, 12.0, 1)]


def test_half_past_hours_drop_the_open_window(spark):
    rows = [("A", dt.datetime(2024, 1, 2, 14, 30) + dt.timedelta(minutes=i), 10.0 + i, 12.0 + i, 9.0 + i, 11.0 + i, 100 * (i + 1)) for i in range(90)]
    m = spark.createDataFrame(rows, "ticker string, datetime timestamp, open double, high double, low double, close double, volume bigint")
    hours = intraday.completed_only(intraday.resample(m, "1h", "30 minutes"), m, "1h").collect()
    assert len(hours) == 1
    h = hours[0]
    assert (h["datetime"], h["open"], h["high"], h["low"], h["close"]) == (dt.datetime(2024, 1, 2, 14, 30), 10.0, 71.0, 9.0, 70.0)
    assert h["volume"] == sum(100 * (i + 1) for i in range(60))


def test_repeated_fills_count_once(spark, tmp_path):
    row = lambda i: (i, T0 + dt.timedelta(seconds=i), "A", "BUY" if i % 2 else "SELL", 2.0, 10.0)
    cols = "fill_id bigint, ts timestamp, ticker string, side string, shares double, price double"
    for ids in ([1, 2, 3], [3, 4], [1, 5]):
        spark.createDataFrame([row(i) for i in ids], cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = str(tmp_path / "out")
    jobs.drain(jobs.fill_metrics(stream(spark, str(tmp_path / "in"))), "f", "complete", jobs.snapshot_batch(table))
    r = spark.read.parquet(table).first()
    assert (r["n_fills"], r["shares"], r["cash_flow"]) == (5, 10.0, -20.0)


def test_cooldown_holds_across_batches(spark, tmp_path):
    cols = "alert_type string, ts timestamp, alert_id bigint, value double"
    for secs in ([0, 100], [299, 300], [301, 650]):
        spark.createDataFrame([("dd", T0 + dt.timedelta(seconds=s), s, 1.0) for s in secs], cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, _ = jobs.drain(jobs.alert_cooldown(stream(spark, str(tmp_path / "in"))), "c")
    assert sorted(r["alert_id"] for r in spark.read.parquet(out).collect()) == [0, 300, 650]


def test_warm_scores_emit_new_keys_only(spark):
    bar = lambda i: ("A", T0 + dt.timedelta(minutes=i), 100.0 + (i % 7), 10 + i % 3)
    cols = "ticker string, datetime timestamp, close double, volume bigint"
    s = "signal_vwap_mean_reversion_60b"
    cold = jobs.warm_scores(spark.createDataFrame([bar(i) for i in range(50)], cols), None, intraday.vwap_mean_reversion, s)
    assert {r[s] for r in cold.collect()} == {0.0}
    new, history = spark.createDataFrame([bar(i) for i in range(200, 203)], cols), spark.createDataFrame([bar(i) for i in range(200)], cols)
    warm = jobs.warm_scores(new, history, intraday.vwap_mean_reversion, s).orderBy("datetime").collect()
    whole = intraday.vwap_mean_reversion(history.unionByName(new)).orderBy(F.col("datetime").desc()).limit(3).collect()
    assert [r[s] for r in warm] == pytest.approx([r[s] for r in reversed(whole)])


def test_scoring_keeps_a_bounded_state_over_batches_and_repeats(spark, tmp_path):
    """Scores over many batches are those of the whole series; a batch that runs again changes nothing."""
    bar = lambda k, i: (k, T0 + dt.timedelta(minutes=i), 100.0 + (i * i % 11), 10 + i % 3)
    cols, s, folder = "ticker string, datetime timestamp, close double, volume bigint", "signal_vwap_mean_reversion_60b", str(tmp_path / "w")
    cuts = [(0, 90), (90, 700), (690, 720), (720, 730)]  # the third brings ten bars again
    batches = [spark.createDataFrame([bar("A", i) for i in range(a, b)] + ([bar("B", i) for i in range(a, a + 5)] if n != 2 else []), cols) for n, (a, b) in enumerate(cuts)]
    step = jobs.scoring_batch(folder, intraday.vwap_mean_reversion, s)
    for n, batch in enumerate(batches):
        step(batch, n)
    step(batches[3], 3)
    whole = spark.createDataFrame([bar("A", i) for i in range(730)], cols)
    want = {r["datetime"]: r[s] for r in intraday.vwap_mean_reversion(whole).collect()}
    got = spark.read.parquet(f"{folder}/batch=*")
    last = got.filter("ticker = 'A'").orderBy(F.col("datetime").desc()).limit(40).collect()
    assert [r[s] for r in last] == pytest.approx([want[r["datetime"]] for r in last])
    assert got.count() == sum(b - a for a, b in cuts) + 15 and {r[s] for r in got.filter("ticker = 'B'").collect()} == {0.0}
    state = spark.read.parquet(f"{folder}/state-1")
    assert {r["ticker"]: r["count"] for r in state.groupBy("ticker").count().collect()} == {"A": jobs.WARM_BARS, "B": 15}
    # rows from bars older than two batches are nowhere read: only the state and the batch are
    assert spark.read.parquet(f"{folder}/state-0").filter("ticker = 'A'").agg(F.max("datetime")).first()[0] == T0 + dt.timedelta(minutes=719)


def test_session_hours_follow_daylight_saving(spark):
    rows = [("A", dt.datetime(2024, 1, 5, 14, 30)), ("A", dt.datetime(2024, 1, 5, 13, 30)), ("A", dt.datetime(2024, 7, 5, 13, 30)), ("A", dt.datetime(2024, 7, 5, 20, 0))]
    df = spark.createDataFrame(rows, "ticker string, datetime timestamp")
    assert sorted(r["datetime"].month for r in intraday.local_session(df).collect()) == [1, 7]
    assert intraday.utc_session(df).count() == 2


def test_calendar(spark):
    days = [r["date"] for r in intraday.trading_days(spark, dt.date(2024, 7, 1), dt.date(2024, 7, 8)).orderBy("date").collect()]
    assert dt.date(2024, 7, 4) not in days and len(days) == 5
    assert intraday.last_trading_days(spark, dt.date(2024, 7, 8), 3).count() == 3
