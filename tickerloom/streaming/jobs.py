"""Structured Streaming versions of the tick, bar, fill and alert steps.

Each transformation takes a streaming DataFrame and also runs on a batch one, which is how
they are checked against each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickerloom.functions.timeframe import interval
from tickerloom.operators.intraday import bars_from_ticks, resample
from tickerloom.session import shared_base

WARM_BARS, MIN_BARS = 500, 60


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a table as a stream; the table is one file or a folder of part files, on any file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if not place.getFileSystem(conf).getFileStatus(place).isDirectory():
        reader, path = reader.option("pathGlobFilter", place.getName()), path.rpartition("/")[0]
    return reader.parquet(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def drain(df: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> tuple[str, int]:
    """Run a stream over everything available; returns the output folder and the rows dropped as late.

    The same call at session end closes the session: it processes what is left and stops.
    """
    spark = df.sparkSession
    out = work_folder(spark, name)
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    usual = spark.conf.get(kept)
    spark.conf.set(kept, "1000000")  # late rows are summed over all batches
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{out}/_checkpoint")
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", f"{out}/data")
    try:
        query = writer.start()
        query.awaitTermination()
    finally:
        spark.conf.set(kept, usual)
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
    return f"{out}/data", late


def tick_bars(ticks: DataFrame, timeframe: str = "1min", delay: str = "0 seconds") -> DataFrame:
    """Bars of closed intervals; ticks later than the watermark delay are dropped and counted."""
    return bars_from_ticks(ticks.withWatermark("ts", delay), timeframe)


def hour_bars(minutes: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Half-past-anchored hours. Append mode never emits the open last window."""
    return resample(minutes.withWatermark("datetime", delay), "1h", "30 minutes")


def minute_keys(bars: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One row per (ticker, minute) however often a poll repeats it."""
    return bars.withColumn("minute", F.date_trunc("minute", "ts")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ticker", "minute"])


def force_close(ticks: DataFrame, emitted: DataFrame, timeframe: str = "1min") -> DataFrame:
    """Bars a stopped stream had not emitted yet, with their true volume."""
    return bars_from_ticks(ticks, timeframe).join(emitted.select("ticker", "datetime"), ["ticker", "datetime"], "left_anti")


def newest_bars(new: DataFrame, state: DataFrame | None) -> DataFrame:
    """The last 500 bars of each ticker; a bar that comes again replaces the one kept."""
    if state is not None:
        new = new.unionByName(state.join(new.select("ticker", "datetime"), ["ticker", "datetime"], "left_anti").select(*new.columns))
    recent = Window.partitionBy("ticker").orderBy(F.col("datetime").desc())
    return new.withColumn("_n", F.row_number().over(recent)).filter(F.col("_n") <= WARM_BARS).drop("_n")


def warm_scores(new: DataFrame, history: DataFrame | None, score: Callable[[DataFrame], DataFrame], signal: str) -> DataFrame:
    """Score new bars behind the last 500 stored ones; emit the new keys only, 0 until 60 bars are known."""
    rows = new.withColumn("_new", F.lit(True))
    if history is not None:
        recent = Window.partitionBy("ticker").orderBy(F.col("datetime").desc())
        primed = history.join(new.select("ticker", "datetime"), ["ticker", "datetime"], "left_anti")
        primed = primed.select(*new.columns).withColumn("_n", F.row_number().over(recent)).filter(F.col("_n") <= WARM_BARS).drop("_n")
        rows = rows.unionByName(primed.withColumn("_new", F.lit(False)))
    seen = F.row_number().over(Window.partitionBy("ticker").orderBy("datetime"))
    scored = score(rows).withColumn("_seen", seen)
    value = F.when(F.col("_seen") >= MIN_BARS, F.coalesce(signal, F.lit(0.0))).otherwise(F.lit(0.0))
    return scored.withColumn(signal, value).filter("_new").select(*new.columns, signal)


def scoring_batch(folder: str, score: Callable[[DataFrame], DataFrame], signal: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch step: the state is each ticker's last 500 bars, whatever number of batches came before.

    Two state folders take turns, so a batch reads the one before it left and writes the other one. A
    repeated batch finds its input as it was and overwrites its own rows and state.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, after = (f"{folder}/state-{i % 2}" for i in (batch_id - 1, batch_id))
        state = spark.read.schema(batch.schema).parquet(before) if batch_id else None
        warm_scores(batch, state, score, signal).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        newest_bars(batch, state).write.mode("overwrite").parquet(after)

    return run


def fill_metrics(fills: DataFrame, delay: str = "1 day") -> DataFrame:
    """Running totals per ticker over fills counted once each."""
    once = fills.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fill_id"])
    value = F.col("shares") * F.col("price")
    return once.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_fills"), F.sum("shares").alias("shares"),
        F.sum(F.when(F.col("side") == "BUY", -value).otherwise(value)).alias("cash_flow"))


def snapshot_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch step for complete mode: the newest table replaces the last one."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    return run


def _fire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, span: int) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["ts", "alert_id"], kind="stable")
    keep = []
    for i, us in enumerate(rows["ts"].astype("datetime64[us]").astype("int64")):
        if last is None or us - last >= span:
            keep.append(i)
            last = int(us)
    state.update((last,))
    yield rows.iloc[keep]


def alert_cooldown(alerts: DataFrame, seconds: int = 300) -> DataFrame:
    """At most one alert per type in ``seconds``; the state is the time the type last fired.

    Columns: alert_type, ts, alert_id, value. Alerts are the few rows that crossed a threshold,
    and one micro-batch bounds what a type sees at once.
    """
    span = seconds * 1_000_000
    schema = "alert_type string, ts timestamp, alert_id bigint, value double"
    return alerts.select("alert_type", "ts", "alert_id", "value").groupBy("alert_type").applyInPandasWithState(
        lambda key, batches, state: _fire(key, batches, state, span), schema, "last bigint", "append", GroupStateTimeout.NoTimeout)
