"""Time segments and walk-forward folds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.rolling import series
from tickerloom.operators.features import calendar_window
from tickerloom.operators.metrics import rank_ic_of
from tickerloom.operators.signals import signal_columns
from tickerloom.plans.scale import settled

SEGMENTS = ("train", "validation", "hold_back")


@dataclass(frozen=True)
class SegmentBounds:
    """Contiguous, right-open segments; ``train_start`` None means the first date of the data."""

    train_start: date | None = date(2014, 1, 2)
    train_end: date = date(2020, 1, 2)
    validation_end: date = date(2023, 1, 3)
    validation_start: date | None = None
    hold_back_start: date | None = None
    description: str = ""

    def __post_init__(self):
        if self.validation_start is None:
            object.__setattr__(self, "validation_start", self.train_end)
        if self.hold_back_start is None:
            object.__setattr__(self, "hold_back_start", self.validation_end)
        if self.train_start is not None and self.train_start >= self.train_end:
            raise ValueError("train_start must be before train_end")
        if self.validation_start != self.train_end or self.hold_back_start != self.validation_end:
            raise ValueError("segments must be contiguous")
        if self.train_end >= self.validation_end:
            raise ValueError("train_end must be before validation_end")


def date_index(df: DataFrame) -> DataFrame:
    """Distinct dates with a 0-based position; the calendar bounds its size."""
    return df.select("date").distinct().withColumn("idx", F.row_number().over(calendar_window()) - 1)


def proportional_bounds(df: DataFrame, train: float = 0.6, validation: float = 0.8) -> SegmentBounds:
    """Split the distinct dates by count. Three dates come to the driver."""
    dates = date_index(df)
    n = F.max("idx").over(Window.partitionBy(F.lit(1))) + 1
    cut = dates.withColumn("_n", n).filter(
        (F.col("idx") == 0) | (F.col("idx") == F.floor(F.col("_n") * train)) | (F.col("idx") == F.floor(F.col("_n") * validation)))
    first, a, b = [d for (d,) in cut.orderBy("idx").select("date").collect()]
    return SegmentBounds(first, a, b, description="proportional")


def resolve_bounds(df: DataFrame, bounds: SegmentBounds | None = None) -> SegmentBounds:
    """Fill in an open start; fall back to a proportional split where the data ends before the hold-back."""
    bounds = SegmentBounds() if bounds is None else bounds
    lo, hi = df.agg(F.min("date"), F.max("date")).first()
    if hi is None:
        return bounds
    if hi < bounds.hold_back_start:
        return proportional_bounds(df)
    return replace(bounds, train_start=lo) if bounds.train_start is None else bounds


def split_segments(df: DataFrame, bounds: SegmentBounds | None = None) -> dict[str, DataFrame]:
    """Three lazy filters over the same plan."""
    if "date" not in df.columns:
        raise ValueError("a 'date' column is needed to segment")
    b = resolve_bounds(df, bounds)
    d = F.col("date")
    train = d < F.lit(b.train_end)
    if b.train_start is not None:
        train = train & (d >= F.lit(b.train_start))
    return {
        "train": df.filter(train),
        "validation": df.filter((d >= F.lit(b.validation_start)) & (d < F.lit(b.validation_end))),
        "hold_back": df.filter(d >= F.lit(b.hold_back_start)),
    }


def add_segment(df: DataFrame, bounds: SegmentBounds | None = None) -> DataFrame:
    """Tag every row; rows before the start of training count as training."""
    b = resolve_bounds(df, bounds)
    d = F.col("date")
    return df.withColumn(
        "segment", F.when(d < F.lit(b.train_end), "train").when(d < F.lit(b.validation_end), "validation").otherwise("hold_back"))


def segment_table(spark, table: str = "gold_daily", bounds: SegmentBounds | None = None) -> dict[str, DataFrame]:
    """Segments of a registered view."""
    if not spark.catalog.tableExists(table):
        raise ValueError(f"Table '{table}' not found")
    return split_segments(spark.table(table), SegmentBounds() if bounds is None else bounds)


def segment_stats(tagged: DataFrame) -> DataFrame:
    """Rows, share, date range and tickers per segment of a tagged frame."""
    out = tagged.groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("start"), F.max("date").alias("end"),
        F.countDistinct("ticker").alias("tickers"))
    total = F.sum("rows").over(Window.partitionBy(F.lit(1)))  # three rows
    return out.withColumn("pct", 100.0 * F.col("rows") / total)


def assert_segment_coverage(tagged: DataFrame, minimum: float = 0.05) -> dict[str, float]:
    """Share of each segment; raises where one is under the minimum."""
    counts = {s: 0 for s in SEGMENTS} | {r["segment"]: r["count"] for r in tagged.groupBy("segment").count().collect()}
    total = sum(counts.values())
    if total == 0:
        raise ValueError("Total segment size is 0")
    shares = {s: n / total for s, n in counts.items()}
    small = {s: f for s, f in shares.items() if f < minimum}
    if small:
        raise ValueError(f"segments under {minimum:.0%} of all rows: {small}")
    return shares


def date_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


@dataclass(frozen=True)
class FoldConfig:
    train: int = 504
    evaluate: int = 63
    step: int = 21

    def shrunk(self, n_dates: int) -> FoldConfig:
        """Smaller windows where the dates do not hold one fold."""
        if n_dates >= self.train + self.evaluate:
            return self
        return FoldConfig(max(int(n_dates * 0.6), 30), max(int(n_dates * 0.2), 10), max(int(n_dates * 0.1), 5))


def fold_table(df: DataFrame, cfg: FoldConfig = FoldConfig()) -> DataFrame:
    """One row per fold with its date bounds and row counts."""
    per_date = df.groupBy("date").agg(F.count(F.lit(1)).alias("_rows"))
    w = calendar_window()
    d = per_date.withColumns(
        {"idx": F.row_number().over(w) - 1, "_upto": F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda k: F.lead("date", k).over(w)
    upto = lambda k: F.lead("_upto", k).over(w)
    before = F.col("_upto") - F.col("_rows")
    t, e = cfg.train, cfg.evaluate
    return (
        d.withColumns({
            "train_start": F.col("date"), "train_end": at(t - 1), "eval_start": at(t), "eval_end": at(t + e - 1),
            "train_rows": upto(t - 1) - before, "eval_rows": upto(t + e - 1) - upto(t - 1)})
        .filter((F.col("idx") % cfg.step == 0) & F.col("eval_end").isNotNull())
        .select((F.col("idx") / cfg.step).cast("int").alias("fold"), "train_start", "train_end", "eval_start", "eval_end",
                "train_rows", "eval_rows")
    )


def eval_membership(df: DataFrame, cfg: FoldConfig = FoldConfig()) -> DataFrame:
    """(date, fold) for every evaluation window a date lies in: at most ceil(evaluate/step) rows a date."""
    dates = date_index(df)
    n = F.max("idx").over(Window.partitionBy(F.lit(1))) + 1
    i = F.col("idx")
    last_fold = F.floor((F.col("_n") - cfg.train - cfg.evaluate) / cfg.step)
    lo = F.greatest(F.lit(0), F.ceil((i - cfg.train - cfg.evaluate + 1) / cfg.step))
    hi = F.least(last_fold, F.floor((i - cfg.train) / cfg.step))
    return (
        dates.withColumn("_n", n).withColumns({"_lo": lo.cast("int"), "_hi": hi.cast("int")})
        .filter((F.col("_hi") >= F.col("_lo")) & (i >= cfg.train))
        .select("date", F.explode(F.sequence("_lo", "_hi")).alias("fold"))
    )


def fold_metrics(
    df: DataFrame, cfg: FoldConfig = FoldConfig(), horizons: Sequence[int] = (1, 5, 21), target: str = "return",
    signals: Sequence[str] | None = None,
) -> DataFrame:
    """IC, win rate and rows per (fold, signal, horizon) on evaluation rows only.

    The outcome is looked up inside the evaluation window, so the last ``h`` rows of a ticker
    have none. ``target='level'`` takes the future close itself instead of the return.
    """
    signals = signal_columns(df) if signals is None else list(signals)
    if not signals:
        raise ValueError("No signal columns found (expected columns prefixed with 'signal_')")
    # looked up once per ticker; a fold's dates are contiguous, so an outcome belongs to it unless it closes after its end
    w = series()
    ahead = {f"_f{h}": F.lead("close", h).over(w) for h in horizons} | {f"_d{h}": F.lead("date", h).over(w) for h in horizons}
    rows = df.select("ticker", "date", "close", *signals).withColumns(ahead)
    rows = settled(rows.drop("ticker"))
    bounds = fold_table(df, cfg).drop("train_rows", "eval_rows")
    member = eval_membership(df, cfg).join(F.broadcast(bounds.select("fold", "eval_end")), "fold")
    rows = rows.join(F.broadcast(member), "date")
    outcome = {h: F.when(F.col(f"_d{h}") <= F.col("eval_end"), F.col(f"_f{h}")) for h in horizons}
    if target == "return":
        outcome = {h: F.try_divide(c, F.col("close")) - 1 for h, c in outcome.items()}
    rows = rows.withColumns({f"_f{h}": c for h, c in outcome.items()})
    ic = rank_ic_of(rows, signals, horizons, ["fold"], 2, "_f{h}")
    ic = ic.withColumn("ic", F.coalesce("ic", F.lit(0.0)))
    return ic.join(F.broadcast(bounds), "fold")


def aggregate_folds(metrics: DataFrame) -> DataFrame:
    mean, spread = F.avg("ic"), F.stddev_pop("ic")
    return metrics.groupBy("signal", "horizon").agg(
        F.count(F.lit(1)).alias("fold_count"), mean.alias("mean_ic"), spread.alias("std_ic"),
        (spread / F.nullif(F.abs(mean), F.lit(0.0))).alias("ic_cv"))


def walk_forward(df: DataFrame, cfg: FoldConfig = FoldConfig(), horizons: Sequence[int] = (1, 5, 21), target: str = "return") -> DataFrame:
    return aggregate_folds(fold_metrics(df, cfg, horizons, target))


def walk_forward_on_hold_back(
    df: DataFrame, cfg: FoldConfig = FoldConfig(), horizons: Sequence[int] = (1, 5, 21), bounds: SegmentBounds | None = None
) -> DataFrame:
    """Folds of the hold-back only, with smaller windows where it is short."""
    held = split_segments(df, bounds)["hold_back"]
    n = held.select("date").distinct().count()
    if n == 0:
        raise ValueError("Hold-back segment is empty")
    return walk_forward(held, cfg.shrunk(n), horizons)


def walk_forward_lines(aggregated: DataFrame) -> DataFrame:
    line = F.format_string("%s %dd: folds=%d, IC=%.4f, IC_std=%.4f", "signal", "horizon", "fold_count", "mean_ic", "std_ic")
    return aggregated.select("signal", "horizon", line.alias("line"))
