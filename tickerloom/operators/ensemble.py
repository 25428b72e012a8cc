"""Blending signals by their information coefficients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.rolling import rolling_mean
from tickerloom.operators.features import calendar_window
from tickerloom.operators.metrics import cross_sectional_ic, cs_ic_stats, ic_decay, needed, rank_ic_by, rank_ic_of, signal_stats, to_long
from tickerloom.operators.signals import signal_columns
from tickerloom.plans.scale import settled

METHODS = ("abs_ic", "rank_ic", "positive_ic")


def total(cols: Sequence[Column]) -> Column:
    return reduce(add, cols)


def ic_weights(ics: Mapping[str, Column], method: str = "positive_ic") -> dict[str, Column]:
    """Weights of one row from the ICs in its columns; they sum to 1.

    Unknown methods and rows without any usable IC get equal weights.
    """
    if not ics:
        return {}
    value = {s: F.coalesce(c, F.lit(0.0)) for s, c in ics.items()}
    if method == "abs_ic":
        raw = {s: F.abs(c) for s, c in value.items()}
    elif method == "positive_ic":
        raw = {s: F.greatest(c, F.lit(0.0)) for s, c in value.items()}
    elif method == "rank_ic":
        size = {s: F.round(F.abs(c), 12) for s, c in value.items()}  # equal up to rounding noise is a tie
        raw = {
            s: total([F.when(size[o] < c, 1.0).when(size[o] == c, 0.5).otherwise(0.0) for o in size]) + 0.5
            for s, c in size.items()
        }
    else:
        raw = {s: F.lit(1.0) for s in value}
    whole = total(list(raw.values()))
    return {s: F.when(whole > 0, c / whole).otherwise(F.lit(1.0 / len(raw))) for s, c in raw.items()}


def blend(weights: Mapping[str, Column]) -> Column:
    """Weighted sum of signals, at 12 places so that scores equal up to rounding noise rank as ties."""
    return F.round(total([w * F.coalesce(s, F.lit(0.0)) for s, w in weights.items()]), 12)


def wide_ic(cs_ic: DataFrame, signals: Sequence[str]) -> DataFrame:
    """One row per date, one column per signal."""
    return cs_ic.groupBy("date").agg(*[F.max(F.when(F.col("signal") == s, F.col("cs_ic"))).alias(s) for s in signals])


@dataclass(frozen=True)
class EnsembleConfig:
    lookback: int = 63
    horizon: int = 5
    rebalance_freq: int = 5
    weight_method: str = "positive_ic"
    output: str = "signal_ensemble"
    track_weights: bool = True
    min_rows: int | None = None

    def __post_init__(self):
        if self.lookback < 2 or self.horizon < 1 or self.rebalance_freq < 1:
            raise ValueError("lookback, horizon and rebalance_freq must be positive")


class IcWeightedEnsemble:
    """Weights follow each signal's trailing cross-sectional IC and change on rebalance dates."""

    def __init__(self, config: EnsembleConfig = EnsembleConfig()):
        self.config = config
        self._weights: DataFrame | None = None

    def weights(self, df: DataFrame, signals: Sequence[str], target: str) -> DataFrame:
        """(date, w_<signal>…): one row per date of the panel, so it is small enough to broadcast."""
        cfg = self.config
        horizon = cfg.horizon
        ics = cross_sectional_ic(df.withColumn(f"forward_return_{horizon}", F.col(target)), signals, [horizon])
        dates = df.select("date").distinct().join(wide_ic(ics, signals), "date", "left")
        w = calendar_window()
        m = cfg.min_rows if cfg.min_rows is not None else max(2, cfg.lookback // 3)
        dates = dates.withColumns({f"_m_{s}": rolling_mean(s, cfg.lookback, w, m) for s in signals})
        # an IC is known once its forward window has closed
        dates = dates.withColumns({f"_k_{s}": F.lag(f"_m_{s}", horizon).over(w) for s in signals})
        due = (F.row_number().over(w) - 1) % cfg.rebalance_freq == 0
        dates = dates.withColumn("_due", due)
        held = {
            s: F.last(F.when(F.col("_due"), F.coalesce(f"_k_{s}", F.lit(0.0))), ignorenulls=True).over(
                w.rowsBetween(-(cfg.rebalance_freq - 1), 0))
            for s in signals
        }
        dates = dates.withColumns({f"_h_{s}": c for s, c in held.items()})
        out = ic_weights({s: F.col(f"_h_{s}") for s in signals}, cfg.weight_method)
        return dates.select("date", *[c.alias(f"w_{s}") for s, c in out.items()])

    def transform(self, df: DataFrame, signals: Sequence[str], target: str) -> DataFrame:
        missing = [c for c in (*signals, target) if c not in df.columns]
        if not signals or missing:
            raise ValueError(f"signals needed; missing columns: {missing}")
        self._weights = settled(self.weights(df, signals, target))  # a row a date; what it shuffled is gone
        return self._score(df.join(F.broadcast(self._weights), "date", "left"), signals)

    def predict(self, df: DataFrame, signals: Sequence[str]) -> DataFrame:
        """Score with the newest weights."""
        if self._weights is None:
            raise RuntimeError("Call transform before predict")
        last = self._weights.orderBy(F.col("date").desc()).first()
        return self._score(df.withColumns({f"w_{s}": F.lit(last[f"w_{s}"]) for s in signals}), signals)

    @staticmethod
    def _score(df: DataFrame, signals: Sequence[str]) -> DataFrame:
        return df.withColumn("ensemble_score", blend({s: F.col(f"w_{s}") for s in signals}))


def run_ensemble(df: DataFrame, config: EnsembleConfig = EnsembleConfig(), signals: Sequence[str] | None = None) -> DataFrame:
    """Add the ensemble column (and w_* columns when tracked)."""
    signals = signal_columns(df) if signals is None else list(signals)
    if not signals:
        raise ValueError("no signal columns")
    out = IcWeightedEnsemble(config).transform(df, signals, f"forward_return_{config.horizon}")
    out = out.withColumnRenamed("ensemble_score", config.output)
    return out if config.track_weights else out.drop(*[f"w_{s}" for s in signals])


def weight_stats(df: DataFrame, signals: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"w_{s}").alias("w")) for s in signals])
    return df.select(F.inline(cells)).groupBy("signal").agg(
        F.avg("w").alias("mean"), F.min("w").alias("min"), F.max("w").alias("max"), F.stddev_samp("w").alias("std"))


def static_ensemble(df: DataFrame, signals: Sequence[str], horizon: int = 5, method: str = "positive_ic") -> tuple[DataFrame, DataFrame]:
    """Fixed weights from the pooled ICs: (weights table, frame with ensemble_score).

    One IC per signal name comes to the driver and goes into the plan as a constant.
    """
    ic = {r["signal"]: r["ic"] or 0.0 for r in ic_decay(df, signals, [horizon]).collect()}
    one = df.sparkSession.range(1)
    weights = ic_weights({s: F.lit(ic.get(s, 0.0)) for s in signals}, method)
    table = one.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.lit(ic.get(s, 0.0)).alias("ic"), c.alias("weight")) for s, c in weights.items()])))
    w = {r["signal"]: r["weight"] for r in table.collect()}
    return table, df.withColumn("ensemble_score", blend({s: F.lit(w[s]) for s in signals}))


def validate_ensemble(
    df: DataFrame, signals: Sequence[str], horizon: int = 5, ensemble: str = "signal_ensemble", written: bool = False
) -> DataFrame:
    """Pooled and cross-sectional metrics per signal and for the ensemble; missing columns are skipped.

    ``df`` is written once, unless it is ``written`` already.
    """
    cols = [c for c in (*signals, ensemble) if c in df.columns]
    df = df if written else needed(df, cols, [horizon], ["date"])
    flat = rank_ic_of(df, cols, [horizon]).select("signal", F.col("ic").alias("flat_ic"), "win_rate")
    cs = cs_ic_stats(cross_sectional_ic(df, cols, [horizon])).drop("horizon")
    out = flat.join(cs, "signal", "left")
    size = F.abs("flat_ic")
    mine = F.col("signal") == ensemble
    # one row per signal name
    best = out.agg(F.max(F.when(~mine, size)).alias("_best"), F.max(F.when(mine, size)).alias("_mine"))
    verdict = best.select((F.col("_mine") >= F.col("_best")).alias("dominates_all"), F.lit(ensemble).alias("signal"))
    return out.join(verdict, "signal", "left")


def validation_lines(validated: DataFrame) -> DataFrame:
    tag = F.when(F.coalesce(F.abs("flat_ic"), F.lit(0.0)) > 0.01, "[PASS]").otherwise("[WARN]")
    return validated.select("signal", F.format_string("%s %s IC=%+.4f", tag, "signal", F.coalesce("flat_ic", F.lit(0.0))).alias("line"))
