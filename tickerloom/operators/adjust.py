"""Silver layer: backward split and dividend adjustment, quality flags.

Bars and events are put in one ordered series per ticker, so "events on or after the
bar" is a running aggregate from the newest row down instead of a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
SUSPICIOUS_MOVE = 0.20


def _event(df: DataFrame, like: DataFrame, **cols: Column) -> DataFrame:
    """Event rows carrying NULL in every bar column."""
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema if f.name not in ("ticker", "date")]
    return df.select("ticker", cols["date"].alias("date"), *nulls, *[c.alias(n) for n, c in cols.items() if n != "date"])


def _adjust(
    bars: DataFrame,
    splits: DataFrame | None,
    dividends: DataFrame | None,
    inclusive: bool,
    reverse_splits: bool,
) -> DataFrame:
    empty = F.lit(None).cast("double")
    rows = bars.withColumns({"_factor": empty, "_amount": empty, "_bar": F.lit(1)})
    if splits is not None:
        wanted = (F.col("factor") > (0.0 if reverse_splits else 1.0)) & (F.col("factor") != 1.0)
        rows = rows.unionByName(
            _event(splits.filter(wanted), bars, date=F.col("date"), _factor=F.col("factor").cast("double"),
                   _amount=empty, _bar=F.lit(0))
        )
    if dividends is not None:
        rows = rows.unionByName(
            _event(dividends.filter(F.col("amount") > 0), bars, date=F.col("ex_date"), _factor=empty,
                   _amount=F.col("amount").cast("double"), _bar=F.lit(0))
        )

    on_tie = F.col("_bar").asc() if inclusive else F.col("_bar").desc()
    newest_first = Window.partitionBy("ticker").orderBy(F.col("date").desc(), on_tie)
    from_newest = newest_first.rowsBetween(Window.unboundedPreceding, 0)

    if splits is not None:
        rows = rows.withColumn("_split", F.coalesce(F.product("_factor").over(from_newest), F.lit(1.0)))
        rows = rows.withColumns(
            {c: F.col(c) / F.col("_split") for c in PRICES} | {"volume": F.col("volume") * F.col("_split")}
        ).drop("_split")
    if dividends is not None:
        # last close strictly before the ex-date: events sort ahead of the bar of their own day
        oldest_first = Window.partitionBy("ticker").orderBy("date", "_bar").rowsBetween(Window.unboundedPreceding, 0)
        prev = F.when(F.col("_bar") == 0, F.last("close", ignorenulls=True).over(oldest_first))
        rows = rows.withColumn("_prev", prev)
        # each dividend lowers the running factor by amount / previous raw close, so the
        # factor is 1 minus a running sum; once it is used up, older dividends no longer apply
        term = F.when(F.col("_prev") > 0, F.col("_amount") / F.col("_prev"))
        rows = rows.withColumn("_paid", F.coalesce(F.sum(term).over(from_newest), F.lit(0.0)))
        used_up = F.min(F.when(F.col("_paid") >= 1, F.col("_paid"))).over(from_newest)
        rows = rows.withColumn("_keep", 1 - F.coalesce(used_up, F.col("_paid")))
        rows = rows.withColumns({c: F.col(c) * F.col("_keep") for c in PRICES}).drop("_prev", "_paid", "_keep")
    return rows.filter(F.col("_bar") == 1).drop("_factor", "_amount", "_bar")


def adjust_for_splits(
    bars: DataFrame, splits: DataFrame, inclusive: bool = True, reverse_splits: bool = False
) -> DataFrame:
    """Divide prices and multiply volume by every split on or after the bar's date.

    The event day itself counts as "before" unless ``inclusive`` is off; factors of 1 and
    below are ignored unless ``reverse_splits`` is on.
    """
    return _adjust(bars, splits, None, inclusive, reverse_splits)


def adjust_for_dividends(bars: DataFrame, dividends: DataFrame, inclusive: bool = True) -> DataFrame:
    """Scale prices by (c - amount)/c for every dividend on or after the bar's date."""
    return _adjust(bars, None, dividends, inclusive, False)


def build_silver(bars: DataFrame, dividends: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """Adjusted bars with quality flags; one shuffle by ticker covers all of it."""
    splits = None if actions is None else actions.filter(F.col("action_type") == "split")
    out = bars
    if splits is not None or dividends is not None:
        out = _adjust(bars, splits, dividends, True, False)
    prev = F.lag("adj_close").over(Window.partitionBy("ticker").orderBy("date"))
    move = F.abs(F.try_divide(F.col("adj_close"), prev) - 1)
    return (
        out.withColumns(
            {
                "adj_close": F.col("close"),
                "split_factor": F.lit(1.0),
                "dividend_yield": F.lit(0.0),
                "is_market_date": F.lit(True),
                "data_quality": F.when(F.col("volume") == 0, "thin").otherwise("good"),
            }
        ).withColumn("data_quality", F.when(move > SUSPICIOUS_MOVE, "suspicious").otherwise(F.col("data_quality")))
    )
