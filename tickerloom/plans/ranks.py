"""Average-tie ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.plans.scale import settled

#: Rows a band should hold, and the most cuts a group is given; beyond, bands grow (a window spills them).
BAND_ROWS, MOST_CUTS = 1_000_000, 10_000
#: Cells of a table of cuts that are broadcast; beyond, it is joined by shuffle.
FEW_CELLS = 2_000_000
SALTS = 64
#: Rows of the largest group from which a cut is taken.
SAMPLE_A_BAND = 2_000


def series_rank(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], count: str = "") -> DataFrame:
    """Ranks in groups that hold one row a date or one row a ticker: keyed windows, which share one exchange."""
    group = Window.partitionBy(*keys)
    for value, out in values.items():
        w = group.orderBy(F.col(value).asc_nulls_last())
        peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        known = F.col(value).isNotNull()
        df = df.withColumn(out, F.when(known, F.rank().over(w) + (peers - 1) / F.lit(2.0)))
        if count:
            df = df.withColumn(out + count, F.when(known, F.count(value).over(group)))
    return df


def _band(x: Column, cuts: Column, most: int) -> Column:
    """Twice the number of cuts below ``x``, plus one where it is a cut itself."""
    if most <= 16:
        one = lambda test: F.when(test, 1).otherwise(0)
        places = [F.try_element_at(cuts, F.lit(j + 1)) for j in range(most)]
        return reduce(add, [2 * one(c < x) + one(c == x) for c in places])
    # by halving steps
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(most.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at(cuts, at + step) < x, at + step).otherwise(at))
    return F.transform(F.array(below), lambda n: 2 * n + F.when(F.try_element_at(cuts, n + 1) == x, 1).otherwise(0))[0]


def average_ranks(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], count: str = "") -> DataFrame:
    """Add ``out``, the 1-based average-tie rank of a double column within ``keys``, for each ``value: out``; NULLs get none.

    ``count`` (a suffix to ``out``) asks for the number of ranked rows of the group as well.

    A group is cut at approximate quantiles of its own into bands of about ``BAND_ROWS`` rows. Every cut is a
    band of its own: its rows are equal, so their rank follows from the numbers of rows before and in the
    band, without sorting, however many they are; and a value with more rows than a band has is
    a cut. The other bands are sorted each on its own, which is the only exchange of rows a column
    takes; a small table of band sizes supplies what lies before. Cuts come from a sample of rows and decide
    nothing but how even the bands are. They are written once, so a recomputed task uses the same ones.
    ``df`` is read several times.
    """
    keys, tags = list(keys), list(enumerate(values.items()))
    df = df.withColumns({f"_v{i}": F.col(v).cast("double") + F.lit(0.0) for i, (v, _) in tags})
    groups = settled(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f"_v{i}").alias(f"_n{i}") for i, _ in tags]))
    biggest, n_groups = groups.agg(F.max("_rows"), F.count(F.lit(1))).first()
    most = max(1, min(MOST_CUTS, -(-(biggest or 0) // BAND_ROWS)))
    few = n_groups * most * len(tags) <= FEW_CELLS

    def attached(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
        table = table.select(*[F.col(k).alias(f"_k_{k}") for k in on], *[c for c in table.columns if c not in on])
        same = F.lit(True)
        for k in on:
            same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return rows.join(F.broadcast(table) if few else table, same, "left").drop(*[f"_k_{k}" for k in on])

    shares = [(j + 1) / (most + 1) for j in range(most)]
    share = min(1.0, SAMPLE_A_BAND * (most + 1) / max(biggest or 0, 1))
    drawn = df if share == 1 else df.sample(share, seed=1)
    cuts = drawn.groupBy(*keys).agg(
        *[F.array_distinct(F.percentile_approx(f"_v{i}", shares, max(10_000, 20 * most))).alias(f"_c{i}") for i, _ in tags])
    # a number stands for the group from here on
    cuts = settled(attached(groups, cuts, keys).withColumn("_g", F.monotonically_increasing_id()).drop("_rows"))
    df = attached(df, cuts, keys)
    df = df.withColumns({f"_b{i}": F.when(F.col(f"_v{i}").isNotNull(), _band(F.col(f"_v{i}"), F.col(f"_c{i}"), most)) for i, _ in tags})
    df = df.drop(*[f"_c{i}" for i, _ in tags])
    counted = df
    for i, (_, out) in tags:
        heads = counted.filter(F.col(f"_b{i}").isNotNull()).groupBy("_g", f"_b{i}").agg(F.count(F.lit(1)).alias("_size"))
        before = Window.partitionBy("_g").orderBy(f"_b{i}").rowsBetween(Window.unboundedPreceding, -1)  # a row a band
        df = attached(df, heads.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))), ["_g", f"_b{i}"])
        # rows of cuts and NULLs need no order: they are dealt out
        known, on = F.col(f"_v{i}").isNotNull(), F.col(f"_b{i}") % 2 == 1
        salt = F.when(known & ~on, -1).otherwise(F.pmod(F.xxhash64(*[f"_v{j}" for j, _ in tags]), F.lit(SALTS)))
        w = Window.partitionBy("_g", f"_b{i}", "_s").orderBy(f"_v{i}")
        peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        inside = F.when(on, (F.col("_size") + 1) / F.lit(2.0)).otherwise(F.rank().over(w) + (peers - 1) / F.lit(2.0))
        df = df.withColumn("_s", salt).withColumn(out, F.when(known, F.col("_before") + inside))
        if count:
            df = df.withColumn(out + count, F.when(known, F.col(f"_n{i}")))
        df = df.drop("_size", "_before", "_s")
    return df.drop("_g", *[f"_{x}{i}" for i, _ in tags for x in ("v", "n", "b")])
