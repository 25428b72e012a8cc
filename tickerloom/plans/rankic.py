"""Rank correlation of every signal with every outcome of a wide frame, in groups of any size.

A group that fits a task (``VALUES`` numbers) takes one exchange of wide rows, for all signals and outcomes at once.
A larger one is cut at approximate quantiles into bands, as in ``ranks``: rows travel once per outcome with
``TOGETHER`` signals, as arrays by band, and once per pair with the outcome's rank. Every cut is a band of its own,
whose rows are equal: their rank follows from counts, so they are dealt over salts. Band sizes come from one counting
pass; what comes to the driver is cuts and sizes, at most ``FEW_SIZES`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.plans.ranks import BAND_ROWS, MOST_CUTS, SALTS, SAMPLE_A_BAND
from tickerloom.plans.scale import settled

#: Numbers a task holds of a group or band, and rows gathered before they are dealt to bands.
VALUES, CHUNK = 8_000_000, 250_000
FEW_SIZES = 400_000
#: Signals that travel with an outcome at a time; their shuffles are removed before the next ones'.
TOGETHER = 5


def _values(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of an Arrow column, -0 as 0, and where it is not NULL."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    known = ~np.asarray(column.is_null())
    return column.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0, known


def _ranked(values: np.ndarray, order: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Average ranks among the kept rows, in their places; NaN is the largest value and equal to itself."""
    o = order[keep[order]]
    v, out = values[o], np.zeros(len(values))
    if len(o):
        new = (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
        first = np.flatnonzero(np.r_[True, new])
        size = np.diff(np.r_[first, len(o)])
        out[o] = np.repeat(first + (size + 1) / 2, size)
    return out


def _wins(s: np.ndarray, f: np.ndarray) -> tuple[int, int]:
    up = (s > 0) | np.isnan(s)
    return int(up.sum()), int((up & ((f > 0) | np.isnan(f))).sum())


def _sums(cells: Sequence[tuple]) -> pa.Table:
    names = ("_k", "_h", "_n", "_buys", "_wins", "_xy", "_xx", "_yy")
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    return pa.table({c: pa.array([x[i] for x in cells], t) for i, (c, t) in enumerate(zip(names, kinds))})


_SUMS = "_k int, _h int, _n bigint, _buys bigint, _wins bigint, _xy double, _xx double, _yy double"


def _whole_group(keys: Sequence[str], signals: int, outcomes: int):
    """All pairs of a group in one task: a column is sorted once, and ranked once for each set of rows that its pairs keep."""

    def run(table: pa.Table) -> pa.Table:
        s = [_values(table.column(f"_s{k}")) for k in range(signals)]
        f = [_values(table.column(f"_f{h}")) for h in range(outcomes)]
        sort_s, sort_f = [np.argsort(v) for v, _ in s], [np.argsort(v) for v, _ in f]
        cells, made = [], {}

        def centred(side: str, i: int, keep: np.ndarray, rows: bytes, n: int) -> tuple[np.ndarray, float]:
            if (side, i, rows) not in made:
                values, order = (s[i][0], sort_s[i]) if side == "s" else (f[i][0], sort_f[i])
                x = _ranked(values, order, keep)[keep] - (n + 1) / 2
                made[side, i, rows] = x, float(x @ x)
            return made[side, i, rows]

        for k, (sv, sk) in enumerate(s):
            for h, (fv, fk) in enumerate(f):
                keep = sk & fk
                n = int(keep.sum())
                if n:
                    rows = np.packbits(keep).tobytes()
                    (x, xx), (y, yy) = centred("s", k, keep, rows, n), centred("f", h, keep, rows, n)
                    cells.append((k, h, n, *_wins(sv[keep], fv[keep]), float(x @ y), xx, yy))
        out = _sums(cells)
        for i, c in enumerate(keys):
            out = out.add_column(i, table.schema.field(c), pa.chunked_array([table.column(c).combine_chunks().take(pa.array(np.zeros(len(cells), np.int64)))]))
        return out

    return run


def _finished(sums: DataFrame, keys: Sequence[str], signals: Sequence[str], outcomes: Mapping[int, str]) -> DataFrame:
    name = F.array(*[F.lit(s) for s in signals])[F.col("_k")]
    horizon = F.array(*[F.lit(h) for h in outcomes])[F.col("_h")]
    spread = F.sqrt("_xx") * F.sqrt("_yy")
    return sums.select(
        *keys, name.alias("signal"), horizon.alias("horizon"), F.try_divide("_xy", spread).alias("ic"),
        F.coalesce(F.try_divide("_wins", "_buys"), F.lit(0.5)).alias("win_rate"), F.col("_n").alias("n_obs"))


def _wide(df: DataFrame, keys: Sequence[str], signals: Sequence[str], outcomes: Mapping[int, str]) -> DataFrame:
    return df.select(
        *keys, *[F.col(s).cast("double").alias(f"_s{k}") for k, s in enumerate(signals)],
        *[F.col(f).cast("double").alias(f"_f{h}") for h, f in enumerate(outcomes.values())])


def keyed_rank_ic(df: DataFrame, keys: Sequence[str], signals: Sequence[str], outcomes: Mapping[int, str]) -> DataFrame:
    """IC, win rate and rows per (keys, signal, horizon) in groups that a task holds: one row a date or one row a ticker."""
    wide = _wide(df, keys, signals, outcomes)
    schema = ", ".join(f"`{c}` {wide.schema[c].dataType.simpleString()}" for c in keys)
    sums = wide.groupBy(*keys).applyInArrow(_whole_group(keys, len(signals), len(outcomes)), f"{schema}, {_SUMS}")
    return _finished(sums, keys, signals, outcomes)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _bands(values: np.ndarray, groups: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Twice the number of the group's cuts below a value, plus one where it is a cut itself."""
    out = np.zeros(len(values), np.int64)
    order, edges, found = _dealt(groups)
    for lo, hi, g in zip(edges, edges[1:], found):
        at = order[lo:hi]
        out[at] = np.searchsorted(cuts[g], values[at], "left") + np.searchsorted(cuts[g], values[at], "right")
    return out


def _dealt(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by code, where each code's slice begins (and the last ends), and the codes."""
    order = np.argsort(codes, kind="stable")
    c = codes[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
    return order, np.r_[first, len(c)], c[first]


def _salts(bands: np.ndarray, spread: Iterator[int]) -> np.ndarray:
    return np.array([next(spread) % SALTS if b % 2 else -1 for b in bands], np.int32)


def _banded(
    wide: DataFrame, groups: Sequence, kinds: Mapping[str, str], keys: Sequence[str], signals: Sequence[str], outcomes: Mapping[int, str],
    values: int, band: int,
) -> DataFrame:
    """The same in groups of any size; ``wide`` has ``_g`` (a group's number), ``_s<k>`` and ``_f<h>``, and is read three times."""
    spark, n_s, n_f = wide.sparkSession, len(signals), len(outcomes)
    columns = [f"_s{k}" for k in range(n_s)] + [f"_f{h}" for h in range(n_f)]
    biggest = max(r["_rows"] for r in groups)
    # signals travel with an outcome, but alone with its rank
    most = {c: max(1, min(MOST_CUTS, -(-biggest // (max(1, values // (n_s + 1)) if c[1] == "f" else band)))) for c in columns}
    share = min(1.0, SAMPLE_A_BAND * (max(most.values()) + 1) / biggest)
    drawn = wide if share == 1 else wide.sample(share, seed=1)
    found = drawn.groupBy("_g").agg(*[
        F.array_distinct(F.percentile_approx(F.col(c) + 0.0, [(j + 1) / (m + 1) for j in range(m)], max(10_000, 20 * m))).alias(c) for c, m in most.items()]).collect()
    cuts = {c: [np.zeros(0)] * len(groups) for c in columns}
    for r in found:
        for c in columns:
            cuts[c][r["_g"]] = np.array(r[c] or [], float)

    width = 2 * max(most.values()) + 1  # g * width + band is a band's number

    def counted(batches):
        sizes: dict = {}

        def add(k: int, h: int, side: str, codes: np.ndarray) -> None:
            n = np.bincount(codes, minlength=len(groups) * width)
            sizes[k, h, side] = sizes[k, h, side] + n if (k, h, side) in sizes else n

        for t in _chunks(batches):
            g = t.column("_g").to_numpy().astype(np.int64)
            cols = {c: _values(t.column(c)) for c in columns}
            codes = {c: g * width + _bands(v, g, cuts[c]) for c, (v, _) in cols.items()}
            up = {c: (v > 0) | np.isnan(v) for c, (v, _) in cols.items()}
            for k, s in enumerate(columns[:n_s]):
                for h, f in enumerate(columns[n_s:]):
                    keep = cols[s][1] & cols[f][1]
                    add(k, h, "s", codes[s][keep])
                    add(k, h, "f", codes[f][keep])
                    add(k, h, "buys", g[keep & up[s]] * width)
                    add(k, h, "wins", g[keep & up[s] & up[f]] * width)
        for (k, h, side), n in sizes.items():
            at = np.flatnonzero(n)
            yield pa.record_batch({
                "g": pa.array(at // width, pa.int32()), "k": pa.array(np.full(len(at), k), pa.int32()), "h": pa.array(np.full(len(at), h), pa.int32()),
                "side": pa.array([side] * len(at), pa.string()), "band": pa.array(at % width, pa.int32()), "n": pa.array(n[at], pa.int64())})

    sizes = wide.mapInArrow(counted, "g int, k int, h int, side string, band int, n bigint").groupBy("g", "k", "h", "side", "band").agg(
        F.sum("n").alias("n")).toPandas()
    total, before, inside, cells = {}, {}, {}, {}
    for (g, k, h, side), part in sizes.groupby(["g", "k", "h", "side"]):
        if side in ("buys", "wins"):
            cells[g, k, h, side] = int(part["n"].sum())
            continue
        n = np.zeros(int(part["band"].max()) + 1, np.int64)
        n[part["band"].to_numpy()] = part["n"].to_numpy()
        total[g, k, h], inside[g, k, h, side], before[g, k, h, side] = int(n.sum()), n, np.cumsum(n) - n

    def from_middle(key: tuple, side: str, b: int, values: np.ndarray, order: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Twice a row's rank, less twice the mean rank: a whole number."""
        local = np.full(len(values), (inside[*key, side][b] + 1) / 2) if b % 2 else _ranked(values, order, keep)
        return (2 * (before[*key, side][b] + local) - (total[key] + 1)).astype(np.int64)

    def by_outcome(h: int, ks: Sequence[int]):
        def run(batches):
            spread = count()
            for t in _chunks(batches):
                g = t.column("_g").to_numpy().astype(np.int64)
                v, known = _values(t.column(f"_f{h}"))
                at = np.flatnonzero(known)
                order, edges, codes = _dealt(g[at] * width + _bands(v[at], g[at], cuts[f"_f{h}"]))
                if not len(codes):
                    continue
                b, rows, offsets = codes % width, pa.array(at[order]), pa.array(edges, pa.int32())
                names = [f"_s{k}" for k in ks]
                lists = [pa.ListArray.from_arrays(offsets, t.column(c).combine_chunks().take(rows)) for c in (f"_f{h}", *names)]
                yield pa.record_batch([pa.array(codes // width, pa.int32()), pa.array(np.full(len(b), h), pa.int32()), pa.array(b, pa.int32()),
                                       pa.array(_salts(b, spread)), *lists], ["g", "h", "band", "salt", "f", *names])

        return run

    kind, number = (pa.int64(), "bigint") if biggest >= 2**31 else (pa.int32(), "int")

    def outcome_ranked(ks: Sequence[int]):
        def run(t: pa.Table) -> pa.Table:
            g, h, b = (t.column(c)[0].as_py() for c in ("g", "h", "band"))
            flat = lambda c: _values(pa.chunked_array([x.flatten() for x in t.column(c).chunks]))
            fv, _ = flat("f")
            sort, spread, out = np.argsort(fv), count(g + b), []
            for k in ks:
                sv, keep = flat(f"_s{k}")
                if not keep.any():
                    continue
                rank = from_middle((g, k, h), "f", b, fv, sort, keep)[keep]
                sv = sv[keep]
                order, edges, bands = _dealt(_bands(sv, np.full(len(sv), g), cuts[f"_s{k}"]))
                offsets = pa.array(edges, pa.int32())
                out.append(pa.table({
                    "g": pa.array(np.full(len(bands), g), pa.int32()), "k": pa.array(np.full(len(bands), k), pa.int32()), "h": pa.array(np.full(len(bands), h), pa.int32()),
                    "band": pa.array(bands, pa.int32()), "salt": pa.array(_salts(bands, spread)), "s": pa.ListArray.from_arrays(offsets, pa.array(sv[order])),
                    "y": pa.ListArray.from_arrays(offsets, pa.array(rank[order], kind))}))
            if not out:
                return pa.table({c: pa.array([], x) for c, x in (
                    *((c, pa.int32()) for c in ("g", "k", "h", "band", "salt")), ("s", pa.list_(pa.float64())), ("y", pa.list_(kind)))})
            return pa.concat_tables(out)

        return run

    def signal_ranked(t: pa.Table) -> pa.Table:
        g, k, h, b = (t.column(c)[0].as_py() for c in ("g", "k", "h", "band"))
        s = np.concatenate([x.flatten().to_numpy() for x in t.column("s").chunks])
        y = np.concatenate([x.flatten().to_numpy() for x in t.column("y").chunks]).astype(float) / 2
        x = from_middle((g, k, h), "s", b, s, np.argsort(s), np.ones(len(s), bool)) / 2
        return pa.table({"_g": pa.array([g], pa.int32()), "_k": pa.array([k], pa.int32()), "_h": pa.array([h], pa.int32()),
                         "_xy": [float(x @ y)], "_xx": [float(x @ x)], "_yy": [float(y @ y)]})

    def summed(h: int, ks: Sequence[int]) -> DataFrame:
        arrays = ", ".join(f"`{c}` array<double>" for c in ("f", *[f"_s{k}" for k in ks]))
        dealt = wide.select("_g", f"_f{h}", *[f"_s{k}" for k in ks]).mapInArrow(by_outcome(h, ks), f"g int, h int, band int, salt int, {arrays}")
        paired = dealt.groupBy("g", "h", "band", "salt").applyInArrow(
            outcome_ranked(ks), f"g int, k int, h int, band int, salt int, s array<double>, y array<{number}>")
        sums = paired.groupBy("g", "k", "h", "band", "salt").applyInArrow(signal_ranked, "_g int, _k int, _h int, _xy double, _xx double, _yy double")
        return settled(sums.groupBy("_g", "_k", "_h").agg(*[F.sum(c).alias(c) for c in ("_xy", "_xx", "_yy")]))  # a row a pair

    sums = reduce(DataFrame.unionByName, [
        summed(h, range(at, min(at + TOGETHER, n_s))) for h in range(n_f) for at in range(0, n_s, TOGETHER)])
    held = [(*[groups[g][c] for c in keys], g, k, h, n, cells.get((g, k, h, "buys"), 0), cells.get((g, k, h, "wins"), 0))
            for (g, k, h), n in ((tuple(int(i) for i in key), n) for key, n in total.items())]
    key_fields = "".join(f"`{c}` {kinds[c]}, " for c in keys)
    table = spark.createDataFrame(held, f"{key_fields}_g int, _k int, _h int, _n bigint, _buys bigint, _wins bigint")
    return _finished(sums.join(F.broadcast(table), ["_g", "_k", "_h"]), keys, signals, outcomes)


def pooled_rank_ic(df: DataFrame, keys: Sequence[str], signals: Sequence[str], outcomes: Mapping[int, str], values: int = VALUES, band: int = BAND_ROWS) -> DataFrame | None:
    """IC, win rate and rows per (keys, signal, horizon) in groups of any size; None where there are more groups than the driver takes.

    ``df`` is read up to four times.
    """
    wide = _wide(df, keys, signals, outcomes)
    n_cells, n_columns = len(signals) * len(outcomes), len(signals) + len(outcomes)
    counted = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    n_groups, biggest = counted.agg(F.count(F.lit(1)), F.max("_rows")).first()
    if (biggest or 0) * n_columns <= values:
        if keys:
            return keyed_rank_ic(df, keys, signals, outcomes)
        return keyed_rank_ic(df.withColumn("_all", F.lit(0)), ["_all"], signals, outcomes).drop("_all")
    if n_groups * n_cells * (4 * biggest // min(band, max(1, values // (len(signals) + 1))) + 8) > FEW_SIZES:
        return None
    groups = counted.collect()
    kinds = {c: wide.schema[c].dataType.simpleString() for c in keys}
    if keys:
        names = df.sparkSession.createDataFrame([(*[r[c] for c in keys], i) for i, r in enumerate(groups)],
                                                ", ".join([*[f"`_k_{c}` {kinds[c]}" for c in keys], "_g int"]))
        same = F.lit(True)
        for c in keys:
            same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        wide = wide.join(F.broadcast(names), same).drop(*keys, *[f"_k_{c}" for c in keys])
    else:
        wide = wide.withColumn("_g", F.lit(0))
    return _banded(wide, groups, kinds, keys, signals, outcomes, values, band)
