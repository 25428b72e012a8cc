"""Statistics over the trailing rows of a series, in frames of any length.

Spark's sliding frames go through a row's whole frame again for every row, one value at a time. Here a partition's
sorted series pass through in pieces, and a task steps through the places of a frame instead: the k-th value of every
frame is added at once, in the order and by the formulas of Spark's ``avg`` and ``stddev_samp``, so the results are the
same to the last bit. NULLs are passed over; a NaN stays in the frames that hold it. A task holds a piece of ``PIECE``
rows and the series at its end, which the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

PIECE = 20_000


def frame_stats(x: np.ndarray, known: np.ndarray, starts: np.ndarray, n: int, spread: bool) -> dict[str, np.ndarray]:
    """Count, mean, variance and deviation of the known values among every row's last ``n``; a series begins at each of ``starts``."""
    n = min(n, int(np.diff(np.r_[starts, len(x)]).max()))
    # n - 1 empty places ahead of each series keep the frames of neighbours apart
    place = np.arange(len(x)) + (n - 1) * np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
    rows = int(place[-1]) + 1
    values, there = np.zeros(n - 1 + rows), np.zeros(n - 1 + rows, bool)
    values[place + n - 1], there[place + n - 1] = np.where(known, x, 0.0), known
    seen = np.r_[0, np.cumsum(there)]
    out = {"count": seen[n:] - seen[:rows]}
    with np.errstate(all="ignore"):
        total = np.zeros(rows)
        for k in range(n):
            total += values[k : k + rows]
        out["avg"] = total / out["count"]
        if spread:
            absent = ~there
            size, mean, m2, delta, step = (np.zeros(rows) for _ in range(5))
            for k in range(n):
                size += there[k : k + rows]
                np.subtract(values[k : k + rows], mean, out=delta)
                np.copyto(delta, 0.0, where=absent[k : k + rows])
                np.divide(delta, np.maximum(size, 1.0, out=step), out=step)
                mean += step
                np.subtract(delta, step, out=step)
                step *= delta
                m2 += step
            out["var"] = m2 / (size - 1.0)
            out["std"] = np.sqrt(out["var"])
    return {c: v[place] for c, v in out.items()}


def _starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The rows at which a series begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in keys:
        codes = table.column(c).combine_chunks().dictionary_encode()
        codes = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _pieces(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole series, about ``PIECE`` rows at a time, and where each begins."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= PIECE:
            table = pa.Table.from_batches(held)
            starts = _starts(table, keys)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]).combine_chunks(), starts[:-1]
            held = table.slice(starts[-1]).combine_chunks().to_batches()
            rows = 0  # a long series is looked through once a piece, not once a batch
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table, _starts(table, keys)


def _series_pass(keys: Sequence[str], asked: Mapping[str, tuple[str, str, int]], keep: int):
    """Sorted series with a column for each of ``asked`` (name: kind, input, rows) behind the first ``keep`` columns."""
    wide = {(name, n) for kind, name, n in asked.values() if kind in ("std", "var")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _pieces(batches, keys):
            column = lambda c: pa.concat_arrays(table.column(c).chunks)
            edges = np.r_[starts, table.num_rows]
            first, end = (np.repeat(e, np.diff(edges)) for e in (edges[:-1], edges[1:]))
            found, out = {}, table.select(range(keep))
            for name, (kind, source, n) in asked.items():
                if kind == "lag":
                    row = np.arange(table.num_rows) - n
                    out = out.append_column(name, column(source).take(pa.array(row, mask=(row < first) | (row >= end))))
                    continue
                if (source, n) not in found:
                    values = column(source)
                    known = ~np.asarray(values.is_null())
                    found[source, n] = frame_stats(values.fill_null(0.0).to_numpy(zero_copy_only=False), known, starts, n, (source, n) in wide)
                least = {"count": 0, "avg": 1}.get(kind, 2)
                out = out.append_column(name, pa.array(found[source, n][kind], mask=found[source, n]["count"] < least))
            yield from out.combine_chunks().to_batches()

    return run


class Rolls:
    """What columns ask of a series' neighbouring rows, worked out together by ``added``."""

    def __init__(self, ts: str = "date", *keys: str):
        self.ts, self.keys = ts, list(keys or ("ticker",))
        self._inputs: dict[str, tuple[str, Column]] = {}
        self._asked: dict[tuple[str, str, int], str] = {}

    def ask(self, kind: str, x: Column | str, n: int) -> Column:
        """A statistic of the last ``n`` rows, or for ``lag`` the value ``n`` rows before."""
        c = F.col(x) if isinstance(x, str) else x
        c = c if kind == "lag" else c.cast("double")
        source = self._inputs.setdefault(str(c), (f"_roll_in{len(self._inputs)}", c))[0]
        return F.col(self._asked.setdefault((kind, source, n), f"_roll{len(self._asked)}"))

    def added(self, df: DataFrame) -> DataFrame:
        if not self._asked:
            return df
        if all(kind == "lag" for kind, _, _ in self._asked):
            source = dict(self._inputs.values())
            return df.withColumns({name: F.lag(source[x], n).over(self.spec) for (_, x, n), name in self._asked.items()})
        held = df.select("*", *[c.alias(name) for name, c in self._inputs.values()])
        kinds = {"count": LongType()}
        fields = [StructField(name, held.schema[x].dataType if kind == "lag" else kinds.get(kind, DoubleType()))
                  for (kind, x, _), name in self._asked.items()]
        run = _series_pass(self.keys, {name: key for key, name in self._asked.items()}, len(df.columns))
        held = held.repartition(*self.keys).sortWithinPartitions(*self.keys, self.ts)
        return held.mapInArrow(run, StructType([*df.schema.fields, *fields]))

    @property
    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.ts)

    @property
    def columns(self) -> list[str]:
        return list(self._asked.values())


def with_rolled(df: DataFrame, build: Callable[[Rolls], Mapping[str, Column]], ts: str = "date", *keys: str) -> DataFrame:
    """Add the columns that ``build`` makes from neighbouring rows: one exchange by key for all of them."""
    rolls = Rolls(ts, *keys)
    columns = dict(build(rolls))
    return rolls.added(df).withColumns(columns).drop(*rolls.columns)
