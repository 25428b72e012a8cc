"""Row-frame statistics that are NULL until enough values have been seen.

Spark frames return partial results at the start of a series; every helper here
guards with a count of the non-null values instead. ``w`` is a window over a series or,
where frames are long or many, a ``Rolls`` that works them out together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tickerloom.plans.rolls import Rolls


def series(ts: str = "date", *keys: str) -> WindowSpec:
    """One ordered series per key.

    Daily bars are unique per (ticker, date), so a series holds at most one row a
    calendar day (36,525 a century) however large the table is.
    """
    return Window.partitionBy(*(keys or ("ticker",))).orderBy(ts)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


_AGGREGATES = {"count": F.count, "avg": F.avg, "std": F.stddev_samp, "var": F.var_samp}


def _stat(kind: str, x, n: int, w: WindowSpec | Rolls) -> Column:
    return w.ask(kind, x, n) if isinstance(w, Rolls) else _AGGREGATES[kind](_col(x)).over(trailing(w, n))


def lag(x, n: int, w: WindowSpec | Rolls) -> Column:
    return w.ask("lag", x, n) if isinstance(w, Rolls) else F.lag(_col(x), n).over(w)


def _guarded(kind: str, x, n: int, w, m: int | None) -> Column:
    return F.when(_stat("count", x, n, w) >= (n if m is None else m), _stat(kind, x, n, w))


def rolling_mean(x, n: int, w: WindowSpec | Rolls, m: int | None = None) -> Column:
    return _guarded("avg", x, n, w, m)


def rolling_sum(x, n: int, w: WindowSpec, m: int | None = None) -> Column:
    x, f = _col(x), trailing(w, n)
    return F.when(F.count(x).over(f) >= (n if m is None else m), F.sum(x).over(f))


def rolling_std(x, n: int, w: WindowSpec | Rolls, m: int | None = None) -> Column:
    return _guarded("std", x, n, w, m)


def rolling_var(x, n: int, w: WindowSpec | Rolls, m: int | None = None) -> Column:
    return _guarded("var", x, n, w, m)


def rolling_max(x, n: int, w: WindowSpec) -> Column:
    return F.max(_col(x)).over(trailing(w, n))


def nonzero(x) -> Column:
    """NULL in place of 0, for denominators."""
    return F.nullif(_col(x), F.lit(0.0))


def rolling_z(x, n: int, w: WindowSpec | Rolls, m: int | None = None) -> Column:
    mean, std = _stat("avg", x, n, w), _stat("std", x, n, w)
    return F.when(_stat("count", x, n, w) >= (n if m is None else m), (_col(x) - mean) / nonzero(std))


def z60(x, w: WindowSpec | Rolls) -> Column:
    """Squashed 60-row z-score, defined from 30 values on."""
    return F.tanh(rolling_z(x, 60, w, 30))


def pct_change(x, n: int, w: WindowSpec | Rolls) -> Column:
    return F.try_divide(_col(x), lag(x, n, w)) - 1


def ema_rows(span: int, tol: float = 1e-9) -> int:
    """Rows after which the weights of an EMA of this span fall below ``tol``."""
    return math.ceil(math.log(tol) / math.log(1 - 2 / (span + 1)))


def ema(x, span: int, w: WindowSpec | Rolls, tol: float = 1e-9) -> Column:
    """Adjusted exponential mean, cut where the weights fall below ``tol``; a NULL ages the rest and adds nothing."""
    x, keep = _col(x), 1 - 2 / (span + 1)
    frame = trailing(w.spec if isinstance(w, Rolls) else w, ema_rows(span, tol))
    fold = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, v: acc * F.lit(keep) + v)
    top = fold(F.collect_list(F.coalesce(x.cast("double"), F.lit(0.0))).over(frame))
    rows, known = F.count(F.lit(1)).over(frame), F.count(x).over(frame)
    full = (F.lit(1.0) - F.pow(F.lit(keep), rows)) / F.lit(1 - keep)
    gaps = fold(F.collect_list(x.isNotNull().cast("double")).over(frame))
    return F.when(known > 0, top / F.when(known == rows, full).otherwise(gaps))


def clip(x, lo: float, hi: float) -> Column:
    x = _col(x)  # least/greatest skip NULLs, hence the guard
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))
