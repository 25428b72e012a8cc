import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickerloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "8g", 4)
    yield s
    s.stop()


def weekdays(start: dt.date, n: int) -> list[dt.date]:
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


@pytest.fixture(scope="session")
def make_bars(spark):
    """ticker → closes; open = close, high = close + 1, low = close - 1."""

    def build(series, start=dt.date(2023, 1, 3), volume=1_000_000):
        rows = []
        for ticker, closes in series.items():
            for d, c in zip(weekdays(start, len(closes)), closes):
                rows.append((ticker, d, float(c), c + 1.0, max(c - 1.0, 1.0), float(c), volume))
        return spark.createDataFrame(
            rows, "ticker string, date date, open double, high double, low double, close double, volume bigint")

    return build
