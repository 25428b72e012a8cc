"""Bar-length names and intervals."""

from __future__ import annotations

import re

# Accepted unit spellings and their seconds.
UNIT_SECONDS = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "": 60}


def parse_seconds(text: str | int) -> int:
    """'1min', '5m', '1h', '30s' or a bare number of minutes; anything else means one minute."""
    found = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", str(text).lower())
    if not found or found[2] not in UNIT_SECONDS or int(found[1]) == 0:
        return 60
    return int(found[1]) * UNIT_SECONDS[found[2]]


def parse_minutes(text: str | int) -> float:
    return parse_seconds(text) / 60


def interval(text: str | int) -> str:
    return f"{parse_seconds(text)} seconds"
