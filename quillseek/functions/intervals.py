"""Intervals of date buckets: calendar units, fixed durations, and one that suits a range."""

from __future__ import annotations

import datetime as dt
import re

#: Names of calendar units.
CALENDAR = {
    "s": "second", "1s": "second", "second": "second",
    "m": "minute", "1m": "minute", "minute": "minute",
    "h": "hour", "1h": "hour", "hour": "hour",
    "d": "day", "1d": "day", "day": "day",
    "w": "week", "1w": "week", "week": "week",
    "M": "month", "1M": "month", "month": "month",
    "q": "quarter", "1q": "quarter", "quarter": "quarter",
    "y": "year", "1y": "year", "year": "year",
}
#: Seconds that a calendar unit has at least.
LEAST_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604_800, "month": 28 * 86400, "quarter": 90 * 86400, "year": 365 * 86400}
_fixed = re.compile(r"([+-]?)(\d+(?:\.\d+)?)(ms|[smhdw])$")
_seconds = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
POINTS = 100


def seconds(text: str) -> float:
    m = _fixed.match(text.strip())
    if not m:
        raise ValueError(f"not a duration: {text}")
    return (-1 if m[1] == "-" else 1) * float(m[2]) * _seconds[m[3]]


def interval(text: str | None, start: dt.datetime | None = None, end: dt.datetime | None = None) -> tuple[str, str | float]:
    """("calendar", unit) or ("fixed", seconds). Without a text: days, or about POINTS steps of the range."""
    if text:
        text = text.strip()
        found = CALENDAR.get(text) or CALENDAR.get(text.lower() if len(text) > 2 else text)
        if found:
            return "calendar", found
        if (size := seconds(text)) <= 0:
            raise ValueError(f"not an interval: {text}")
        return "fixed", size
    if start is None or end is None:
        return "calendar", "day"
    step = (end - start).total_seconds() / POINTS
    for size in (86400, 3600, 60):
        if step >= size:
            return "fixed", float(round(step / size) * size)
    return "fixed", float(max(1, round(step / 15)) * 15)
