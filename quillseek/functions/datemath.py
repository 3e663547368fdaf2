"""Date literals and date arithmetic, evaluated on the driver so that filters push literals down.

`anchor op*`: the anchor is `now`, or an ISO date or time (`2024-01-05||` before operations); an operation is
`+2d`, `-1M` or `/d` (round). Units: y M w d h H m s. Results are UTC without a zone mark.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Callable
from zoneinfo import ZoneInfo

_op = re.compile(r"([+-])(\d*)([yMwdhHms])|/([yMwdhHms])")
_iso = re.compile(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[T ](\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)?)?)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
_offset = re.compile(r"([+-]?)(\d{1,2}):?(\d{2})$")
_duration = re.compile(r"([+-]?)(\d+(?:\.\d+)?)(ms|[smhdw])$")
SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


class DateMathError(ValueError):
    pass


def zone(text: str | None) -> dt.tzinfo:
    """A zone of its id, of `+01:00`, or of a duration such as `1h`."""
    if not text:
        return dt.UTC
    if m := _offset.match(text):
        sign = -1 if m[1] == "-" else 1
        return dt.timezone(sign * dt.timedelta(hours=int(m[2]), minutes=int(m[3])))
    if m := _duration.match(text):
        return dt.timezone((-1 if m[1] == "-" else 1) * dt.timedelta(seconds=float(m[2]) * SECONDS[m[3]]))
    try:
        return ZoneInfo(text)
    except Exception as e:  # noqa: BLE001  zoneinfo raises several kinds
        raise DateMathError(f"unknown time zone {text}") from e


def zone_name(text: str | None) -> str | None:
    """A name that Spark knows: an id, or an offset."""
    if text and (m := _duration.match(text)):
        minutes = int(float(m[2]) * SECONDS[m[3]] // 60)
        return f"{'-' if m[1] == '-' else '+'}{minutes // 60:02d}:{minutes % 60:02d}"
    return text or None


def _add(t: dt.datetime, n: int, unit: str) -> dt.datetime:
    try:
        return _added(t, n, unit)
    except (ValueError, OverflowError) as e:
        raise DateMathError(f"no date: {t:%Y-%m-%d} and {n}{unit}") from e


def _added(t: dt.datetime, n: int, unit: str) -> dt.datetime:
    if unit in "yM":
        months = t.year * 12 + t.month - 1 + n * (12 if unit == "y" else 1)
        year, month = divmod(months, 12)
        return t.replace(year=year, month=month + 1, day=min(t.day, calendar.monthrange(year, month + 1)[1]))
    return t + dt.timedelta(seconds=n * SECONDS[unit.lower() if unit == "H" else unit])


def _floor(t: dt.datetime, unit: str) -> dt.datetime:
    if unit == "w":
        t, unit = t - dt.timedelta(days=t.weekday()), "d"
    names = ("year", "month", "day", "hour", "minute", "second", "microsecond")
    keep = {"y": 1, "M": 2, "d": 3, "h": 4, "H": 4, "m": 5, "s": 6}[unit]
    return t.replace(**{n: 1 if n in ("month", "day") else 0 for n in names[keep:]})


def evaluate(text: str, now: Callable[[], dt.datetime], tz: str | None = None) -> tuple[dt.datetime, dt.datetime]:
    """(first instant, first instant after): the span that a literal means, as naive UTC. An exact instant spans one microsecond."""
    text = text.strip()
    local = zone(tz)
    unit = None
    if text.startswith("now"):
        t, rest = now(), text[3:]
        t = t.replace(tzinfo=dt.UTC) if t.tzinfo is None else t
        t = t.astimezone(local)
    else:
        anchor, mark, rest = text.partition("||")
        m = _iso.match(anchor)
        if not m or (not mark and rest):
            raise DateMathError(f"not a date: {text}")
        year, month, day, hour, minute, second, part = m.groups()[:7]
        unit = "y" if month is None else "M" if day is None else "d" if hour is None else "h" if minute is None else "m" if second is None else "s" if part is None else None
        micro = int((part or "0")[:6].ljust(6, "0"))
        try:
            t = dt.datetime(int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0), micro)
        except ValueError as e:
            raise DateMathError(f"not a date: {text}") from e
        t = t.replace(tzinfo=dt.UTC if m[8] == "Z" else zone(m[8]) if m[8] else local)
    at = 0
    for m in _op.finditer(rest):
        if m.start() != at:
            break
        at = m.end()
        if m[4]:
            unit, t = m[4], _floor(t, m[4])
        else:
            n = int(m[2] or 1) * (-1 if m[1] == "-" else 1)
            t, unit = _add(t, n, m[3]), unit if unit and text[:3] != "now" else None
    if at != len(rest):
        raise DateMathError(f"not a date: {text}")
    end = _add(t, 1, unit) if unit else t + dt.timedelta(microseconds=1)
    utc = lambda x: x.astimezone(dt.UTC).replace(tzinfo=None)
    try:
        return utc(t), utc(end)
    except OverflowError as e:
        raise DateMathError(f"no date: {text}") from e


def is_date(text: str) -> bool:
    try:
        evaluate(text, lambda: dt.datetime(2000, 1, 1))
    except DateMathError:
        return False
    return True


def strict(text: str, date_only: bool = False) -> str:
    """The smaller language of relational mode: `now`, one step from it, or a date; else DateMathError."""
    units = "yMd" if date_only else "yMdhHms"
    if text.startswith("now") and not re.fullmatch(rf"now(?:[+-]\d+[{units}])?", text):
        raise DateMathError(f"not supported: {text}")
    return text
