"""Next times of cron schedules in a time zone.

A field is a set of bits; the next match is searched over days by their month, day and
weekday bits, and within a day over the lowest set bits of hours and minutes, so a
schedule that runs once in years costs one step a day and no minute is walked through.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and largest value of minute, hour, day, month, weekday, and names of the last two.
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()
#: The 29th of February of a weekday comes again after 40 years at most.
YEARS = 41


def _value(text: str, field: int) -> int:
    names = {3: {m: i + 1 for i, m in enumerate(MONTHS)}, 4: {d: i for i, d in enumerate(DAYS)}}.get(field, {})
    return names[text] if text in names else int(text)


def _bits(text: str, field: int) -> int:
    low, high = RANGES[field]
    out = 0
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        a, dash, b = span.partition("-")
        first = low if a in ("*", "?") else _value(a, field)
        last = _value(b, field) if dash else high if a in ("*", "?") or step else first
        if not (low <= first <= last <= high) or step and int(step) < 1:
            raise ValueError(f"field {text!r} is out of range")
        for v in range(first, last + 1, int(step or 1)):
            out |= 1 << v
    return out


@lru_cache(4096)
def parsed(expr: str) -> tuple[int, int, int, int, int, bool]:
    """Bits of the five fields (7 is Sunday, too), and whether either of day and weekday will do, which is so if neither has all values."""
    fields = expr.split()
    if len(fields) != 5:
        raise ValueError("a schedule has five fields")
    minute, hour, day, month, weekday = (_bits(t, i) for i, t in enumerate(fields))
    weekday = (weekday | weekday >> 7) & 127
    return minute, hour, day, month, weekday, day != (1 << 32) - 2 and weekday != 127


def _from(bits: int, low: int) -> int | None:
    """The lowest set bit that is not below ``low``."""
    rest = bits >> low
    return low + (rest & -rest).bit_length() - 1 if rest else None


def next_time(expr: str, after_ms: int, zone: str = "UTC") -> int | None:
    """Milliseconds of the first match behind ``after_ms``; None if there is none or the schedule or zone makes no sense.

    Local times that the clocks skip run as long after the gap as they lie in it; times that
    come twice run the first time only.
    """
    try:
        minute, hour, day, month, weekday, either = parsed(expr)
        tz = ZoneInfo(zone or "UTC")
    except (ValueError, KeyError, OSError):
        return None
    # A skipped time of the hours before may still come.
    start = datetime.fromtimestamp(after_ms // 1000, tz).replace(tzinfo=None) - timedelta(hours=3)
    today: date = start.date()
    for ahead in range(366 * YEARS):
        d = today + timedelta(days=ahead)
        in_days, in_week = day >> d.day & 1, weekday >> d.isoweekday() % 7 & 1
        if not month >> d.month & 1 or not (in_days | in_week if either else in_days & in_week):
            continue
        h, m = (start.hour, start.minute) if d == today else (0, 0)
        h = _from(hour, h)
        while h is not None:
            m = _from(minute, m if d == today and h == start.hour else 0)
            while m is not None:
                at = int(datetime(d.year, d.month, d.day, h, m, tzinfo=tz).astimezone(timezone.utc).timestamp()) * 1000
                if at > after_ms:
                    return at
                m = _from(minute, m + 1)
            h = _from(hour, h + 1)
    return None


def next_cron(expr: Column, after_ms: Column, zone: Column) -> Column:
    """``next_time`` of columns; null of nulls."""

    @F.pandas_udf("long")
    def found(e: pd.Series, at: pd.Series, z: pd.Series) -> pd.Series:
        none = lambda x: x is None or x != x
        return pd.Series([None if none(x) or none(a) else next_time(x, int(a), "UTC" if none(t) else t) for x, a, t in zip(e, at, z)], dtype="Int64")

    return found(expr, after_ms, zone)
