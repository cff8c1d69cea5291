"""Time buckets and other scalar functions as Column expressions.

Buckets are exact: integer microseconds, floored, so instants before the origin fall into
the bucket that holds them.  Day-and-shorter widths count from Monday 2000-01-03, month
widths from 2000-01-01.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
MONTHS = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200}
#: Microseconds of 2000-01-03, the first Monday of 2000.
MONDAY = 946_857_600_000_000
#: Months from year 0 to 2000-01.
MONTH_ORIGIN = 2000 * 12
_SHORT = {"us": "microsecond", "ms": "millisecond", "s": "second", "sec": "second", "m": "minute", "min": "minute", "h": "hour", "hr": "hour", "d": "day", "w": "week", "mon": "month", "y": "year", "yr": "year"}


def parse_width(width: str) -> tuple[int, int]:
    """A width such as '90 minutes' or '1 month' as (months, microseconds); one of them is 0."""
    parts = re.findall(r"(\d+)\s*([A-Za-z]+)", width)
    if not parts or re.sub(r"(\d+)\s*([A-Za-z]+)", "", width).strip():
        raise ValueError(f"not a bucket width: {width!r}")
    months = micros = 0
    for n, unit in parts:
        unit = unit.lower()
        unit = _SHORT.get(unit, unit)
        unit = unit[:-1] if unit.endswith("s") and unit[:-1] in MICROS | MONTHS else {"centuries": "century"}.get(unit, unit)
        if unit in MICROS:
            micros += int(n) * MICROS[unit]
        elif unit in MONTHS:
            months += int(n) * MONTHS[unit]
        else:
            raise ValueError(f"unknown unit {unit!r} in {width!r}")
    if bool(months) == bool(micros):
        raise ValueError(f"a width is either months or a fixed time, and positive: {width!r}")
    return months, micros


def micros_of(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_bucket(width: str, ts: Column | str, origin: Column | str | None = None) -> Column:
    """Start of the bucket that holds ``ts``, as a zone-less timestamp."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    origin = F.lit(origin).cast("timestamp_ntz") if isinstance(origin, str) else origin
    months, micros = parse_width(width)
    if micros:
        at = micros_of(ts)
        zero = micros_of(origin) if origin is not None else F.lit(MONDAY)
        return F.timestamp_micros(at - F.pmod(at - zero, F.lit(micros))).cast("timestamp_ntz")
    number = lambda t: F.year(t) * 12 + F.month(t) - 1
    zero = number(origin) if origin is not None else F.lit(MONTH_ORIGIN)
    month = number(ts) - F.pmod(number(ts) - zero, F.lit(months))
    start = F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))
    return start.cast("timestamp_ntz")


def epoch_bucket_rounded(width: str, ts: Column | str) -> Column:
    """Compatibility: the bucket of the *rounded* second, counted from 1970 and truncated.

    Differs from ``time_bucket`` in the last half second of a bucket, before 1970 and for
    widths that do not divide the time from 1970 to the native origin.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    _, micros = parse_width(width)
    seconds = micros // 1_000_000
    if not seconds or micros % 1_000_000:
        raise ValueError("whole seconds only")
    whole = F.rint(micros_of(ts) / 1e6).cast("bigint")
    return F.timestamp_seconds(whole - whole % seconds).cast("timestamp_ntz")


def epoch(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return micros_of(ts) / F.lit(1e6)


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970, rounded."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    up = micros_of(ts) + 500
    return ((up - F.pmod(up, F.lit(1000))) / 1000).cast("bigint")


def round_half_even(x: Column) -> Column:
    """Double to integer as SQL engines with banker's rounding cast it."""
    return F.rint(x).cast("bigint")


def url_host(url: Column | str) -> Column:
    """Host of an http(s) URL without a leading www., '' if it is none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(url, r"^https?://(?:www\.)?([^/]+)", 1)
