"""How the ingest formats read instants; all give microseconds since 1970, UTC."""

from __future__ import annotations

import datetime as dt
import re

#: Factors to and from microseconds. Fixed values.
PER_SECOND = {"s": 1, "ms": 1_000, "us": 1_000_000, "ns": 1_000_000_000}
#: From these absolute magnitudes on an integer is in the next finer unit. Fixed values.
COLUMN_LIMITS = ((10**10, "s"), (10**13, "ms"), (10**16, "us"))
MESSAGE_LIMITS = ((10**12, "s"), (10**15, "ms"), (10**18, "us"))


def to_micros(value: int, unit: str) -> int:
    """Whole microseconds; nanoseconds are cut toward zero."""
    if unit == "ns":
        return value // 1000 if value >= 0 else -(-value // 1000)
    return value * (1_000_000 // PER_SECOND[unit])


def unit_of(value: float, limits=COLUMN_LIMITS, signed: bool = True) -> str:
    """Unit by magnitude; ``signed`` takes every negative number for seconds."""
    size = value if signed else abs(value)
    return next((unit for limit, unit in limits if size < limit), "ns")


def message_unit(value: float) -> str:
    return next((unit for limit, unit in MESSAGE_LIMITS if value <= limit), "ns")


_FORMS = ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y-%m-%d")
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def parse_text(text: str) -> int | None:
    """An ISO instant with or without fraction and zone, or a date; None if it is neither."""
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?)?)(\.\d+)?\s*(Z|[+-]\d\d:?\d\d)?", text.strip())
    if not m:
        return None
    for form in _FORMS:
        try:
            at = dt.datetime.strptime(m[1], form)
        except ValueError:
            continue
        shift = 0
        if m[3] and m[3] != "Z":
            z = m[3].replace(":", "")
            shift = (int(z[1:3]) * 60 + int(z[3:5])) * (60 if z[0] == "+" else -60)
        fraction = int((m[2] or ".0")[1:7].ljust(6, "0"))
        return ((at.replace(tzinfo=dt.timezone.utc) - _EPOCH) // dt.timedelta(seconds=1) - shift) * 1_000_000 + fraction
    return None


def any_micros(value, unit: str = "auto") -> int | None:
    """An import cell: explicit ``epoch_*`` unit, or by magnitude, or text."""
    if value is None or value == "":
        return None
    text = str(value).strip()
    if re.fullmatch(r"[+-]?\d+", text):
        n = int(text)
        return to_micros(n, unit.removeprefix("epoch_") if unit.startswith("epoch_") else unit_of(n, signed=False))
    if re.fullmatch(r"[+-]?\d*\.\d+(?:[eE][+-]?\d+)?", text):
        x = float(text)
        unit = unit.removeprefix("epoch_") if unit.startswith("epoch_") else unit_of(x, signed=False)
        return int(x * 1_000_000 / PER_SECOND[unit])
    return parse_text(text)
