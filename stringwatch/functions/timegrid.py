"""Grid snapping, local time and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def micros(time: Column | str) -> Column:
    return F.unix_micros(F.col(time) if isinstance(time, str) else time)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / MICROS_PER_MINUTE


def shift_minutes(time: Column, minutes: Column | int) -> Column:
    amount = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return F.timestamp_micros(F.unix_micros(time) + (amount * MICROS_PER_MINUTE).cast("long"))


def floor_minutes(time: Column, minutes: int) -> Column:
    step = minutes * MICROS_PER_MINUTE
    value = F.unix_micros(time)
    return F.timestamp_micros(value - F.pmod(value, F.lit(step)))


def ceil_minutes(time: Column, minutes: int) -> Column:
    step = minutes * MICROS_PER_MINUTE
    value = F.unix_micros(time)
    return F.timestamp_micros(value + F.pmod(-value, F.lit(step)))


def grid(start: Column, end: Column, minutes: int) -> Column:
    """Grid times inside [start, end]; null when there is none."""
    step = minutes * MICROS_PER_MINUTE
    first = F.unix_micros(ceil_minutes(start, minutes))
    last = F.unix_micros(floor_minutes(end, minutes))
    return F.when(
        first <= last,
        F.transform(F.sequence(first, last, F.lit(step)), F.timestamp_micros),
    )


def local_time(time: Column | str, timezone: str) -> Column:
    return F.from_utc_timestamp(F.col(time) if isinstance(time, str) else time, timezone)


def local_date(time: Column | str, timezone: str) -> Column:
    return F.to_date(local_time(time, timezone))


def local_text(time: Column | str, timezone: str) -> Column:
    return F.date_format(local_time(time, timezone), "yyyy-MM-dd HH:mm:ss")


def utc_bound(text: str, timezone: str) -> Column:
    """A bound given as local date or time, or with its own offset, in UTC."""
    tail = text.strip()[10:]
    if tail.endswith("Z") or "+" in tail or "-" in tail:
        return F.to_timestamp(F.lit(text))
    return F.to_utc_timestamp(F.lit(text).cast("timestamp_ntz").cast("timestamp"), timezone)
