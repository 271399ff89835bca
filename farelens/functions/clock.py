"""Calendar and elapsed-time columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from farelens.functions.missing import flag

_DAY = 86400.0


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def parsed(text: Column) -> Column:
    """Text to timestamp; unreadable text becomes null."""
    return F.try_to_timestamp(text)


def hour_of(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(0))


def weekday_of(ts: Column) -> Column:
    """Monday is 0."""
    return F.coalesce(F.weekday(ts), F.lit(0))


def month_day_of(ts: Column) -> Column:
    return F.coalesce(F.dayofmonth(ts), F.lit(15))


def whole_days(start: Column, end: Column) -> Column:
    """Elapsed whole days, rounded down (also for a negative span)."""
    return F.floor(seconds_between(start, end) / F.lit(_DAY)).cast("double")


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def is_morning_peak(hour: Column) -> Column:
    return flag(hour.between(7, 9))


def is_evening_peak(hour: Column) -> Column:
    return flag(hour.between(17, 20))


def is_peak(hour: Column) -> Column:
    return flag(hour.between(7, 9) | hour.between(17, 20))


def is_night(hour: Column) -> Column:
    return flag((hour < 6) | (hour >= 22))


def order_epoch(raw: Column, now: Column | None = None) -> Column:
    """Order time as Unix seconds: a number is rounded down, a readable date is
    converted, anything else (or nothing) is the current time."""
    now = F.unix_timestamp() if now is None else now
    number = F.floor(raw.try_cast("double"))
    return F.coalesce(number, F.unix_timestamp(F.try_to_timestamp(raw)), now)
