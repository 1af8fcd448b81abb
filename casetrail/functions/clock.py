"""Time arithmetic as Column expressions (no Python UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def micros(ts: Column) -> Column:
    """Whole microseconds since the epoch."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds as a double, sub-second part kept."""
    return (micros(end) - micros(start)) / F.lit(float(MICROS))


def floor_units(ts: Column, width_seconds: int) -> Column:
    """Index of the ``width_seconds`` wide bucket a timestamp falls in (floors towards minus infinity)."""
    step = F.lit(width_seconds * MICROS)
    value = micros(ts)
    return ((value - F.pmod(value, step)) / step).cast("long")


def boundaries(unit: str, start: Column, end: Column) -> Column:
    """Count of calendar boundaries crossed: 00:00:59 to 00:01:01 is one minute although two seconds passed."""
    unit = unit.lower()
    if unit == "year":
        return (F.year(end) - F.year(start)).cast("long")
    if unit == "month":
        return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)).cast("long")
    width = UNIT_SECONDS[unit]
    return floor_units(end, width) - floor_units(start, width)


def shift(ts: Column, unit: str, amount: int) -> Column:
    """DATEADD: months and years keep the day of month (clipped), the others are fixed lengths."""
    unit = unit.lower()
    if unit in ("month", "year"):
        months = amount * (12 if unit == "year" else 1)
        moved = F.add_months(F.to_date(ts), months)
        of_day = micros(ts) - micros(F.to_date(ts).cast("timestamp"))
        return F.timestamp_micros(micros(moved.cast("timestamp")) + of_day)
    return F.timestamp_micros(micros(ts) + F.lit(amount * UNIT_SECONDS[unit] * MICROS))


def age_years(birth: Column, at: Column, precision: int = 5) -> Column:
    """Age in days / 365.25 as a two-decimal number."""
    return (F.datediff(at, birth) / F.lit(365.25)).cast(f"decimal({precision},2)")


def calendar(ts: Column, fallback: Column | None = None) -> tuple[Column, Column, Column]:
    """(year, day name, weekend flag); weekend is Saturday or Sunday."""
    when = ts if fallback is None else F.coalesce(ts, fallback)
    name = F.date_format(when, "EEEE")
    return F.year(when), name, F.dayofweek(when).isin(1, 7).cast("int")


def day_cycle(hours: Column) -> tuple[Column, Column]:
    """Sine and cosine of the hour on the 24 h circle."""
    angle = hours * F.lit(2 * math.pi / 24.0)
    return F.sin(angle), F.cos(angle)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def elapsed_bucket(minutes: Column) -> Column:
    """1..6 for elapsed minutes below 60, 240, 720, 1440, 2880 and above; missing falls in the first."""
    bucket = F.lit(1)
    for position, edge in enumerate((60, 240, 720, 1440, 2880), start=2):
        bucket = F.when(minutes >= edge, F.lit(position)).otherwise(bucket)
    return bucket


def years_of_experience(started: Column, reference: str = "2023-01-01") -> Column:
    """Years between a start date and a fixed reference date, limited to 0..60, 0 when unknown."""
    years = F.datediff(F.to_date(F.lit(reference)), F.to_date(started)) / F.lit(365.25)
    return F.coalesce(F.least(F.greatest(years, F.lit(0.0)), F.lit(60.0)), F.lit(0.0))
