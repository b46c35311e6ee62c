"""Calendar periods as dates of their last day (TS-01 to TS-03)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days or months between the ends of neighbouring periods.
PERIOD_STEP = {"D": ("day", 1), "W": ("day", 7), "M": ("month", 1), "Q": ("month", 3), "Y": ("month", 12)}


def period_end(date: Column, rule: str) -> Column:
    """Last day of the period holding ``date``: day, week to Sunday, month, quarter or year."""
    day = date.cast("date")
    if rule == "D":
        return day
    if rule == "W":
        return F.next_day(F.date_sub(day, 1), "Sunday")
    if rule == "M":
        return F.last_day(day)
    if rule == "Q":
        return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))
    if rule == "Y":
        return F.make_date(F.year(day), F.lit(12), F.lit(31))
    raise ValueError(f"unknown period rule {rule!r}, use one of {', '.join(PERIOD_STEP)}")


def shift_period(end: Column, rule: str, count: Column) -> Column:
    """The period end ``count`` periods later."""
    unit, size = PERIOD_STEP[rule]
    steps = (count * F.lit(size)).cast("int")
    return F.date_add(end, steps) if unit == "day" else F.last_day(F.add_months(end, steps))


def periods_between(first: Column, last: Column, rule: str) -> Column:
    """How many periods ``last`` lies after ``first``, both being period ends."""
    unit, size = PERIOD_STEP[rule]
    if unit == "day":
        distance = F.date_diff(last, first)
    else:
        distance = (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)
    return F.floor(distance / F.lit(size)).cast("int")
