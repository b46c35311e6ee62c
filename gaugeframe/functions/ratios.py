"""Column expressions for ratios with guarded denominators (DER-04 to DER-07, DER-09)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null where the denominator is zero or a side is missing."""
    return F.try_divide(part, whole) * F.lit(100.0)


def percent_or_zero(part: Column, whole: Column) -> Column:
    """As ``percent`` with 0 for x/0, 0/0 and missing values."""
    return F.coalesce(percent(part, whole), F.lit(0.0))


def percent_above(part: Column, whole: Column, threshold: float) -> Column:
    """The ratio where ``whole`` reaches the threshold, 0 below it or where it is unknown."""
    return F.when(whole >= F.lit(float(threshold)), percent(part, whole)).otherwise(F.lit(0.0))


def clip_upper(value: Column, limit: float) -> Column:
    """Upper bound that keeps missing values missing (``least`` alone would return the bound)."""
    return F.when(value.isNotNull(), F.least(value, F.lit(float(limit))))


def share_of_maximum(value: Column, maximum: Column) -> Column:
    """value / maximum, with a maximum of 0 read as 1."""
    return value / F.when(maximum == 0, F.lit(1.0)).otherwise(maximum)
