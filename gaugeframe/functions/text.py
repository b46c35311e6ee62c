"""Numbers as short display text (DER-12 to DER-15).

The display rule rounds the binary value of the double, with exact ties to the even digit;
Java's formatter rounds the shortest decimal text half up (1.005 gives 1.01 instead of 1.00).
``_rounded`` therefore finds the rounding side itself, in double arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two doubles of at most 26 bits each."""
    scaled = x * F.lit(134217729.0)  # 2**27 + 1
    high = scaled - (scaled - x)
    return high, x - high


def _rounded(x: Column, decimals: int) -> Column:
    """``x`` rounded to ``decimals`` from its exact binary value."""
    factor = float(10**decimals)
    product = x * F.lit(factor)
    high, low = _halves(x)
    # The factor has few bits, so high*factor is exact and this is the product's rounding error.
    error = (high * F.lit(factor) - product) + low * F.lit(factor)
    whole = F.abs(product) >= F.lit(2.0**52)  # no fraction, and beyond what floor can count
    floor = F.floor(F.when(whole, F.lit(0.0)).otherwise(product)).cast("double")
    beyond_half = (product - floor - F.lit(0.5)) + error
    up = (beyond_half > 0) | ((beyond_half == 0) & (floor % F.lit(2.0) != 0))
    return F.when(whole, x).otherwise(F.when(up, floor + F.lit(1.0)).otherwise(floor) / F.lit(factor))


def fixed_text(x: Column, decimals: int, suffix: str = "") -> Column:
    """Text with a fixed number of decimals; missing values (NaN as well) stay missing, infinities read inf."""
    x = x.cast("double")
    finite = F.abs(x) < F.lit(float("inf"))
    # Beyond 2**52 a double is a whole number; its decimal form has all digits.
    large = F.concat(F.format_string("%.0f", x), F.lit("." + "0" * decimals if decimals else ""))
    shown = F.when(F.abs(x) >= F.lit(2.0**52), large).otherwise(F.format_string(f"%.{decimals}f", _rounded(x, decimals)))
    text = F.when(finite, shown).when(x > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    return F.when(x.isNotNull() & ~F.isnan(x), F.concat(text, F.lit(suffix)))


def plain_text(x: Column) -> Column:
    """A number as text as it is, without an exponent where it is small."""
    value = x.cast("double")
    small = F.regexp_replace(F.format_string("%.20f", value), "0+$", "")
    return F.when((F.abs(value) < 1e-3) & (value != 0), small).otherwise(x.cast("string"))


def big_number_text(x: Column, decimals: int = 2, below: str = "unchanged") -> Column:
    """B / M / K text. Below 1000: ``unchanged``, ``truncated`` to an integer or ``rounded``."""
    small = {
        "unchanged": plain_text(x),
        "truncated": F.when(F.abs(x) < 1e18, x).cast("bigint").cast("string"),
        "rounded": fixed_text(x, 0),
    }[below]
    value = x.cast("double")
    return (
        F.when(F.isnan(value), F.lit(None))
        .when(value == float("-inf"), F.lit("-inf"))
        .when(value >= 1e9, fixed_text(value / 1e9, decimals, " B"))
        .when(value >= 1e6, fixed_text(value / 1e6, decimals, " M"))
        .when(value >= 1e3, fixed_text(value / 1e3, decimals, " K"))
        .otherwise(small)
    )


def percent_text(x: Column, decimals: int = 2) -> Column:
    """Percent text, ``N/A`` for a missing value."""
    return F.coalesce(fixed_text(x, decimals, "%"), F.lit("N/A"))
