"""Rounding judged on a number's binary value, the way printed reports round."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _split(value: Column, scale: int) -> tuple[Column, Column, Column]:
    """Whole part, scaled fraction cut to a whole number, and how far the cut part lies from one half.

    The fraction is held in units of 2^-53; what a number below one half has beyond that joins the distance.
    """
    whole = F.floor(value)
    exact = (value - whole) * F.lit(float(2**53))
    units = exact.cast("bigint")
    part = units * F.lit(scale)
    beyond = (exact - units) * F.lit(float(scale))
    from_half = (part % F.lit(2**53) - F.lit(2**52)).cast("double") + beyond
    return whole, F.call_function("div", part, F.lit(2**53)), from_half


def round_thousandths(value: Column) -> Column:
    """Three decimals, exact ties to the even digit."""
    whole, kept, from_half = _split(value, 1000)
    up = F.when(from_half > 0, F.lit(1)).when(from_half == 0, kept % 2).otherwise(F.lit(0))
    return (whole * 1000 + kept + up) / F.lit(1000.0)


def one_decimal(value: Column) -> Column:
    """Text with one decimal, exact ties upwards."""
    whole, kept, from_half = _split(value, 10)
    tenths = whole * 10 + kept + F.when(from_half >= 0, F.lit(1)).otherwise(F.lit(0))
    return F.concat(F.call_function("div", tenths, F.lit(10).cast("bigint")), F.lit("."), tenths % 10)
