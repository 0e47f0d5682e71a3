"""Rounding that agrees with exact decimal rounding of the stored binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_tenth(value: Column) -> Column:
    """A non-negative double to one decimal; an exact tie goes to the even digit.

    ``bround`` judges ties by the shortest decimal text, so 72.35, stored slightly below, would go up. Here the sign
    of ``20 * value - odd`` decides. Near a tie both subtractions are free of rounding, so the sign is exact.
    """
    tenths = F.floor(value * 10).cast("double")
    above = (value * 16 - (tenths * 2 + 1)) + value * 4
    up = (above > 0) | ((above == 0) & (tenths % 2 == 1))
    return (tenths + F.when(up, F.lit(1.0)).otherwise(F.lit(0.0))) / 10


def round_whole(value: Column) -> Column:
    """To the nearest whole number, ties to even."""
    return F.rint(value).cast("int")
