"""Rounding to the places of a contract."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(value: Column, places: int) -> Column:
    """The nearest number of so many places; of two equally near, the one with the even last digit.

    A double is brought to decimal by its shortest digits first, as it is
    written, so that 0.125 is a tie and 2.675 is not less than it looks.
    """
    exact = value.cast("string").try_cast("decimal(38,18)")
    return F.when(exact.isNotNull(), F.bround(exact, places).cast("double")).otherwise(F.bround(value.cast("double"), places))
