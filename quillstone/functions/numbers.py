"""Rounding of exact binary values (SC90)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits.
SPLITTER = 134217729.0


def exact_round(x: Column, places: int) -> Column:
    """``x`` to decimal places by its exact binary value, a true half to the even digit.

    2.675 lies below 2.675 and gives 2.67, which neither ``round`` nor ``bround`` does: they read the shortest
    decimal form. The error of the scaled value is found from the halves of its factors, without a rounding of
    its own. Values too large for a fraction at these places, infinite ones, NaN and null are returned unchanged.
    """
    m = float(10**places)
    x = x.cast("double")
    scaled = x * m
    carried = x * SPLITTER
    high = carried - (carried - x)
    low = x - high
    m_high = m * SPLITTER - (m * SPLITTER - m)
    error = ((high * m_high - scaled) + high * (m - m_high) + low * m_high) + low * (m - m_high)
    floor = F.floor(scaled).cast("double")
    past = (scaled - floor) - 0.5
    up = F.when(past + error != 0, past + error > 0).otherwise(F.pmod(floor, F.lit(2.0)) == 1)
    rounded = (floor + F.when(up, 1.0).otherwise(0.0)) / m
    return F.when((F.abs(scaled) < 2.0**51) & ~F.isnan(x), rounded).otherwise(x)
