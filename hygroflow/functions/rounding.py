"""Decimal rounding of binary numbers, half to even.

``round`` and ``bround`` round the shortest decimal text of a double.  Scripts
round its exact value, array libraries round the scaled value; on a tie in the
text the three differ by one unit.  Both are plain column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1 cuts a double into two halves of 26 bits


def round_scaled(value: Column, digits: int) -> Column:
    """Scale, round to a whole number, scale back."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def round_exact(value: Column, digits: int) -> Column:
    """Round the exact binary value.

    The scaled value is off by less than half a unit in the last place, which
    matters only if it looks like a tie; then the exact error of the product
    (from a split of the factor) tells on which side the value lies.
    """
    scale = F.lit(float(10**digits))
    product = value * scale
    spread = value * _SPLIT
    high = spread - (spread - value)
    error = (high * scale - product) + (value - high) * scale
    below = F.floor(product).cast("double")
    tie = (product - below) == 0.5
    whole = (
        F.when(tie & (error > 0), below + 1).when(tie & (error < 0), below).otherwise(F.rint(product))
    )
    return whole / scale
