"""Rounding and zero/NULL rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# 2**27 + 1 splits a double into two 26-bit halves whose products are exact.
_SPLIT = 134217729.0
# From here on a double has no digits left that rounding to cents could change.
_LARGE = 4.5e13


def round_half_even(x: Column, decimals: int = 2) -> Column:
    """Round the exact binary value, ties to even; NULL stays NULL.

    ``bround`` rounds the shortest decimal text of a double, so it takes 2.675
    (stored as 2.67499…) for a tie. Here the error of ``x * 10**decimals`` is
    computed exactly and decides on which side of a seeming tie the value lies.
    """
    if not 0 <= decimals <= 10:
        raise ValueError("decimals must lie between 0 and 10")
    scale = F.lit(10.0**decimals)
    scaled = x * scale
    spread = x * F.lit(_SPLIT)
    high = spread - (spread - x)
    error = (high * scale - scaled) + (x - high) * scale
    nearest = F.rint(scaled)
    seems_tie = F.abs(scaled - nearest) == F.lit(0.5)
    decided = F.when(seems_tie & (error != 0), scaled + F.signum(error) * F.lit(0.5)).otherwise(nearest)
    # NaN compares as larger than any number, so it passes through as well.
    return F.when(F.abs(x) >= F.lit(_LARGE), x).otherwise(decided / scale)


def round_or_null_if_zero(x: Column, decimals: int = 2) -> Column:
    """Rounded value, but NULL for exactly 0 (point statistics report no zero)."""
    return F.when(x != 0, round_half_even(x, decimals))


def zero_if_null(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))
