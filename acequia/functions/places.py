"""Coordinate conversion and order in the plane."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the plane approximation.
METRES_PER_DEGREE = 111320
FALSE_NORTHING = 10_000_000
FALSE_EASTING = 500_000
CENTRAL_MERIDIAN = -69.0


def lon_lat(norte: Column, este: Column) -> tuple[Column, Column]:
    """Approximate longitude and latitude of UTM metres; both NULL if either input is."""
    known = norte.isNotNull() & este.isNotNull()
    lat = (norte - F.lit(FALSE_NORTHING)) / F.lit(METRES_PER_DEGREE)
    lon = F.lit(CENTRAL_MERIDIAN) + (este - F.lit(FALSE_EASTING)) / (
        F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat))
    )
    return F.when(known, lon), F.when(known, lat)


def _spread(x: Column) -> Column:
    """The low 32 bits of a whole number, each followed by a zero bit."""
    x = x.cast("long").bitwiseAND(0xFFFFFFFF)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(mask)
    return x


def interleaved(a: Column, b: Column) -> Column:
    """Place along a space-filling curve: the bits of both numbers in turn. NULL if either is."""
    return F.shiftleft(_spread(a), 1).bitwiseOR(_spread(b))
