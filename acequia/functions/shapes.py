"""Flags, labels, coordinates and the twelve-month map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from acequia.schema import COORD, MONTHS, RIGHT_TYPE_LABELS, UNKNOWN_LABEL


def coordinate() -> Column:
    """One value per (north, east), with NULL as a value of its own.

    Counting distinct structs counts rows without coordinates as one more point,
    which is what counting the joined text with NULL as '' does.
    """
    return F.struct(*COORD)


def false_if_null(flag: Column) -> Column:
    return F.coalesce(flag.cast("boolean"), F.lit(False))


def right_type_label(right_type: Column) -> Column:
    label = F.lit(UNKNOWN_LABEL)
    for code, text in RIGHT_TYPE_LABELS.items():
        label = F.when(right_type == code, F.lit(text)).otherwise(label)
    return label


def month_map(columns: Sequence[str]) -> Column:
    """Map month name -> value from twelve columns in month order."""
    return F.map_from_arrays(F.array(*map(F.lit, MONTHS)), F.array(*columns))
