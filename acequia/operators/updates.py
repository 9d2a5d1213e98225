"""Adding columns to a stored table and filling them from an aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType

from acequia.operators.filters import where


def with_missing_columns(df: DataFrame, columns: dict[str, DataType]) -> DataFrame:
    """Add every column that is not there yet, as NULL. Names compare without case."""
    present = {c.lower() for c in df.columns}
    return df.withColumns(
        {n: F.lit(None).cast(t) for n, t in columns.items() if n.lower() not in present}
    )


def update_from(
    target: DataFrame,
    source: DataFrame,
    on: dict[str, str],
    columns: Sequence[str],
) -> DataFrame:
    """Target rows with ``columns`` taken from the matching source row.

    Rows without a match keep their values. A key that ``source`` holds twice fails the
    query, so no target row is repeated. Keys compare with ``=``, so a NULL key matches
    nothing. Where ``source`` is an aggregate by these keys, the check moves no rows.
    """
    t = target.alias("t")
    keys = [F.col(b).alias(f"clave_{i}") for i, b in enumerate(on.values())]
    known = [F.col(b).isNotNull() for b in on.values()]
    s = where(source, known).groupBy(*keys).agg(
        *(F.any_value(c).alias(f"nuevo_{c}") for c in columns), F.count(F.lit(1)).alias("filas"),
    ).withColumn(
        "coincide", F.when(F.col("filas") == 1, True).otherwise(F.raise_error("the source repeats a key"))
    ).alias("s")
    match = [F.col(f"t.{a}") == F.col(f"s.clave_{i}") for i, a in enumerate(on)]
    taken = {c.lower(): c for c in columns}
    return t.join(s, match, "left").select(
        *(
            F.when(F.col("s.coincide"), F.col(f"s.nuevo_{taken[c.lower()]}"))
            .otherwise(F.col(f"t.{c}")).alias(c)
            if c.lower() in taken else F.col(f"t.{c}")
            for c in target.columns
        )
    )
