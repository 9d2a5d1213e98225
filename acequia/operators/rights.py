"""Reads over water rights of points and basins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from acequia import schema as S
from acequia.functions import month_map, right_type_label, zero_if_null
from acequia.operators.filters import coordinate_is, equal_to, where
from acequia.operators.points import first_rows


def point_rights(points: DataFrame, norte: int, este: int) -> DataFrame:
    """The right of one point with its twelve monthly flows; no row if it has none."""
    stated = where(points, [*coordinate_is(norte, este), F.col("TIPO_DERECHO").isNotNull()])
    first = first_rows(stated.select(*S.RIGHTS), 1)
    return first.select(
        F.col("TIPO_DERECHO").alias("tipo_derecho"),
        right_type_label(F.col("TIPO_DERECHO")).alias("tipo_derecho_label"),
        F.col("VOLUMEN_ANUAL").alias("volumen_anual"),
        *(F.col(c).alias(c.lower()) for c in S.MONTHLY_FLOWS),
    )


def basin_rights(stats: DataFrame, cod_cuenca: int, cod_subcuenca: int | None = None) -> DataFrame:
    """Rights summed over the paths of a basin or sub-basin: always one row.

    All figures are 0 when no point has a right, and NULL when the basin is unknown.
    """
    rows = where(stats, equal_to({"Cod_Cuenca": cod_cuenca, "Cod_Subcuenca": cod_subcuenca}))
    sums = rows.agg(*(F.sum(zero_if_null(F.col(c))).alias(c) for c in S.BASIN_RIGHTS))
    none = F.col("puntos_con_derechos") == 0
    return sums.select(
        "puntos_con_derechos",
        *(F.when(none, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in S.BASIN_RIGHT_SUMS),
    )


def with_month_map(rights: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Fold twelve monthly columns into one map from month name to value."""
    kept = [c for c in rights.columns if c not in columns]
    return rights.select(*kept, month_map(columns).alias(name))


def by_month(rights: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per month (number, name, flow) from twelve monthly columns."""
    months = F.array(*(
        F.struct(F.lit(i).alias("n_mes"), F.lit(m).alias("mes"), F.col(c).alias("caudal"))
        for i, (m, c) in enumerate(zip(S.MONTHS, columns), start=1)
    ))
    return rights.select(F.inline(months))
