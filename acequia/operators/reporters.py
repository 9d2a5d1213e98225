"""Reads over reporters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from acequia import schema as S
from acequia.functions import full_name, timestamp_text, zero_if_null
from acequia.operators.filters import equal_to, where
from acequia.operators.points import first_rows


def list_reporters(
    reporters: DataFrame,
    utm_norte: int | None = None,
    utm_este: int | None = None,
    cod_cuenca: int | None = None,
    cod_subcuenca: int | None = None,
    cod_subsubcuenca: int | None = None,
    limit: int | None = S.DEFAULT_REPORTER_LIMIT,
) -> DataFrame:
    """Reporters under the filters, at most ``limit`` rows."""
    given = {
        "UTM_NORTE": utm_norte, "UTM_ESTE": utm_este, "COD_CUENCA": cod_cuenca,
        "COD_SUBCUENCA": cod_subcuenca, "COD_SUBSUBCUENCA": cod_subsubcuenca,
    }
    found = where(reporters, equal_to(given)).select(
        full_name(F.col("NOMB_INF"), F.col("A_PAT_INF"), F.col("A_MAT_INF")).alias("nombre_completo"),
        zero_if_null(F.col("CANTIDAD_REPORTES")).alias("cantidad_reportes"),
        timestamp_text(F.col("ULTIMA_FECHA_MEDICION")).alias("ultima_fecha_medicion"),
    )
    return first_rows(found, limit)


def reporter_names(reporters: DataFrame) -> DataFrame:
    """Every distinct combination of name parts with the full name made of it."""
    parts = ("NOMB_INF", "A_PAT_INF", "A_MAT_INF")
    return reporters.select(*parts).distinct().select(
        *parts, full_name(*map(F.col, parts)).alias("nombre_completo")
    )
