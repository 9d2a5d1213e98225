"""Reads over the point catalog and the daily series of points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from acequia import schema as S
from acequia.functions import (
    date_text, false_if_null, lon_lat, round_half_even, round_or_null_if_zero, zero_if_null,
)
from acequia.operators.filters import PointFilter, coordinate_is, where
from acequia.operators.text_index import rows_with


def first_rows(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows in the order of all columns, so the choice is repeatable."""
    if n is None:
        return df
    return df.orderBy(*(F.col(c).asc_nulls_first() for c in df.columns)).limit(n)


def filtered(points: DataFrame, filters: PointFilter, index: DataFrame | None) -> DataFrame:
    """Catalog rows under the filters; with an index of texts, a code is searched there."""
    if index is None or filters.codigo_obra is None:
        return where(points, filters.conditions())
    return rows_with(where(points, filters.conditions(code=False)), index, "codigo", filters.codigo_obra)


def count_points(
    points: DataFrame, filters: PointFilter = PointFilter(), index: DataFrame | None = None
) -> DataFrame:
    """Catalog rows under the filters, with the filters echoed. Rows without coordinates count."""
    return (
        filtered(points, filters, index)
        .agg(F.count("*").alias("total_puntos_unicos"))
        .select("total_puntos_unicos", *filters.echo())
    )


def list_points(
    points: DataFrame,
    filters: PointFilter = PointFilter(),
    limit: int | None = S.DEFAULT_POINT_LIMIT,
    index: DataFrame | None = None,
) -> DataFrame:
    """Located points under the filters, at most ``limit`` of them."""
    located = points.where(F.col("UTM_Norte").isNotNull() & F.col("UTM_Este").isNotNull())
    found = filtered(located, filters, index).select(
        F.col("UTM_Norte").alias("utm_norte"),
        F.col("UTM_Este").alias("utm_este"),
        F.col("Huso").alias("huso"),
        false_if_null(F.col("es_pozo_subterraneo")).alias("es_pozo_subterraneo"),
        F.col("Cod_Subsubcuenca").alias("cod_subsubcuenca"),
        F.col("SECTOR_SHA").alias("sector_sha"),
        F.col("APR").cast("boolean").alias("apr"),
        F.col("ID_JUNTA").alias("id_junta"),
    )
    return first_rows(found, limit)


def point_info(points: DataFrame, norte: int, este: int) -> DataFrame:
    """Detail of one point: no row if unknown, the first one if several share the place."""
    found = where(points, coordinate_is(norte, este)).select(
        F.col("UTM_Norte").alias("utm_norte"),
        F.col("UTM_Este").alias("utm_este"),
        F.col("Huso").alias("huso"),
        false_if_null(F.col("es_pozo_subterraneo")).alias("es_pozo_subterraneo"),
        F.col("codigo"),
        F.col("Cod_Cuenca").alias("cod_cuenca"),
        F.col("Cod_Subcuenca").alias("cod_subcuenca"),
        F.col("Cod_Subsubcuenca").alias("cod_subsubcuenca"),
        F.col("Nom_Cuenca").alias("nombre_cuenca"),
        F.col("Nom_Subcuenca").alias("nombre_subcuenca"),
        F.col("Nom_Subsubcuenca").alias("nombre_subsubcuenca"),
        round_half_even(F.col("caudal_promedio")).alias("caudal_promedio"),
        zero_if_null(F.col("n_mediciones")).alias("n_mediciones"),
        F.col("SECTOR_SHA").alias("sector_sha"),
        F.col("APR").cast("boolean").alias("apr"),
        F.col("ID_JUNTA").alias("id_junta"),
        F.col("PARTE_JUNTA").cast("boolean").alias("parte_junta"),
        F.col("REPRESENTA_JUNTA").cast("boolean").alias("representa_junta"),
        F.col("CANAL_TRANSMISION").alias("canal_transmision"),
    )
    return first_rows(found, 1)


def point_metric_stats(series: DataFrame, norte: int, este: int) -> DataFrame:
    """Statistics of each metric of one point in one pass, a row per metric that has values."""
    per_metric = []
    for c in S.LEVELS:
        x, day = F.col(c), F.when(F.col(c).isNotNull(), F.col("FECHA_MEDICION"))
        per_metric.append(F.struct(
            F.lit(c.lower()).alias("metrica"),
            F.count(x).alias("total_registros"),
            F.avg(x).alias("promedio"),
            F.min(x).alias("minimo"),
            F.max(x).alias("maximo"),
            F.stddev_samp(x).alias("desviacion_estandar"),
            F.min(day).alias("primera_fecha"),
            F.max(day).alias("ultima_fecha"),
        ))
    return (
        where(series, coordinate_is(norte, este))
        .agg(F.array(*per_metric).alias("por_metrica"))
        .select(F.inline("por_metrica"))
        .filter(F.col("total_registros") > 0)
        .select(
            F.lit(norte).alias("utm_norte"), F.lit(este).alias("utm_este"),
            "metrica", "total_registros",
            *(round_or_null_if_zero(F.col(c)).alias(c)
              for c in ("promedio", "minimo", "maximo", "desviacion_estandar")),
            date_text(F.col("primera_fecha")).alias("primera_fecha"),
            date_text(F.col("ultima_fecha")).alias("ultima_fecha"),
        )
    )


def multi_point_flow_stats(series: DataFrame, locations: Sequence[tuple[int, int]]) -> DataFrame:
    """Pooled flow statistics of several points.

    A place listed twice counts twice as asked but its rows once. The places are the
    few that a caller names, so they become a constant set that each row is looked up
    in, with no join; their north values alone also prune row groups in the scan.
    """
    if not locations:
        raise ValueError("at least one location is needed")
    places = sorted({(int(n), int(e)) for n, e in locations})
    flow = F.col("CAUDAL")
    listed = F.struct("UTM_NORTE", "UTM_ESTE").isin(
        [F.struct(F.lit(n).alias("UTM_NORTE"), F.lit(e).alias("UTM_ESTE")) for n, e in places]
    )
    return (
        series.filter(flow.isNotNull() & F.col("UTM_NORTE").isin(sorted({n for n, _ in places})) & listed)
        .agg(
            F.count("*").alias("total_registros_con_caudal"),
            F.avg(flow).alias("caudal_promedio"),
            F.min(flow).alias("caudal_minimo"),
            F.max(flow).alias("caudal_maximo"),
            F.stddev_samp(flow).alias("desviacion_estandar_caudal"),
        )
        .select(
            F.lit(len(locations)).alias("puntos_consultados"),
            "total_registros_con_caudal",
            *(round_or_null_if_zero(F.col(c)).alias(c) for c in (
                "caudal_promedio", "caudal_minimo", "caudal_maximo", "desviacion_estandar_caudal")),
        )
    )


def pooled_flow_stats(series: DataFrame, locations: DataFrame) -> DataFrame:
    """As ``multi_point_flow_stats`` for a table of locations of any size.

    A semi join keeps the rows of the places asked, then one aggregate merges counts, means and squared
    deviations of all tasks, so the series is read once. The places come out wider than the series has
    them: both sides are then shuffled for this join alone, if at all, and adaptive execution
    may split a coordinate with very many rows.
    """
    flow = F.col("CAUDAL")
    asked = locations.agg(F.count(F.lit(1)).cast("int").alias("puntos_consultados"))
    places = locations.select("UTM_NORTE", "UTM_ESTE").distinct().select(
        F.col("UTM_NORTE").cast("long").alias("norte"), F.col("UTM_ESTE").cast("long").alias("este"))
    on = [F.col("UTM_NORTE").cast("long") == F.col("norte"), F.col("UTM_ESTE").cast("long") == F.col("este")]
    pooled = series.filter(flow.isNotNull()).join(places, on, "left_semi").agg(
        F.count(F.lit(1)).alias("total_registros_con_caudal"),
        F.avg(flow).alias("caudal_promedio"),
        F.min(flow).alias("caudal_minimo"),
        F.max(flow).alias("caudal_maximo"),
        F.stddev_samp(flow).alias("desviacion_estandar_caudal"),
    )
    return pooled.select(
        asked.scalar().alias("puntos_consultados"), "total_registros_con_caudal",
        *(round_or_null_if_zero(F.col(c)).alias(c) for c in (
            "caudal_promedio", "caudal_minimo", "caudal_maximo", "desviacion_estandar_caudal")),
    )


def is_valid_location(norte: int, este: int) -> bool:
    return 0 <= norte <= S.MAX_UTM_NORTE and 0 <= este <= S.MAX_UTM_ESTE


def mark_valid_locations(locations: DataFrame) -> DataFrame:
    """Locations with ``es_valida``: both coordinates known and within the grid."""
    valid = F.col("UTM_NORTE").between(0, S.MAX_UTM_NORTE) & F.col("UTM_ESTE").between(0, S.MAX_UTM_ESTE)
    return locations.withColumn("es_valida", F.coalesce(valid, F.lit(False)))


def admin_divisions(points: DataFrame) -> DataFrame:
    found = points.filter(F.col("Region").isNotNull()).select(
        F.col("Region").alias("region"),
        F.col("Provincia").alias("provincia"),
        F.col("Comuna").alias("comuna"),
    )
    return found.distinct().orderBy("region", "provincia", "comuna")


def distinct_regions(points: DataFrame) -> DataFrame:
    regions = points.select(F.col("Region").alias("region")).filter(F.col("region").isNotNull())
    return regions.distinct().orderBy("region")


def total_points(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("total_puntos_unicos"))


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("total_records"))


def points_lon_lat(points: DataFrame) -> DataFrame:
    lon, lat = lon_lat(F.col("UTM_Norte"), F.col("UTM_Este"))
    return points.select(
        F.col("UTM_Norte").alias("utm_norte"), F.col("UTM_Este").alias("utm_este"), "codigo",
        lon.alias("longitud"), lat.alias("latitud"),
    )
