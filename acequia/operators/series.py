"""Time series by basin, sub-basin, sub-sub-basin, aquifer sector or point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from acequia.functions import date_text
from acequia.operators.filters import code_or_name, coordinate_is, date_range, where

# Level -> columns that hold its code and its name. A sector is an attribute of the
# point catalog, the others of the series itself.
AREAS = {
    "cuenca": ("COD_CUENCA", "NOM_CUENCA"),
    "subcuenca": ("COD_SUBCUENCA", "NOM_SUBCUENCA"),
    "subsubcuenca": ("COD_SUBSUBCUENCA", "NOM_SUBSUBCUENCA"),
    "shac": ("COD_SECTOR_SHA", "SECTOR_SHA"),
}
# Metric -> its column and the name under which a series reports it.
METRICS = {
    "caudal": ("CAUDAL", "caudal"),
    "altura_linimetrica": ("ALTURA_LIMNIMETRICA", "altura_linimetrica"),
    "nivel_freatico": ("NIVEL_FREATICO", "nivel_freatico"),
}
_DAY = "FECHA_MEDICION"


def catalog_rows_per_coord(points: DataFrame, conditions: list[Column]) -> DataFrame:
    """How many catalog rows under the conditions share each coordinate.

    The coordinates come out wider than they went in, so the join on them does not take
    over the aggregate's partitioning: both its sides are shuffled for the join alone,
    and adaptive execution may then split a coordinate with very many series rows.
    """
    listed = (
        where(points, conditions)
        .groupBy(F.col("UTM_Norte").alias("norte"), F.col("UTM_Este").alias("este"))
        .agg(F.count("*").alias("filas"))
    )
    return listed.select(F.col("norte").cast("long").alias("norte"), F.col("este").cast("long").alias("este"), "filas")


def area_series(
    series: DataFrame,
    points: DataFrame | None,
    level: str,
    metric: str,
    identifier: str,
    start: str | None = None,
    end: str | None = None,
    well: bool | None = None,
    collation: str | None = None,
) -> DataFrame:
    """Daily values of an area, newest first; no row when nothing matches.

    Sectors and the well flag belong to the point catalog, which may list one
    coordinate several times; each listing then counts the series row once. Instead
    of repeating series rows in a join with the catalog, the catalog is reduced to
    one row per coordinate with its number of listings, and that number weighs the
    series row. The join is left out when neither is asked for.
    """
    value, label = METRICS[metric]
    picked = code_or_name(identifier, *AREAS[level], collation)
    in_catalog = [picked] if level == "shac" else []
    if well is not None:
        in_catalog.append(F.col("es_pozo_subterraneo") == F.lit(well))
    in_series = [F.col(value).isNotNull(), *date_range(series, start, end)]
    if level != "shac":
        in_series.append(picked)

    rows = where(series, in_series)
    if in_catalog:
        listed = catalog_rows_per_coord(points, in_catalog)
        rows = rows.join(
            listed, [F.col("UTM_NORTE").cast("long") == F.col("norte"), F.col("UTM_ESTE").cast("long") == F.col("este")]
        )
        weight = F.col("filas")
        total = F.sum(F.col(value) * weight)
        average = total / F.sum(weight)
        meter = F.sum(F.col("TOTALIZADOR") * weight)
    else:
        total, average = F.sum(value), F.avg(value)
        meter = F.sum("TOTALIZADOR")

    aggregates = [average.alias(label)]
    columns = [F.col(label)]
    if metric == "caudal":
        aggregates += [
            total.alias("caudal_sumado"),
            meter.alias("totalizador_sumado"),
            F.max("TOTALIZADOR").alias("totalizador_max"),
        ]
        columns += [F.col(label).alias("caudal_promedio"), F.col("caudal_sumado"),
                    F.col("totalizador_sumado"), F.col("totalizador_max")]
    return (
        rows.groupBy(_DAY).agg(*aggregates)
        .orderBy(F.col(_DAY).desc_nulls_last())
        .select(date_text(F.col(_DAY)).alias("fecha_medicion"), *columns)
    )


def _point_rows(
    series: DataFrame, metric: str, norte: int, este: int, start: str | None, end: str | None
) -> DataFrame:
    measured = F.col(METRICS[metric][0]).isNotNull()
    return where(series, [*coordinate_is(norte, este), measured, *date_range(series, start, end)])


def point_series(
    series: DataFrame,
    metric: str,
    norte: int,
    este: int,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Daily values of one coordinate as stored, newest first."""
    value, label = METRICS[metric]
    columns = [F.col(value).alias(label)]
    if metric == "caudal":
        columns += [
            F.col(value).alias("caudal_promedio"),
            F.col(value).alias("caudal_sumado"),
            F.col("TOTALIZADOR").alias("totalizador_sumado"),
            F.col("TOTALIZADOR").alias("totalizador_max"),
        ]
    return (
        _point_rows(series, metric, norte, este, start, end)
        .orderBy(F.col(_DAY).desc_nulls_last())
        .select(date_text(F.col(_DAY)).alias("fecha_medicion"), *columns)
    )


def point_series_count(
    series: DataFrame,
    metric: str,
    norte: int,
    este: int,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    return _point_rows(series, metric, norte, este, start, end).agg(F.count("*").alias("total"))
