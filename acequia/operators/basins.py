"""Reads over basins, aquifer sectors, boards and filter ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from acequia.functions import round_half_even
from acequia.operators.filters import equal_to, where

# Order of the levels of the filter ranges.
FILTER_LEVELS = {"global": 1, "cuenca": 2, "subcuenca": 3}


def list_basins(catalog: DataFrame) -> DataFrame:
    return catalog.select(*(F.col(c).alias(c.lower()) for c in catalog.columns)).orderBy(
        "cod_cuenca", "cod_subcuenca", "cod_subsubcuenca"
    )


def list_sectors(
    points: DataFrame,
    region: int | None = None,
    cod_cuenca: int | None = None,
    cod_subcuenca: int | None = None,
) -> DataFrame:
    """Aquifer sectors with the number of catalog rows in each."""
    given = {"Region": region, "Cod_Cuenca": cod_cuenca, "Cod_Subcuenca": cod_subcuenca}
    return (
        where(points, [F.col("COD_SECTOR_SHA").isNotNull(), *equal_to(given)])
        .groupBy(
            F.col("COD_SECTOR_SHA").alias("cod_sector_sha"), F.col("SECTOR_SHA").alias("sector_sha")
        )
        .agg(F.count("*").alias("total_puntos"))
        .orderBy("cod_sector_sha")
    )


def list_boards(points: DataFrame) -> DataFrame:
    return (
        points.filter(F.col("ID_JUNTA").isNotNull())
        .groupBy(F.col("ID_JUNTA").alias("id_junta"))
        .agg(F.count("*").alias("total_puntos"))
        .orderBy("id_junta")
    )


def read_filter_stats(filter_stats: DataFrame) -> DataFrame:
    """Flow ranges in level order, rounded."""
    rank = F.lit(None).cast("int")
    for level, place in FILTER_LEVELS.items():
        rank = F.when(F.col("nivel") == level, place).otherwise(rank)
    return filter_stats.orderBy(rank, "nom_cuenca", "nom_subcuenca").select(
        "nivel", "nom_cuenca", "nom_subcuenca",
        round_half_even(F.col("avgMin")).alias("avgMin"),
        round_half_even(F.col("avgMax")).alias("avgMax"),
        "total_puntos",
    )


def read_filter_level(filter_stats: DataFrame, level: str) -> DataFrame:
    """One of the three lists. The stored table holds no row of level 'global'."""
    names = {"global": [], "cuenca": ["nom_cuenca"], "subcuenca": ["nom_cuenca", "nom_subcuenca"]}[level]
    rows = read_filter_stats(filter_stats.filter(F.col("nivel") == level))
    if level == "global":
        return rows.select("avgMin", "avgMax", F.col("total_puntos").alias("total_puntos_unicos"))
    return rows.select(*names, "avgMin", "avgMax", "total_puntos")


def read_basin_stats(
    stats: DataFrame,
    cod_cuenca: int | None = None,
    cod_subcuenca: int | None = None,
    cod_subsubcuenca: int | None = None,
    include_global: bool = False,
) -> DataFrame:
    """Statistics of basin paths, sorted by code.

    ``include_global`` adds to every row the mean of all path means and the overall
    extremes. They ignore the filters, and come from a scalar subquery.
    """
    given = {"Cod_Cuenca": cod_cuenca, "Cod_Subcuenca": cod_subcuenca, "Cod_Subsubcuenca": cod_subsubcuenca}
    columns = [
        *(F.col(c).alias(c.lower()) for c in (
            "Cod_Cuenca", "Nom_Cuenca", "Cod_Region", "Cod_Subcuenca", "Nom_Subcuenca",
            "Cod_Subsubcuenca", "Nom_Subsubcuenca")),
        *(round_half_even(F.col(c)).alias(c) for c in ("caudal_promedio", "caudal_minimo", "caudal_maximo")),
        F.col("total_puntos_unicos"), F.col("total_mediciones"),
    ]
    if include_global:
        parts = ("promedio", "minimo", "maximo")
        # Rounded in the one-row aggregate: the rounding names its argument many times.
        overall = stats.filter(F.col("caudal_promedio").isNotNull()).agg(
            F.avg("caudal_promedio").alias("promedio"),
            F.min("caudal_minimo").alias("minimo"),
            F.max("caudal_maximo").alias("maximo"),
        ).select(F.struct(*(round_half_even(F.col(p)).alias(p) for p in parts))).scalar()
        columns += [overall[part].alias(f"global_{part}") for part in parts]
    return (
        where(stats, equal_to(given)).select(*columns)
        .orderBy("cod_cuenca", "cod_subcuenca", "cod_subsubcuenca")
    )


def subbasin_names(catalog: DataFrame) -> DataFrame:
    """Sub-basin names of each basin as one text, in name order.

    A group holds the distinct names of one basin, so its size does not grow with the
    number of reports or points.
    """
    named = catalog.filter(F.col("Nom_Subcuenca").isNotNull()).select(
        F.col("Cod_Cuenca").alias("cod_cuenca"), F.col("Nom_Subcuenca").alias("nom_subcuenca")
    ).distinct()
    return named.groupBy("cod_cuenca").agg(
        F.expr("listagg(nom_subcuenca, ', ') WITHIN GROUP (ORDER BY nom_subcuenca)").alias("subcuencas")
    )
