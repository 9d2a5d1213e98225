"""Derived tables computed from the fact.

Group keys may hold NULL, and a NULL key is a group like any other unless the
table says otherwise. Aggregates are the kind Spark combines on the map side, so a
hot key reaches the shuffle as one row per task. Where nearly every report is a group of
its own, as measurements and days are, rows are shuffled first: a task that combined them
would hold all rows of its split, and spill them, without having fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from acequia import schema as S
from acequia.functions import coordinate, zero_if_null


def named(columns: dict[str, str]) -> list[Column]:
    return [F.col(c).alias(n) for c, n in columns.items()]


def flow_statistics(flow: Column) -> list[Column]:
    return [
        F.avg(flow).alias("caudal_promedio"),
        F.min(flow).alias("caudal_minimo"),
        F.max(flow).alias("caudal_maximo"),
        F.stddev_samp(flow).alias("caudal_desviacion_estandar"),
    ]


def measurements(fact: DataFrame) -> DataFrame:
    """Distinct raw measurements, each with its own well flag."""
    found = fact.select(
        F.col("UTM_NORTE").alias("UTM_Norte"),
        F.col("UTM_ESTE").alias("UTM_Este"),
        F.col("HUSO").alias("Huso"),
        F.col("CAUDAL").alias("Caudal"),
        F.col("ALTURA_LIMNIMETRICA").alias("Altura_Limnimetrica"),
        F.col("TOTALIZADOR").alias("Totalizador"),
        F.col("NIVEL_FREATICO").alias("Nivel_Freatico"),
        F.col("FECHA_MEDICION").alias("Fecha_Medicion"),
        F.coalesce(F.col("NATURALEZA") == 1, F.lit(False)).alias("es_pozo_subterraneo"),
    )
    return found.repartition("UTM_Norte", "UTM_Este", "Fecha_Medicion", "Totalizador", "Caudal").distinct()


def basin_catalog(source: DataFrame) -> DataFrame:
    """Distinct basin paths per region. The fact and the point rollup give the same rows."""
    return source.filter(F.col("COD_CUENCA").isNotNull()).select(*named(S.BASIN_KEYS)).distinct()


def reporters(fact: DataFrame) -> DataFrame:
    """Reports and last date per reporter, coordinate and basin."""
    return (
        fact.filter(F.col("INF").isNotNull())
        .groupBy(*S.COORD, "NOMB_INF", "A_PAT_INF", "A_MAT_INF", *S.BASIN_CODES)
        .agg(
            F.count("*").alias("CANTIDAD_REPORTES"),
            F.max("FECHA_MEDICION").alias("ULTIMA_FECHA_MEDICION"),
        )
    )


def _daily(fact: DataFrame, *extra: Column) -> DataFrame:
    return (
        fact.select(
            *S.BASIN_PATH, *S.COORD,
            F.col("FECHA_MEDICION").cast("date").alias("FECHA_MEDICION"),
            *S.LEVELS, "TOTALIZADOR",
        )
        .repartition(*S.SERIES_SPREAD)
        .groupBy(*S.BASIN_PATH, *S.COORD, "FECHA_MEDICION")
        .agg(*(F.avg(c).alias(c) for c in S.LEVELS), F.max("TOTALIZADOR").alias("TOTALIZADOR"), *extra)
    )


def daily_series(fact: DataFrame) -> DataFrame:
    """One row per basin path, coordinate and day. NULL coordinates and dates stay."""
    return _daily(fact)


def daily_states(fact: DataFrame) -> DataFrame:
    """The daily series with the reports behind each mean, so that later reports can be merged in."""
    return _daily(fact, *(F.count(c).alias(n) for c, n in S.LEVEL_COUNTS.items()))


def daily_series_by_coord(fact: DataFrame) -> DataFrame:
    """Variant with one row per coordinate and day; NULL keys are dropped.

    Spark sorts its input for MAX of a string. Grouping by the path first keeps the
    pass over the fact on hash aggregation, and only the merged rows are sorted. Rows
    are shuffled once, by the three keys, which serves both groupings; a coordinate has
    a few reports a day, so combining them before the shuffle would save little.
    """
    keys = (*S.COORD, "FECHA_MEDICION")
    dated = fact.select(
        *S.BASIN_PATH, *S.COORD,
        F.col("FECHA_MEDICION").cast("date").alias("FECHA_MEDICION"),
        *S.LEVELS, "TOTALIZADOR",
    ).dropna(subset=list(keys)).repartition(*keys)
    parts = dated.groupBy(*keys, *S.BASIN_PATH).agg(
        *(F.sum(c).alias(f"suma_{c}") for c in S.LEVELS),
        *(F.count(c).alias(f"n_{c}") for c in S.LEVELS),
        F.max("TOTALIZADOR").alias("TOTALIZADOR"),
    )
    return parts.groupBy(*keys).agg(
        *(F.max(c).alias(c) for c in S.BASIN_PATH),
        *(F.try_divide(F.sum(f"suma_{c}"), F.sum(f"n_{c}")).alias(c) for c in S.LEVELS),
        F.max("TOTALIZADOR").alias("TOTALIZADOR"),
    ).select(*S.BASIN_PATH, *keys, *S.LEVELS, "TOTALIZADOR")


def rights_per_point(fact: DataFrame) -> DataFrame:
    """Rights of each coordinate within a basin path, repeated reports merged by MAX."""
    return (
        fact.filter(F.col("TIPO_DERECHO").isNotNull())
        .groupBy(*S.BASIN_CODES, "REGION", *S.COORD)
        .agg(*(F.max(c).alias(c) for c in S.RIGHT_AMOUNTS))
    )


def rights_per_basin(per_point: DataFrame) -> DataFrame:
    """Merged rights summed per basin path and region."""
    return per_point.groupBy(*S.BASIN_CODES, "REGION").agg(
        F.count("*").alias("puntos_con_derechos"),
        *(F.sum(c).alias(n) for c, n in zip(S.RIGHT_AMOUNTS, S.BASIN_RIGHT_SUMS)),
    )


def rights_per_coord(fact: DataFrame) -> DataFrame:
    """Rights of each coordinate whatever its basin path: the source of the update."""
    return (
        fact.filter(F.col("TIPO_DERECHO").isNotNull())
        .groupBy(*S.COORD)
        .agg(*(F.max(c).alias(c) for c in S.RIGHTS))
    )


def with_basin_rights(flows: DataFrame, rights: DataFrame) -> DataFrame:
    """Basin statistics: rights joined on the four codes, 0 where there are none.

    The rights are unique on the four codes, so joining after the aggregation gives
    the same rows as joining each report. Codes are compared with ``=``: a path with
    a NULL level has no rights.
    """
    f, r = flows.alias("f"), rights.alias("r")
    codes = {"Cod_Cuenca": "COD_CUENCA", "Cod_Subcuenca": "COD_SUBCUENCA",
             "Cod_Subsubcuenca": "COD_SUBSUBCUENCA", "Cod_Region": "REGION"}
    on = [F.col(f"f.{a}") == F.col(f"r.{b}") for a, b in codes.items()]
    return f.join(r, on, "left").select(
        "f.*", *(zero_if_null(F.col(f"r.{c}")).alias(c) for c in S.BASIN_RIGHTS)
    )


def flow_range_per_point(fact: DataFrame) -> DataFrame:
    """Lowest and highest flow of each coordinate within a sub-basin."""
    return fact.groupBy("NOM_CUENCA", "NOM_SUBCUENCA", *S.COORD).agg(
        F.min("CAUDAL").alias("avgMin"), F.max("CAUDAL").alias("avgMax")
    )


_FILTER_COLUMNS = ("nivel", "nom_cuenca", "nom_subcuenca", "avgMin", "avgMax", "total_puntos")


def _flow_range(points: Column) -> list[Column]:
    return [
        F.min("avgMin").alias("avgMin"),
        F.max("avgMax").alias("avgMax"),
        points.alias("total_puntos"),
    ]


def filter_stats(per_point: DataFrame) -> DataFrame:
    """Flow range and points per basin and per sub-basin, stacked.

    Both halves read the same per-point ranges; Spark computes that exchange once.
    A point may lie in several sub-basins of a basin but is listed once in each, so
    only the basins need a distinct count.
    """
    distinct = F.count_distinct(coordinate())
    basins = per_point.groupBy("NOM_CUENCA").agg(*_flow_range(distinct)).select(
        F.lit("cuenca").alias("nivel"),
        F.col("NOM_CUENCA").alias("nom_cuenca"),
        F.lit(None).cast("string").alias("nom_subcuenca"),
        "avgMin", "avgMax", "total_puntos",
    )
    subbasins = per_point.groupBy("NOM_CUENCA", "NOM_SUBCUENCA").agg(*_flow_range(F.count("*"))).select(
        F.lit("subcuenca").alias("nivel"),
        F.col("NOM_CUENCA").alias("nom_cuenca"),
        F.col("NOM_SUBCUENCA").alias("nom_subcuenca"),
        "avgMin", "avgMax", "total_puntos",
    )
    return basins.unionByName(subbasins)


def filter_stats_grouping_sets(per_point: DataFrame) -> DataFrame:
    """The same table in one pass; the grouping id tells a total from a NULL name."""
    c, s = F.col("NOM_CUENCA"), F.col("NOM_SUBCUENCA")
    return (
        per_point.groupingSets([[c], [c, s]], c, s)
        .agg(*_flow_range(F.count_distinct(coordinate())), F.grouping_id().alias("total_de"))
        .select(
            F.when(F.col("total_de") == 0, "subcuenca").otherwise("cuenca").alias("nivel"),
            c.alias("nom_cuenca"), s.alias("nom_subcuenca"), *_FILTER_COLUMNS[3:],
        )
    )
