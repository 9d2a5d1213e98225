"""One pass over the fact that serves several derived tables.

The point rollup groups the fact once by the twenty attributes of a point and
keeps what later groupings need: sums, counts, extremes and squared deviations.
The point catalog, the basin catalog, basin statistics, filter ranges and rights
all follow from it without reading the fact again. Its size is the number of
points, not the number of reports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from acequia import schema as S
from acequia.operators.bitmaps import PATH, with_distinct_points
from acequia.operators.builds import named

_STATED = {c: f"con_derecho_{c}" for c in S.RIGHT_AMOUNTS}


def point_rollup(fact: DataFrame) -> DataFrame:
    flow = F.col("CAUDAL")
    stated = F.col("TIPO_DERECHO").isNotNull()
    return (
        fact.select(*named(S.POINT_KEYS), flow, "NATURALEZA", "FECHA_MEDICION", *S.RIGHTS)
        .groupBy(*S.POINT_KEYS.values())
        .agg(
            F.avg(flow).alias("caudal_promedio"),
            F.min(flow).alias("caudal_minimo"),
            F.max(flow).alias("caudal_maximo"),
            F.count("*").alias("n_mediciones"),
            F.count("FECHA_MEDICION").alias("n_fecha"),
            F.count(flow).alias("n_caudal"),
            F.sum(flow).alias("caudal_suma"),
            (F.var_pop(flow) * F.count(flow)).alias("caudal_m2"),
            F.max("NATURALEZA").alias("naturaleza"),
            *(F.max(c).alias(c) for c in S.RIGHTS),
            *(F.max(F.when(stated, F.col(c))).alias(n) for c, n in _STATED.items()),
        )
        .withColumn("caudal_desviacion_estandar", F.when(
            F.col("n_caudal") > 1, F.sqrt(F.col("caudal_m2") / (F.col("n_caudal") - 1))))
    )


def fact_figures(rollup: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the fact and, for each of its columns that the rollup knows, how many rows have a value:
    one row with ``filas`` and the columns. Sums of counts equal a scan of the fact."""
    n = F.col("n_mediciones")
    known = {c.lower() for c in S.POINT_KEYS.values()}

    def filled(c: str):
        if c.lower() in known:
            return F.sum(F.when(F.col(c).isNotNull(), n).otherwise(0))
        return F.sum({"fecha_medicion": "n_fecha", "caudal": "n_caudal"}[c.lower()])
    return rollup.agg(F.coalesce(F.sum(n), F.lit(0)).alias("filas"),
                      *(F.coalesce(filled(c), F.lit(0)).alias(c) for c in columns))


def points(rollup: DataFrame) -> DataFrame:
    """Point catalog: one row per combination of the twenty attributes.

    A point is a well when the highest nature code reported for it is 1.
    """
    return rollup.select(
        *S.POINT_PLACE,
        "caudal_promedio", "caudal_minimo", "caudal_maximo", "caudal_desviacion_estandar",
        "n_mediciones", "codigo",
        F.coalesce(F.col("naturaleza") == 1, F.lit(False)).alias("es_pozo_subterraneo"),
        *S.POINT_ATTRIBUTES,
        *S.RIGHTS,
    )


def _pooled_flows(rollup: DataFrame, keys: list[str], *extra) -> DataFrame:
    """Flow statistics of coarser groups from those of their points.

    The squared deviations of a group are the sum over its points of their own plus
    ``n * (mean - group mean)**2``. The group means come from a first aggregation and
    are joined back, which stays accurate where a plain sum of squares would cancel.
    """
    n = F.sum("n_caudal")
    groups = rollup.groupBy(*keys).agg(
        F.try_divide(F.sum("caudal_suma"), n).alias("caudal_promedio"),
        F.min("caudal_minimo").alias("caudal_minimo"),
        F.max("caudal_maximo").alias("caudal_maximo"),
        n.alias("n_grupo"),
        *extra,
    )
    r, g = rollup.alias("r"), groups.alias("g")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    apart = F.col("r.caudal_promedio") - F.col("g.caudal_promedio")
    squares = F.col("r.caudal_m2") + F.col("r.n_caudal") * apart * apart
    n = F.col("n_grupo")
    return (
        r.join(g, same)
        .select("g.*", squares.alias("m2"))
        .groupBy(*groups.columns)
        .agg(F.sum("m2").alias("m2"))
        .withColumn("caudal_desviacion_estandar", F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))))
    )


def basin_flows(rollup: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Flow statistics of basin paths; ``bitmaps`` (see ``operators.bitmaps``) count their points."""
    pooled = _pooled_flows(rollup, list(PATH), F.sum("n_mediciones").alias("total_mediciones"))
    return with_distinct_points(pooled, bitmaps, PATH).withColumnRenamed("Region", "Cod_Region").select(
        *PATH[:6], "Cod_Region",
        "caudal_promedio", "caudal_minimo", "caudal_maximo", "caudal_desviacion_estandar",
        "total_puntos_unicos", "total_mediciones",
    )


def points_by_coord(rollup: DataFrame) -> DataFrame:
    """Variant of the catalog with one row per coordinate; NULL coordinates are dropped."""
    located = rollup.dropna(subset=["UTM_Norte", "UTM_Este"])
    place = ["UTM_Norte", "UTM_Este"]
    pooled = _pooled_flows(
        located, place,
        *(F.max(c).alias(c) for c in S.POINT_KEYS.values() if c not in place),
        F.sum("n_mediciones").alias("n_mediciones"),
        *(F.max(c).alias(c) for c in S.RIGHTS),
    )
    return pooled.select(
        *S.POINT_PLACE,
        "caudal_promedio", "caudal_minimo", "caudal_maximo", "caudal_desviacion_estandar",
        "n_mediciones", "codigo", *S.POINT_ATTRIBUTES, *S.RIGHTS,
    )


def rights_per_point(rollup: DataFrame) -> DataFrame:
    """Rights per coordinate and basin path, from reports that state a right type."""
    return (
        rollup.filter(F.col("TIPO_DERECHO").isNotNull())
        .groupBy(*S.BASIN_CODES, "REGION", *S.COORD)
        .agg(*(F.max(n).alias(c) for c, n in _STATED.items()))
    )


def rights_per_coord(rollup: DataFrame) -> DataFrame:
    return (
        rollup.filter(F.col("TIPO_DERECHO").isNotNull())
        .groupBy(*S.COORD)
        .agg(
            F.max("TIPO_DERECHO").alias("TIPO_DERECHO"),
            *(F.max(n).alias(c) for c, n in _STATED.items()),
        )
    )


def flow_range_per_point(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("NOM_CUENCA", "NOM_SUBCUENCA", *S.COORD).agg(
        F.min("caudal_minimo").alias("avgMin"), F.max("caudal_maximo").alias("avgMax")
    )
