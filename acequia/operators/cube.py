"""Daily sums of every area, from which each series of an area is read.

One row per level, code, name and day holds sums and counts of each metric three times: over all
series rows, and over the rows of wells and of surface points as the point catalog lists them. The
catalog may list a coordinate several times; each listing counts the series row once, so rows are
weighed by the number of listings instead of being repeated. Sums and counts of several rows add up,
which serves a name that several codes share and the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from acequia import schema as S
from acequia.functions import date_text
from acequia.operators.filters import code_or_name, date_range, where
from acequia.operators.series import AREAS, METRICS

#: Which rows are summed, by the well flag that a read asks for.
ROWS = {None: "todas", True: "pozo", False: "superficie"}
SECTOR = "shac"
_DAY = ("FECHA_MEDICION", "ANIO")
_AREA = ("NIVEL", "CODIGO", "NOMBRE")


def _listings(catalog: DataFrame, *keys: str) -> DataFrame:
    """Catalog rows of wells and of surface points by coordinate (and ``keys``). The coordinates come
    out wider than they went in, so that adaptive execution may split a hot one in the join."""
    well = F.col("es_pozo_subterraneo")
    listed = catalog.where(F.col("UTM_Norte").isNotNull() & F.col("UTM_Este").isNotNull()).groupBy(
        "UTM_Norte", "UTM_Este", *keys).agg(F.count_if(well).alias("pozo"), F.count_if(~well).alias("superficie"))
    return listed.select(F.col("UTM_Norte").cast("long").alias("norte"), F.col("UTM_Este").cast("long").alias("este"),
                         *keys, "pozo", "superficie")


def _with_listings(series: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    on = [F.col("UTM_NORTE").cast("long") == F.col("norte"), F.col("UTM_ESTE").cast("long") == F.col("este")]
    return series.join(listed, on, how)


def _first_sums(weights: dict[str, Column]) -> list[Column]:
    found = []
    for rows, weight in weights.items():
        for c in S.LEVELS:
            counted = F.when(F.col(c).isNotNull(), weight)
            found += [F.sum(F.col(c) * weight).alias(f"{c}_suma_{rows}"),
                      F.coalesce(F.sum(counted), F.lit(0)).cast("long").alias(f"{c}_n_{rows}")]
        flow = F.col("CAUDAL").isNotNull() & (weight > 0)
        found += [F.sum(F.when(flow, F.col("TOTALIZADOR") * weight)).alias(f"TOTALIZADOR_suma_{rows}"),
                  F.max(F.when(flow, F.col("TOTALIZADOR"))).alias(f"TOTALIZADOR_max_{rows}")]
    return found


def _merged_sums(columns: list[str]) -> list[Column]:
    return [(F.max(c) if "_max_" in c else F.sum(c)).alias(c) for c in columns]


def area_days(series: DataFrame, catalog: DataFrame) -> DataFrame:
    """The cube over a daily series that has its year in ``ANIO``.

    Basin paths are summed by day first, before their rows are repeated for the three levels. A hot
    coordinate, path or sector reaches each shuffle as one row per task and day.
    """
    one = F.lit(1)
    listed = _with_listings(series, _listings(catalog), "left")
    weights = {"todas": one, "pozo": F.coalesce("pozo", F.lit(0)), "superficie": F.coalesce("superficie", F.lit(0))}
    paths = listed.groupBy(*S.BASIN_PATH, *_DAY).agg(*_first_sums(weights))
    sums = paths.columns[len(S.BASIN_PATH) + len(_DAY):]
    levels = F.array(*(
        F.struct(F.lit(level).alias("NIVEL"), F.col(code).alias("CODIGO"), F.col(name).alias("NOMBRE"))
        for level, (code, name) in AREAS.items() if level != SECTOR))
    basins = paths.select(F.explode(levels).alias("area"), *_DAY, *sums).select("area.*", *_DAY, *sums)
    basins = basins.groupBy(*_AREA, *_DAY).agg(*_merged_sums(sums))

    code, name = AREAS[SECTOR]
    placed = _with_listings(series, _listings(catalog, code, name), "inner")
    pozo, superficie = F.col("pozo"), F.col("superficie")
    weights = {"todas": pozo + superficie, "pozo": pozo, "superficie": superficie}
    sectors = placed.groupBy(F.lit(SECTOR).alias("NIVEL"), F.col(code).alias("CODIGO"), F.col(name).alias("NOMBRE"), *_DAY)
    found = basins.unionByName(sectors.agg(*_first_sums(weights)))
    return found.where(F.col("CODIGO").isNotNull() | F.col("NOMBRE").isNotNull())


def changed_listings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Coordinates that an older catalog lists, and the newer one differently."""
    keys = AREAS[SECTOR]
    before = _listings(old, *keys)
    places = before.select("norte", "este").distinct()
    after = _listings(new, *keys).join(places, ["norte", "este"], "left_semi")
    both = before.withColumn("cuando", F.lit(1)).unionByName(after.withColumn("cuando", F.lit(-1)))
    return both.groupBy("norte", "este", *keys, "pozo", "superficie").agg(F.sum("cuando").alias("resto")).where("resto <> 0")


def read_area_series(
    days: DataFrame,
    level: str,
    metric: str,
    identifier: str,
    start: str | None = None,
    end: str | None = None,
    well: bool | None = None,
    collation: str | None = None,
) -> DataFrame:
    """As ``series.area_series``, from the cube: one row per day and area is read, no join."""
    value, label = METRICS[metric]
    rows = ROWS[well]
    asked = [F.col("NIVEL") == level, code_or_name(identifier, "CODIGO", "NOMBRE", collation),
             F.col(f"{value}_n_{rows}") > 0, *date_range(days, start, end)]
    total = F.sum(f"{value}_suma_{rows}")
    average = total / F.sum(f"{value}_n_{rows}")
    aggregates, columns = [average.alias(label)], [F.col(label)]
    if metric == "caudal":
        aggregates += [total.alias("caudal_sumado"), F.sum(f"TOTALIZADOR_suma_{rows}").alias("totalizador_sumado"),
                       F.max(f"TOTALIZADOR_max_{rows}").alias("totalizador_max")]
        columns += [F.col(label).alias("caudal_promedio"), F.col("caudal_sumado"),
                    F.col("totalizador_sumado"), F.col("totalizador_max")]
    return (
        where(days, asked).groupBy("FECHA_MEDICION").agg(*aggregates)
        .orderBy(F.col("FECHA_MEDICION").desc_nulls_last())
        .select(date_text(F.col("FECHA_MEDICION")).alias("fecha_medicion"), *columns)
    )
