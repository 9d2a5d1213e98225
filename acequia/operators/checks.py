"""Checks on stored tables: column coverage, samples, points with data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from acequia.functions import contains_text
from acequia.operators.points import first_rows
from acequia.operators.text_index import rows_with


def column_coverage(table: DataFrame, name: str, expected: Sequence[str]) -> DataFrame:
    """For each expected column: is it there, and in how many rows is it not NULL."""
    present = {c.lower() for c in table.columns}
    rows = F.array(*(
        F.struct(
            F.lit(c).alias("columna"),
            F.lit(c.lower() in present).alias("presente"),
            (F.count(F.col(c)) if c.lower() in present else F.lit(None).cast("bigint")).alias("no_nulos"),
        )
        for c in expected
    ))
    return table.agg(rows.alias("filas")).select(F.lit(name).alias("tabla"), F.inline("filas"))


def coverage_by_year(series: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row per year of a series: its rows, and how many have a value in each expected column."""
    return series.groupBy("ANIO").agg(F.count(F.lit(1)).alias("filas"), *(F.count(F.col(c)).alias(c) for c in expected))


def stored_coverage(figures: DataFrame, name: str, expected: Sequence[str]) -> DataFrame:
    """As ``column_coverage``, from rows that hold the number of values of each expected column."""
    rows = F.array(*(
        F.struct(F.lit(c).alias("columna"), F.lit(True).alias("presente"),
                 F.coalesce(F.sum(F.col(c)), F.lit(0)).alias("no_nulos"))
        for c in expected))
    return figures.agg(rows.alias("filas")).select(F.lit(name).alias("tabla"), F.inline("filas"))


def sample_rows(table: DataFrame, columns: Sequence[str], any_of: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in which at least one of ``any_of`` is not NULL."""
    found = F.lit(False)
    for c in any_of:
        found = found | F.col(c).isNotNull()
    rows = table.filter(found) if any_of else table
    return first_rows(rows.select(*columns), n)


def _rows_per_coord(table: DataFrame, name: str) -> DataFrame:
    """Rows of a table at each coordinate. Every task counts before the shuffle, so a
    coordinate with very many rows moves as one row per task."""
    return table.groupBy(F.col("UTM_NORTE").alias("n"), F.col("UTM_ESTE").alias("e")).agg(F.count("*").alias(name))


def point_coverage(
    points: DataFrame, measurements: DataFrame, series: DataFrame, sector_text: str, index: DataFrame | None = None
) -> DataFrame:
    """Points whose sector name contains a text, with their rows in two tables."""
    if index is None:
        named = points.filter(contains_text(F.col("SECTOR_SHA"), sector_text))
    else:
        named = rows_with(points, index, "SECTOR_SHA", sector_text)
    wanted = named.select(
        F.col("UTM_Norte").alias("utm_norte"), F.col("UTM_Este").alias("utm_este")
    ).distinct()
    out = wanted
    for table, name in ((measurements, "n_datos"), (series, "n_series")):
        counts = _rows_per_coord(table, name)
        out = out.join(
            counts, [F.col("utm_norte") == F.col("n"), F.col("utm_este") == F.col("e")], "left"
        ).drop("n", "e")
    return out.select(
        "utm_norte", "utm_este",
        F.coalesce("n_datos", F.lit(0)).alias("n_datos"),
        F.coalesce("n_series", F.lit(0)).alias("n_series"),
    )


def sectors_with_data(points: DataFrame, series: DataFrame) -> DataFrame:
    """Sectors with at least one series row. The series is reduced to its coordinates first."""
    coords = series.select(F.col("UTM_NORTE").alias("n"), F.col("UTM_ESTE").alias("e")).distinct()
    return (
        points.filter(F.col("COD_SECTOR_SHA").isNotNull())
        .join(coords, [F.col("UTM_Norte") == F.col("n"), F.col("UTM_Este") == F.col("e")], "left_semi")
        .select(F.col("COD_SECTOR_SHA").alias("cod_sector_sha"), F.col("SECTOR_SHA").alias("sector_sha"))
        .distinct()
    )
