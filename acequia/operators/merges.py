"""Merging the states of new reports into stored tables, so that old reports are not read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from acequia import schema as S


def merge_rollups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Point rollup of the reports behind both, each of which has a combination of attributes once.

    The squared deviations of two groups are the sum of their own plus
    ``(difference of the means)**2 * n_a * n_b / (n_a + n_b)``.
    """
    keys = list(S.POINT_KEYS.values())
    n, flow = F.sum("n_caudal"), F.col("caudal_promedio")
    apart = F.max(flow) - F.min(flow)
    product = (n * n - F.sum(F.col("n_caudal") * F.col("n_caudal"))) / 2
    between = F.coalesce(F.try_divide(apart * apart * product, n), F.lit(0.0))
    summed = ("n_mediciones", "n_fecha", "n_caudal", "caudal_suma")
    special = {"caudal_promedio": F.try_divide(F.sum("caudal_suma"), n), "caudal_minimo": F.min("caudal_minimo"),
               "caudal_m2": F.sum("caudal_m2") + between, **{c: F.sum(c) for c in summed}}
    merged = [c for c in old.columns if c not in keys and c != "caudal_desviacion_estandar"]
    return (
        old.unionByName(new).groupBy(*keys)
        .agg(*(special.get(c, F.max(c)).alias(c) for c in merged))
        .withColumn("caudal_desviacion_estandar", F.when(
            F.col("n_caudal") > 1, F.sqrt(F.col("caudal_m2") / (F.col("n_caudal") - 1))))
        .select(*old.columns)
    )


def merge_reporters(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = [c for c in old.columns if c not in ("CANTIDAD_REPORTES", "ULTIMA_FECHA_MEDICION")]
    return old.unionByName(new).groupBy(*keys).agg(
        F.sum("CANTIDAD_REPORTES").alias("CANTIDAD_REPORTES"),
        F.max("ULTIMA_FECHA_MEDICION").alias("ULTIMA_FECHA_MEDICION"),
    ).select(*old.columns)


def merge_daily(old: DataFrame, new: DataFrame) -> DataFrame:
    """Daily means of the reports behind both, weighted by their counts."""
    means, counts = list(S.LEVEL_COUNTS), list(S.LEVEL_COUNTS.values())
    keys = [c for c in old.columns if c not in (*means, *counts, "TOTALIZADOR")]

    def mean(c: str, n: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * F.col(n)), F.sum(n)).alias(c)
    # Stored days are small: one split holds so many that they do not fit a task's memory as groups.
    return old.unionByName(new).repartition(*S.SERIES_SPREAD).groupBy(*keys).agg(
        *(mean(c, n) for c, n in S.LEVEL_COUNTS.items()), *(F.sum(n).alias(n) for n in counts),
        F.max("TOTALIZADOR").alias("TOTALIZADOR"),
    ).select(*old.columns)


def new_measurements(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct measurements of ``new`` that ``old`` does not hold; NULLs are equal to each other.

    Only old rows between the first and the last new date are compared, and those without a date if
    new ones have none.
    """
    date = F.col("Fecha_Medicion")
    first, last, undated = new.agg(F.min(date), F.max(date), F.count(F.when(date.isNull(), 1))).first()
    same_time = F.lit(False) if first is None else date.between(F.lit(first), F.lit(last))
    if undated:
        same_time = same_time | date.isNull()
    n, o = new.alias("n"), old.where(same_time).alias("o")
    return n.join(o, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in new.columns], "left_anti")
