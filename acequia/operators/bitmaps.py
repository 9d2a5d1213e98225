"""Exact distinct counts of points that can be merged: one bit for each point.

Points are numbered densely along a curve through the plane, so the points of an area share few
blocks of bits. The bitmaps of basin paths are stored; those of any area above are their union, and
new points only add bits. No level needs a distinct aggregation over points again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from acequia.functions import interleaved

PATH = ("Cod_Cuenca", "Nom_Cuenca", "Cod_Subcuenca", "Nom_Subcuenca", "Cod_Subsubcuenca", "Nom_Subsubcuenca", "Region")


def _place() -> Column:
    """A coordinate as text, with '' for NULL: rows without coordinates count as one more point."""
    north, east = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("UTM_Norte", "UTM_Este"))
    return F.concat(north, F.lit("-"), east)


def places(rollup: DataFrame) -> DataFrame:
    """Each coordinate once, as ``punto``, with its place in the order of numbers."""
    return rollup.groupBy(_place().alias("punto")).agg(
        F.min(F.coalesce(interleaved(F.col("UTM_Norte"), F.col("UTM_Este")), F.lit(-1))).alias("curva"))


def ordered(found: DataFrame) -> DataFrame:
    """Places in ranges of the order; ``en`` says in which range and where. To be written before it is read."""
    split = found.repartitionByRange("curva", "punto").sortWithinPartitions("curva", "punto")
    return split.select("punto", F.monotonically_increasing_id().alias("en"))


def numbered(written: DataFrame, start: int = 0) -> DataFrame:
    """``punto`` and ``numero`` from ``start`` on. Only one row for each range is summed in one task."""
    part = F.shiftright("en", 33)
    sizes = written.groupBy(part.alias("tramo")).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.orderBy("tramo").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("tramo", F.coalesce(earlier, F.lit(0)).alias("antes"))
    return written.join(starts, part == F.col("tramo")).select(
        "punto", (F.col("antes") + F.col("en").bitwiseAND((1 << 33) - 1) + start).alias("numero"))


def numbered_in_one_task(found: DataFrame) -> DataFrame:
    """The same numbers as a plan alone, for tables that are not stored."""
    order = Window.orderBy("curva", "punto")
    return found.select("punto", (F.row_number().over(order) - 1).cast("long").alias("numero"))


def path_bitmaps(rollup: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row per basin path, region and block of bits."""
    held = rollup.select(*PATH, _place().alias("punto")).distinct().join(numbers, "punto")
    return held.groupBy(*PATH, F.bitmap_bucket_number("numero").alias("bloque")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("numero")).alias("bits"))


def distinct_points(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of points for each combination of keys: the bits of the union of its paths."""
    blocks = bitmaps.groupBy(*keys, "bloque").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return blocks.groupBy(*keys).agg(F.sum("n").alias("total_puntos_unicos"))


def same(a: str, b: str, keys: Sequence[str]) -> Column:
    return reduce(and_, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def with_distinct_points(flows: DataFrame, bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    f, d = flows.alias("f"), distinct_points(bitmaps, keys).alias("d")
    return f.join(d, same("f", "d", keys), "left").select("f.*", "d.total_puntos_unicos")


LEVELS = {
    "region": ("Region",),
    "cuenca": ("Cod_Cuenca",),
    "subcuenca": ("Cod_Cuenca", "Cod_Subcuenca"),
    "subsubcuenca": ("Cod_Cuenca", "Cod_Subcuenca", "Cod_Subsubcuenca"),
    "total": (),
}


def points_by_level(bitmaps: DataFrame) -> DataFrame:
    """Points of every region, basin, sub-basin and sub-sub-basin, and of all together."""
    columns = ("Region", "Cod_Cuenca", "Cod_Subcuenca", "Cod_Subsubcuenca")

    def level(name: str, keys: Sequence[str]) -> DataFrame:
        return distinct_points(bitmaps, keys).select(
            F.lit(name).alias("nivel"), *((F.col(c) if c in keys else F.lit(None).cast("int")).alias(c.lower()) for c in columns),
            F.coalesce("total_puntos_unicos", F.lit(0)).alias("total_puntos_unicos"))
    return reduce(DataFrame.unionByName, (level(n, k) for n, k in LEVELS.items()))


def filter_stats(rollup: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """As ``builds.filter_stats``, with the points counted by bits."""
    def level(name: str, keys: Sequence[str]) -> DataFrame:
        ranges = rollup.groupBy(*keys).agg(F.min("caudal_minimo").alias("avgMin"), F.max("caudal_maximo").alias("avgMax"))
        sub = F.col("Nom_Subcuenca") if "Nom_Subcuenca" in keys else F.lit(None).cast("string")
        return with_distinct_points(ranges, bitmaps, keys).select(
            F.lit(name).alias("nivel"), F.col("Nom_Cuenca").alias("nom_cuenca"), sub.alias("nom_subcuenca"),
            "avgMin", "avgMax", F.col("total_puntos_unicos").alias("total_puntos"))
    return level("cuenca", ["Nom_Cuenca"]).unionByName(level("subcuenca", ["Nom_Cuenca", "Nom_Subcuenca"]))
