"""Writing and reading derived tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from acequia.functions import interleaved


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors can reach, as ``spark.checkpoint.dir`` names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share, or name a root")
    return named.rstrip("/")


def write_table(
    df: DataFrame,
    path: str,
    *,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    range_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    near_by: Sequence[str] = (),
    options: Mapping[str, str] = {},
) -> None:
    """Write a derived table as Parquet.

    ``mode="overwrite"`` is the full refresh: it replaces all partitions, whatever
    overwrite mode the session has. ``"errorifexists"`` is the first build that must
    not replace anything. ``cluster_by`` rebalances rows on those columns: adaptive
    execution then splits a hot value over several files and merges small ones.
    ``range_by`` gives every file a range of these columns. ``sort_by`` orders rows
    within files, which makes the min/max statistics and dictionaries of the row
    groups selective for these columns. ``near_by`` names two whole-number columns, such as
    coordinates: rows that are near each other in both come to lie together (along a
    space-filling curve), so statistics are selective for either and for boxes. Rows at one place
    are spread further by ``range_by``. ``options`` go to the writer.
    """
    if mode not in ("overwrite", "errorifexists"):
        raise ValueError(f"unsupported mode {mode!r}")
    if cluster_by:
        df = df.hint("rebalance", *cluster_by)
    ranges: list[Column] = [interleaved(*map(F.col, near_by))] if near_by else []
    ranges += map(F.col, range_by)
    if ranges:
        df = df.repartitionByRange(*ranges)
    order = [*map(F.col, sort_by)] or ranges
    if order:
        df = df.sortWithinPartitions(*map(F.col, partition_by), *order)
    writer = df.write.mode(mode).options(**options).option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _year(df: DataFrame) -> Column:
    """The year that a table is partitioned by, else that of its dates."""
    return F.col("ANIO") if "ANIO" in df.columns else F.year("FECHA_MEDICION")


def in_years(df: DataFrame, years: Sequence[int | None]) -> Column:
    """Whether a row's year is one of these; None stands for rows without a date."""
    known, year = [y for y in years if y is not None], _year(df)
    inside = year.isNotNull() & year.isin(known) if known else F.lit(False)
    return inside | year.isNull() if None in years else inside


def not_in_years(df: DataFrame, years: Sequence[int | None]) -> Column:
    """The opposite, in a form that skips partitions."""
    known, year = [y for y in years if y is not None], _year(df)
    outside = ~year.isin(known) if known else F.lit(True)
    return outside & year.isNotNull() if None in years else outside | year.isNull()


def read_part(spark: SparkSession, root: str, part: Mapping, schema: StructType) -> DataFrame:
    """One folder of a table without the files and years that later parts replace. Both conditions are
    met when files are listed, so what they leave out is not opened."""
    df = read_table(spark, f"{root}/{part['path']}", schema)
    if part.get("without_files"):
        df = df.where(~F.col("_metadata.file_name").isin(part["without_files"]))
    if part.get("without_years"):
        df = df.where(not_in_years(df, part["without_years"]))
    return df


def read_parts(spark: SparkSession, root: str, entry: Mapping) -> DataFrame:
    """A table that several changes have written, as its entry in the version log describes it."""
    schema = StructType.fromJson(entry["schema"])
    return reduce(DataFrame.unionByName, (read_part(spark, root, p, schema) for p in entry["parts"]))


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write a result as CSV part files with a header line, one per partition."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
