"""The wide fact table of reports, from Parquet or from a relational source."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from acequia import schema as S


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    """Scan stored reports. The fixed schema avoids an inference pass over the files."""
    return spark.read.schema(S.FACT).parquet(path)


class StoredFact:
    """Reports in the Parquet files of one folder, to which files are added."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        return read_fact(self.spark, self.path)

    def read_files(self, names: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(S.FACT).parquet(*(f"{self.path}/{n}" for n in names))

    def files(self) -> set[tuple[str, int, int]]:
        """Name below the folder, size and time of each file that a scan would read."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        base = files.makeQualified(folder).toString().rstrip("/") + "/"
        found, left = set(), files.listFiles(folder, True)
        while left.hasNext():
            status = left.next()
            name = status.getPath().toString().removeprefix(base)
            if not any(part.startswith(("_", ".")) for part in name.split("/")):
                found.add((name, status.getLen(), status.getModificationTime()))
        return found


def read_fact_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str,
    bounds: Sequence[int | date],
    null_key: str | None = None,
    null_parts: int = 8,
    fetch_size: int = 10_000,
    **options: str,
) -> DataFrame:
    """Scan the same table over JDBC, one task for each slice.

    ``bounds`` are ascending values of ``partition_column``: a slice lies between two
    neighbours, and one before the first and one after the last hold the rest. Rows
    where the column is NULL are slices of their own, split by the whole-number column
    ``null_key`` where one is named. The column list is pushed into the source query;
    filters are too, where a column's type needs no cast (see ``conform``).
    """
    slices = jdbc_slices(partition_column, bounds, null_key, null_parts)
    properties = {"fetchsize": str(fetch_size), "preferTimestampNTZ": "true", **options}
    return conform(spark.read.jdbc(url, table, predicates=slices, properties=properties))


def jdbc_slices(
    column: str, bounds: Sequence[int | date], null_key: str | None = None, null_parts: int = 8
) -> list[str]:
    """Conditions that together hold every row of the table once, NULLs of ``column`` included."""
    def text(value: int | date) -> str:
        return f"'{value.isoformat()}'" if isinstance(value, date) else str(int(value))

    if list(bounds) != sorted(set(bounds)) or not bounds:
        raise ValueError("bounds must be ascending and distinct")
    inner = [f"{column} >= {text(a)} AND {column} < {text(b)}" for a, b in zip(bounds, bounds[1:], strict=False)]
    nulls = [f"{column} IS NULL"]
    if null_key:
        part = f"ABS({null_key} % {int(null_parts)})"
        nulls = [f"{column} IS NULL AND {part} = {i}" for i in range(null_parts)]
        nulls.append(f"{column} IS NULL AND {null_key} IS NULL")
    return [f"{column} < {text(bounds[0])}", *inner, f"{column} >= {text(bounds[-1])}", *nulls]


def conform(df: DataFrame) -> DataFrame:
    """Name and type the columns as ``schema.FACT`` does, whatever case and width they have.

    A column that has its type already is only renamed, so filters on it reach the
    source; a filter on a column that must be cast is applied after the read.
    """
    given = {f.name.lower(): f.dataType for f in df.schema}
    return df.select(*(
        (F.col(f.name) if given.get(f.name.lower()) == f.dataType else F.col(f.name).cast(f.dataType)).alias(f.name)
        for f in S.FACT))
