"""Optional predicates. An absent parameter adds nothing to the plan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from acequia.functions import contains_text


def where(df: DataFrame, conditions: Iterable[Column]) -> DataFrame:
    """Rows that meet every condition; all rows when there is none."""
    found = list(conditions)
    return df.filter(reduce(and_, found)) if found else df


def equal_to(given: dict[str, object]) -> list[Column]:
    """``column == value`` for every value that is given."""
    return [F.col(c) == F.lit(v) for c, v in given.items() if v is not None]


def coordinate_is(norte: int, este: int) -> list[Column]:
    return [F.col("UTM_NORTE") == norte, F.col("UTM_ESTE") == este]


def _date(text: str) -> date:
    """A malformed date fails here, whatever the session's ANSI mode."""
    return date.fromisoformat(text)


def date_range(df: DataFrame, start: str | None, end: str | None) -> list[Column]:
    """Inclusive bounds on FECHA_MEDICION; empty text means no bound.

    On a table partitioned by year the same bounds are put on the partition
    column, so whole years are skipped before any file is opened. A malformed
    date fails the query.
    """
    found = []
    by_year = "ANIO" in df.columns
    if start:
        found.append(F.col("FECHA_MEDICION") >= F.lit(_date(start)))
        if by_year:
            found.append(F.col("ANIO") >= _date(start).year)
    if end:
        found.append(F.col("FECHA_MEDICION") <= F.lit(_date(end)))
        if by_year:
            found.append(F.col("ANIO") <= _date(end).year)
    return found


def code_or_name(identifier: str, code: str, name: str, collation: str | None = None) -> Column:
    """Digits select by code, any other text by name.

    ``collation`` (for example ``UTF8_LCASE``) sets how names compare; the default
    is by bytes.
    """
    if identifier.isascii() and identifier.isdigit():
        return F.col(code) == F.lit(int(identifier))
    column = F.collate(F.col(name), collation) if collation else F.col(name)
    return column == F.lit(identifier)


@dataclass(frozen=True)
class PointFilter:
    """The twelve optional filters of the point catalog."""

    region: int | None = None
    cod_cuenca: int | None = None
    cod_subcuenca: int | None = None
    cod_subsubcuenca: int | None = None
    filtro_null_subcuenca: bool | None = None
    caudal_minimo: float | None = None
    caudal_maximo: float | None = None
    pozo: bool | None = None
    codigo_obra: str | None = None
    shac: int | None = None
    apr: bool | None = None
    id_junta: float | None = None

    def conditions(self, code: bool = True) -> list[Column]:
        """All given conditions, or all but that on the code."""
        found = equal_to({
            "Region": self.region,
            "Cod_Cuenca": self.cod_cuenca,
            "Cod_Subcuenca": None if self.filtro_null_subcuenca else self.cod_subcuenca,
            "Cod_Subsubcuenca": self.cod_subsubcuenca,
            "es_pozo_subterraneo": self.pozo,
            "COD_SECTOR_SHA": self.shac,
            "APR": None if self.apr is None else int(self.apr),
            "ID_JUNTA": self.id_junta,
        })
        if self.filtro_null_subcuenca:
            found.append(F.col("Cod_Subcuenca").isNull())
        if self.caudal_minimo is not None:
            found.append(F.col("caudal_promedio") >= F.lit(self.caudal_minimo))
        if self.caudal_maximo is not None:
            found.append(F.col("caudal_promedio") <= F.lit(self.caudal_maximo))
        if code and self.codigo_obra is not None:
            found.append(contains_text(F.col("codigo"), self.codigo_obra))
        return found

    def echo(self) -> list[Column]:
        """The filters as typed constant columns, NULL where not given."""
        types = {
            "filtro_null_subcuenca": "boolean", "pozo": "boolean", "apr": "boolean",
            "caudal_minimo": "double", "caudal_maximo": "double", "id_junta": "double",
            "codigo_obra": "string",
        }
        return [F.lit(v).cast(types.get(n, "int")).alias(n) for n, v in asdict(self).items()]
