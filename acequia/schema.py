"""Column names, key lists and types shared by every operator.

Stored tables keep the published column names, so a query written against
those tables still reads the same columns. Spark resolves names without regard
to case (``spark.sql.caseSensitive=false``), as the source system does.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Names and order that results must carry.
MONTHS = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)
RIGHT_TYPE_LABELS = {1: "Consuntivo", 2: "No Consuntivo"}
UNKNOWN_LABEL = "Desconocido"
MAX_UTM_NORTE = 10_000_000
MAX_UTM_ESTE = 1_000_000
DEFAULT_POINT_LIMIT = 120
DEFAULT_REPORTER_LIMIT = 100

# A right of one point, and the same figures summed over a basin.
MONTHLY_FLOWS = tuple(f"CAUDAL_{m.upper()}" for m in MONTHS)
RIGHT_AMOUNTS = ("VOLUMEN_ANUAL", *MONTHLY_FLOWS)
RIGHTS = ("TIPO_DERECHO", *RIGHT_AMOUNTS)
MONTHLY_SUMS = tuple(f"caudal_{m}_sum" for m in MONTHS)
BASIN_RIGHT_SUMS = ("volumen_anual_total", *MONTHLY_SUMS)
BASIN_RIGHTS = ("puntos_con_derechos", *BASIN_RIGHT_SUMS)

COORD = ("UTM_NORTE", "UTM_ESTE")
BASIN_PATH = (
    "COD_CUENCA", "NOM_CUENCA",
    "COD_SUBCUENCA", "NOM_SUBCUENCA",
    "COD_SUBSUBCUENCA", "NOM_SUBSUBCUENCA",
)
BASIN_CODES = ("COD_CUENCA", "COD_SUBCUENCA", "COD_SUBSUBCUENCA")

# The measured quantities of the daily series.
LEVELS = ("CAUDAL", "ALTURA_LIMNIMETRICA", "NIVEL_FREATICO")
LEVEL_COUNTS = {c: f"n_{c}" for c in LEVELS}
#: Columns of the stored daily series that its published form does not have.
SERIES_STATE = ("ANIO", *LEVEL_COUNTS.values())
#: Keys of the daily series that spread its rows over tasks: all but the names, which follow the codes.
SERIES_SPREAD = (*BASIN_CODES, *COORD, "FECHA_MEDICION")

# Source column -> name in the stored table.
BASIN_PATH_NAMES = {
    "COD_CUENCA": "Cod_Cuenca", "NOM_CUENCA": "Nom_Cuenca",
    "COD_SUBCUENCA": "Cod_Subcuenca", "NOM_SUBCUENCA": "Nom_Subcuenca",
    "COD_SUBSUBCUENCA": "Cod_Subsubcuenca", "NOM_SUBSUBCUENCA": "Nom_Subsubcuenca",
}
BASIN_KEYS = {**BASIN_PATH_NAMES, "REGION": "Cod_Region"}
POINT_KEYS = {
    "UTM_NORTE": "UTM_Norte", "UTM_ESTE": "UTM_Este", "HUSO": "Huso",
    "REGION": "Region", "PROVINCIA": "Provincia", "COMUNA": "Comuna",
    **BASIN_PATH_NAMES,
    "CODIGO": "codigo",
    "COD_SECTOR_SHA": "COD_SECTOR_SHA", "SECTOR_SHA": "SECTOR_SHA",
    "APR": "APR", "ID_JUNTA": "ID_JUNTA",
    "PARTE_JUNTA": "PARTE_JUNTA", "REPRESENTA_JUNTA": "REPRESENTA_JUNTA",
    "CANAL_TRANSMISION": "CANAL_TRANSMISION",
}

# The same keys as the point catalog orders them: where a point is, and what it has besides its code.
POINT_PLACE = (
    "UTM_Norte", "UTM_Este", "Huso", "Region", "Provincia", "Comuna", *BASIN_PATH_NAMES.values(),
)
POINT_ATTRIBUTES = (
    "COD_SECTOR_SHA", "SECTOR_SHA", "APR", "ID_JUNTA", "PARTE_JUNTA", "REPRESENTA_JUNTA", "CANAL_TRANSMISION",
)

_INT, _LONG, _DOUBLE, _STR = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()

# Columns and types of the source table.
FACT = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("UTM_NORTE", _INT), ("UTM_ESTE", _INT), ("HUSO", _INT),
        ("REGION", _INT), ("PROVINCIA", _STR), ("COMUNA", _STR),
        ("COD_CUENCA", _INT), ("NOM_CUENCA", _STR),
        ("COD_SUBCUENCA", _INT), ("NOM_SUBCUENCA", _STR),
        ("COD_SUBSUBCUENCA", _INT), ("NOM_SUBSUBCUENCA", _STR),
        ("CODIGO", _STR), ("NATURALEZA", _INT),
        ("COD_SECTOR_SHA", _INT), ("SECTOR_SHA", _STR),
        ("APR", _INT), ("ID_JUNTA", _DOUBLE),
        ("PARTE_JUNTA", _INT), ("REPRESENTA_JUNTA", _INT), ("CANAL_TRANSMISION", _INT),
        ("TIPO_DERECHO", _INT),
        *((c, _DOUBLE) for c in RIGHT_AMOUNTS),
        *((c, _DOUBLE) for c in LEVELS),
        ("TOTALIZADOR", _LONG),
        ("FECHA_MEDICION", T.TimestampNTZType()),
        ("INF", _INT), ("NOMB_INF", _STR), ("A_PAT_INF", _STR), ("A_MAT_INF", _STR),
    )]
)

POINT_RIGHT_TYPES = {"TIPO_DERECHO": _INT, **{c: _DOUBLE for c in RIGHT_AMOUNTS}}
BASIN_RIGHT_TYPES = {"puntos_con_derechos": _LONG, **{c: _DOUBLE for c in BASIN_RIGHT_SUMS}}

# Columns that the reads expect of each table.
EXPECTED_COLUMNS = {
    "Puntos_Mapa": (
        "UTM_Norte", "UTM_Este", "Huso", "Region", "Cod_Cuenca", "Cod_Subcuenca",
        "Cod_Subsubcuenca", "es_pozo_subterraneo", "codigo", "caudal_promedio",
        "COD_SECTOR_SHA", "SECTOR_SHA", "APR", "ID_JUNTA",
        "PARTE_JUNTA", "REPRESENTA_JUNTA", "CANAL_TRANSMISION",
    ),
    "Series_Tiempo": (
        "UTM_NORTE", "UTM_ESTE", "FECHA_MEDICION", "CAUDAL",
        "ALTURA_LIMNIMETRICA", "NIVEL_FREATICO", "TOTALIZADOR",
        "COD_CUENCA", "NOM_CUENCA", "COD_SUBCUENCA", "NOM_SUBCUENCA",
        "COD_SUBSUBCUENCA", "NOM_SUBSUBCUENCA",
    ),
    "Mediciones_full": (
        "UTM_NORTE", "UTM_ESTE", "FECHA_MEDICION",
        "SECTOR_SHA", "APR", "ID_JUNTA", "PARTE_JUNTA",
        "REPRESENTA_JUNTA", "CANAL_TRANSMISION",
        "Cod_Cuenca", "Cod_Subcuenca", "Cod_Subsubcuenca",
    ),
}
