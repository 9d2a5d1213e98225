"""Expected result of every registered query as DuckDB SQL."""

from __future__ import annotations

from acequia.schema import EXPECTED_COLUMNS, MONTHS
from oracle.tables import (
    AMOUNTS, BASIN_RIGHTS, FLOWS, LEVELS, MONTHLY, PATH, POINT_KEYS, RIGHTS, SUMS,
    cols, with_tables,
)


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def cents(x: str) -> str:
    """Rounding to two decimals on the exact binary value, ties to even."""
    p, high = f"({x} * 100.0::double)", f"({x} * 134217729.0::double - ({x} * 134217729.0::double - {x}))"
    error = f"(({high} * 100.0::double - {p}) + ({x} - {high}) * 100.0::double)"
    half = f"({p} - floor({p}) - 0.5::double)"
    up = f"({half} > 0 OR ({half} = 0 AND ({error} > 0 OR ({error} = 0 AND floor({p}) % 2 <> 0))))"
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {up} THEN (floor({p}) + 1) / 100.0::double "
            f"ELSE floor({p}) / 100.0::double END")


def cents_or_null(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN NULL ELSE {cents(x)} END"


def text(*names: str) -> str:
    return ", ".join(f"cast({n} AS varchar) AS {n}" for n in names)


def nulls_first(*names: str) -> str:
    return ", ".join(f"{n} ASC NULLS FIRST" for n in names)


_UPPER_PATH = [c.upper() for c in PATH]
_SERIES = f"{cols(_UPPER_PATH)}, UTM_NORTE, UTM_ESTE, {text('FECHA_MEDICION')}, {r6(*LEVELS)}, TOTALIZADOR"
_POINT_ROW = (f"{cols(POINT_KEYS[:12])}, {r6(*FLOWS)}, n_mediciones, codigo, es_pozo_subterraneo, "
              f"{cols(POINT_KEYS[13:])}")
_STATS = f"{cols(PATH)}, Cod_Region, {r6(*FLOWS)}, total_puntos_unicos, total_mediciones"
_RIGHT_TYPES = {"TIPO_DERECHO": "int", **{c: "double" for c in AMOUNTS}}
_BASIN_RIGHT_TYPES = {"puntos_con_derechos": "bigint", **{c: "double" for c in SUMS}}

_ECHO = {
    "region": "int", "cod_cuenca": "int", "cod_subcuenca": "int", "cod_subsubcuenca": "int",
    "filtro_null_subcuenca": "boolean", "caudal_minimo": "double", "caudal_maximo": "double",
    "pozo": "boolean", "codigo_obra": "varchar", "shac": "int", "apr": "boolean", "id_junta": "double",
}


def count_points(where: str = "true", **given) -> str:
    def literal(v):
        if v is None:
            return "NULL"
        return f"'{v}'" if isinstance(v, str) else str(v)

    echo = ", ".join(f"cast({literal(given.get(n))} AS {t}) AS {n}" for n, t in _ECHO.items())
    return with_tables(
        f"SELECT count(*) AS total_puntos_unicos, {echo} FROM puntos_mapa WHERE {where}", "puntos_mapa")


def list_points(where: str = "true", limit: int | None = 120) -> str:
    out = ("utm_norte", "utm_este", "huso", "es_pozo_subterraneo", "cod_subsubcuenca", "sector_sha", "apr", "id_junta")
    top = f"ORDER BY {nulls_first(*out)} LIMIT {limit}" if limit is not None else ""
    return with_tables(f"""
SELECT * FROM (
 SELECT UTM_Norte AS utm_norte, UTM_Este AS utm_este, Huso AS huso, es_pozo_subterraneo,
        Cod_Subsubcuenca AS cod_subsubcuenca, SECTOR_SHA AS sector_sha, cast(APR AS boolean) AS apr,
        ID_JUNTA AS id_junta
 FROM puntos_mapa WHERE UTM_Norte IS NOT NULL AND UTM_Este IS NOT NULL AND {where}) {top}""", "puntos_mapa")


def points_by_level() -> str:
    levels = {"region": ["REGION"], "cuenca": ["COD_CUENCA"], "subcuenca": ["COD_CUENCA", "COD_SUBCUENCA"],
              "subsubcuenca": ["COD_CUENCA", "COD_SUBCUENCA", "COD_SUBSUBCUENCA"], "total": []}
    columns = ["REGION", "COD_CUENCA", "COD_SUBCUENCA", "COD_SUBSUBCUENCA"]
    return with_tables(" UNION ALL ".join(f"""
SELECT '{level}' AS nivel, {", ".join(f"{c if c in keys else 'cast(NULL AS int)'} AS {c.lower()}" for c in columns)},
       count(DISTINCT concat(UTM_NORTE, '-', UTM_ESTE)) AS total_puntos_unicos
FROM mf {"GROUP BY " + ", ".join(f"mf.{k}" for k in keys) if keys else ""}""" for level, keys in levels.items()), "mf")


def point_info(norte: int, este: int) -> str:
    out = ("utm_norte", "utm_este", "huso", "es_pozo_subterraneo", "codigo", "cod_cuenca", "cod_subcuenca",
           "cod_subsubcuenca", "nombre_cuenca", "nombre_subcuenca", "nombre_subsubcuenca", "caudal_promedio",
           "n_mediciones", "sector_sha", "apr", "id_junta", "parte_junta", "representa_junta", "canal_transmision")
    return with_tables(f"""
SELECT * FROM (
 SELECT UTM_Norte AS utm_norte, UTM_Este AS utm_este, Huso AS huso, es_pozo_subterraneo, codigo,
        Cod_Cuenca AS cod_cuenca, Cod_Subcuenca AS cod_subcuenca, Cod_Subsubcuenca AS cod_subsubcuenca,
        Nom_Cuenca AS nombre_cuenca, Nom_Subcuenca AS nombre_subcuenca, Nom_Subsubcuenca AS nombre_subsubcuenca,
        {cents("p.caudal_promedio")} AS caudal_promedio, coalesce(n_mediciones, 0) AS n_mediciones,
        SECTOR_SHA AS sector_sha, cast(APR AS boolean) AS apr, ID_JUNTA AS id_junta,
        cast(PARTE_JUNTA AS boolean) AS parte_junta, cast(REPRESENTA_JUNTA AS boolean) AS representa_junta,
        CANAL_TRANSMISION AS canal_transmision
 FROM puntos_mapa p WHERE UTM_Norte = {norte} AND UTM_Este = {este})
ORDER BY {nulls_first(*out)} LIMIT 1""", "puntos_mapa")


def metric_stats(norte: int, este: int) -> str:
    one = """
SELECT '{name}' AS metrica, count(*) AS total_registros, avg({c}) AS promedio, min({c}) AS minimo,
       max({c}) AS maximo, stddev_samp({c}) AS desviacion_estandar,
       min(FECHA_MEDICION) AS primera_fecha, max(FECHA_MEDICION) AS ultima_fecha
FROM series_tiempo WHERE UTM_NORTE = {n} AND UTM_ESTE = {e} AND {c} IS NOT NULL"""
    parts = " UNION ALL ".join(one.format(name=c.lower(), c=c, n=norte, e=este) for c in LEVELS)
    rounded = ", ".join(f"{cents_or_null(f't.{c}')} AS {c}"
                        for c in ("promedio", "minimo", "maximo", "desviacion_estandar"))
    return with_tables(f"""
SELECT cast({norte} AS int) AS utm_norte, cast({este} AS int) AS utm_este, metrica, total_registros,
       {rounded}, {text("primera_fecha", "ultima_fecha")}
FROM ({parts}) t WHERE total_registros > 0""", "series_tiempo")


def pooled_stats(locations: list[tuple[int, int]]) -> str:
    any_of = " OR ".join(f"(UTM_NORTE = {n} AND UTM_ESTE = {e})" for n, e in locations)
    names = ("caudal_promedio", "caudal_minimo", "caudal_maximo", "desviacion_estandar_caudal")
    rounded = ", ".join(f"{cents_or_null(f't.{c}')} AS {c}" for c in names)
    return with_tables(f"""
SELECT cast({len(locations)} AS int) AS puntos_consultados, total_registros_con_caudal, {rounded}
FROM (SELECT count(*) AS total_registros_con_caudal, avg(CAUDAL) AS caudal_promedio,
             min(CAUDAL) AS caudal_minimo, max(CAUDAL) AS caudal_maximo,
             stddev_samp(CAUDAL) AS desviacion_estandar_caudal
      FROM series_tiempo WHERE ({any_of}) AND CAUDAL IS NOT NULL) t""", "series_tiempo")


def pooled_stats_of_sectors() -> str:
    names = ("caudal_promedio", "caudal_minimo", "caudal_maximo", "desviacion_estandar_caudal")
    rounded = ", ".join(f"{cents_or_null(f't.{c}')} AS {c}" for c in names)
    return with_tables(f"""
SELECT (SELECT count(*)::int FROM puntos_mapa WHERE COD_SECTOR_SHA IS NOT NULL) AS puntos_consultados,
       total_registros_con_caudal, {rounded}
FROM (SELECT count(*) AS total_registros_con_caudal, avg(CAUDAL) AS caudal_promedio,
             min(CAUDAL) AS caudal_minimo, max(CAUDAL) AS caudal_maximo,
             stddev_samp(CAUDAL) AS desviacion_estandar_caudal
      FROM series_tiempo s WHERE CAUDAL IS NOT NULL AND EXISTS (
        SELECT 1 FROM puntos_mapa p WHERE p.COD_SECTOR_SHA IS NOT NULL
         AND p.UTM_Norte = s.UTM_NORTE AND p.UTM_Este = s.UTM_ESTE)) t""", "series_tiempo", "puntos_mapa")


_AREA = {
    "cuenca": ("s.COD_CUENCA", "s.NOM_CUENCA"),
    "subcuenca": ("s.COD_SUBCUENCA", "s.NOM_SUBCUENCA"),
    "subsubcuenca": ("s.COD_SUBSUBCUENCA", "s.NOM_SUBSUBCUENCA"),
    "shac": ("p.COD_SECTOR_SHA", "p.SECTOR_SHA"),
}
_METRIC = {"caudal": "CAUDAL", "altura_linimetrica": "ALTURA_LIMNIMETRICA", "nivel_freatico": "NIVEL_FREATICO"}


def _dates(start: str | None, end: str | None, column: str) -> str:
    return "".join([
        f" AND {column} >= DATE '{start}'" if start else "",
        f" AND {column} <= DATE '{end}'" if end else "",
    ])


def area_series(level, metric, identifier, start=None, end=None, well=None) -> str:
    code, name = _AREA[level]
    picked = f"{code} = {identifier}" if identifier.isdigit() else f"{name} = '{identifier}'"
    join, tables = "", ["series_tiempo"]
    if level == "shac" or well is not None:
        join = "JOIN puntos_mapa p ON s.UTM_NORTE = p.UTM_Norte AND s.UTM_ESTE = p.UTM_Este"
        tables.append("puntos_mapa")
    if well is not None:
        picked += f" AND p.es_pozo_subterraneo = {str(well).lower()}"
    c = f"s.{_METRIC[metric]}"
    more = f""", round(avg({c}), 6) AS caudal_promedio, round(sum({c}), 6) AS caudal_sumado,
       cast(sum(s.TOTALIZADOR) AS bigint) AS totalizador_sumado, max(s.TOTALIZADOR) AS totalizador_max""" \
        if metric == "caudal" else ""
    return with_tables(f"""
SELECT cast(s.FECHA_MEDICION AS varchar) AS fecha_medicion, round(avg({c}), 6) AS {metric}{more}
FROM series_tiempo s {join}
WHERE {picked} AND {c} IS NOT NULL{_dates(start, end, "s.FECHA_MEDICION")}
GROUP BY s.FECHA_MEDICION ORDER BY s.FECHA_MEDICION DESC NULLS LAST""", *tables)


def point_series(metric, norte, este, start=None, end=None) -> str:
    c = _METRIC[metric]
    more = f""", round({c}, 6) AS caudal_promedio, round({c}, 6) AS caudal_sumado,
       TOTALIZADOR AS totalizador_sumado, TOTALIZADOR AS totalizador_max""" if metric == "caudal" else ""
    return with_tables(f"""
SELECT cast(FECHA_MEDICION AS varchar) AS fecha_medicion, round({c}, 6) AS {metric}{more}
FROM series_tiempo s WHERE UTM_NORTE = {norte} AND UTM_ESTE = {este} AND {c} IS NOT NULL{_dates(start, end, "s.FECHA_MEDICION")}
ORDER BY s.FECHA_MEDICION DESC NULLS LAST""", "series_tiempo")


def point_series_count(metric, norte, este) -> str:
    return with_tables(f"""
SELECT count(*) AS total FROM series_tiempo
WHERE UTM_NORTE = {norte} AND UTM_ESTE = {este} AND {_METRIC[metric]} IS NOT NULL""", "series_tiempo")


def _point_right(norte, este) -> str:
    return f"""(SELECT {", ".join(RIGHTS)} FROM puntos_mapa
WHERE UTM_Norte = {norte} AND UTM_Este = {este} AND TIPO_DERECHO IS NOT NULL
ORDER BY {nulls_first(*RIGHTS)} LIMIT 1)"""


def point_rights(norte, este) -> str:
    return with_tables(f"""
SELECT TIPO_DERECHO AS tipo_derecho,
       CASE TIPO_DERECHO WHEN 1 THEN 'Consuntivo' WHEN 2 THEN 'No Consuntivo' ELSE 'Desconocido' END AS tipo_derecho_label,
       round(VOLUMEN_ANUAL, 6) AS volumen_anual,
       {", ".join(f"round({c}, 6) AS {c.lower()}" for c in MONTHLY)}
FROM {_point_right(norte, este)}""", "puntos_mapa")


def _months(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT cast({i} AS int) AS n_mes, '{m}' AS mes, round({c}, 6) AS caudal FROM {source}"
        for i, (m, c) in enumerate(zip(MONTHS, columns), start=1))


def _basin_right(where: str) -> str:
    """Sums of the basin rights, all 0 when no point has one."""
    sums = cols(BASIN_RIGHTS, "sum(coalesce({0}, 0)) AS {0}")
    zeroed = cols(SUMS, "CASE WHEN puntos_con_derechos = 0 THEN 0.0::double ELSE {0} END AS {0}")
    return f"""(SELECT cast(puntos_con_derechos AS bigint) AS puntos_con_derechos, {zeroed}
FROM (SELECT {sums} FROM cuenca_stats WHERE {where}))"""


def basin_rights(where: str) -> str:
    return with_tables(f"SELECT puntos_con_derechos, {r6(*SUMS)} FROM {_basin_right(where)}", "cuenca_stats")


def list_reporters(where: str = "true", limit: int | None = 100) -> str:
    top = f"ORDER BY {nulls_first('nombre_completo', 'cantidad_reportes', 'ultima_fecha_medicion')} LIMIT {limit}" \
        if limit is not None else ""
    return with_tables(f"""
SELECT * FROM (
 SELECT {_NAME} AS nombre_completo, coalesce(CANTIDAD_REPORTES, 0) AS cantidad_reportes,
        cast(ULTIMA_FECHA_MEDICION AS varchar) AS ultima_fecha_medicion
 FROM informante WHERE {where}) {top}""", "informante")


_TRIM = r"nullif(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '')"
_NAME = ("coalesce(nullif(concat_ws(' ', " + ", ".join(_TRIM.format(c) for c in ("NOMB_INF", "A_PAT_INF", "A_MAT_INF"))
         + "), ''), 'Desconocido')")


def coverage(table: str, label: str, expected) -> str:
    return " UNION ALL ".join(
        f"SELECT '{label}' AS tabla, '{c}' AS columna, true AS presente, count({c}) AS no_nulos FROM {table}"
        for c in expected)


def basin_stats(where: str = "true", with_global: bool = False) -> str:
    glob = ""
    if with_global:
        glob = ", " + ", ".join(
            f"(SELECT {cents('g.x')} FROM (SELECT {f}({c}) AS x FROM cuenca_stats WHERE caudal_promedio IS NOT NULL) g)"
            f" AS global_{n}"
            for n, f, c in (("promedio", "avg", "caudal_promedio"), ("minimo", "min", "caudal_minimo"),
                            ("maximo", "max", "caudal_maximo")))
    lower = ", ".join(f"{c} AS {c.lower()}" for c in [*PATH, "Cod_Region"])
    return with_tables(f"""
SELECT {lower}, {", ".join(f"{cents(f'c.{f}')} AS {f}" for f in FLOWS[:3])},
       total_puntos_unicos, total_mediciones{glob}
FROM cuenca_stats c WHERE {where}""", "cuenca_stats")


def filter_rows(columns: str, where: str = "true") -> str:
    return with_tables(f"""
SELECT {columns}, {cents("f.avgMin")} AS avgMin, {cents("f.avgMax")} AS avgMax, total_puntos
FROM filtros f WHERE {where}""", "filtros")


def sectors(where: str = "true") -> str:
    return with_tables(f"""
SELECT COD_SECTOR_SHA AS cod_sector_sha, SECTOR_SHA AS sector_sha, count(*) AS total_puntos
FROM puntos_mapa WHERE COD_SECTOR_SHA IS NOT NULL AND {where}
GROUP BY COD_SECTOR_SHA, SECTOR_SHA""", "puntos_mapa")


_TABLE_TEXT = {
    "datos": with_tables(f"""
SELECT * REPLACE ({text("Fecha_Medicion")}) FROM datos""", "datos"),
    "cuencas_regiones": with_tables("SELECT * FROM cuencas_regiones", "cuencas_regiones"),
    "informante": with_tables(f"""
SELECT * EXCLUDE (ULTIMA_FECHA_MEDICION), {text("ULTIMA_FECHA_MEDICION")} FROM informante""", "informante"),
    "puntos_mapa": with_tables(f"SELECT {_POINT_ROW}, TIPO_DERECHO, {r6(*AMOUNTS)} FROM puntos_mapa", "puntos_mapa"),
    "series_tiempo": with_tables(f"SELECT {_SERIES} FROM series_tiempo", "series_tiempo"),
    "cuenca_stats": with_tables(
        f"SELECT {_STATS}, puntos_con_derechos, {r6(*SUMS)} FROM cuenca_stats", "cuenca_stats"),
    "filtros": with_tables("SELECT * FROM filtros", "filtros"),
}

_RIGHTS_PER_BASIN = with_tables(
    f"SELECT COD_CUENCA, COD_SUBCUENCA, COD_SUBSUBCUENCA, REGION, puntos_con_derechos, {r6(*SUMS)} "
    "FROM derechos_cuenca", "derechos_cuenca")
_RIGHTS_PER_COORD = with_tables(
    f"SELECT UTM_NORTE, UTM_ESTE, TIPO_DERECHO, {r6(*AMOUNTS)} FROM derechos_coordenada", "derechos_coordenada")

def _points_updated(which: str) -> str:
    """Points whose rights were NULL, after an update of some of them."""
    return with_tables(f"""
SELECT {", ".join(f"p.{c} AS {c}" for c in POINT_KEYS)},
       {", ".join(f"round(p.{c}, 6) AS {c}" for c in FLOWS)}, p.n_mediciones AS n_mediciones,
       p.es_pozo_subterraneo AS es_pozo_subterraneo, d.TIPO_DERECHO AS TIPO_DERECHO,
       {", ".join(f"round(d.{c}, 6) AS {c}" for c in AMOUNTS)}
FROM puntos_mapa p LEFT JOIN derechos_coordenada d
  ON p.UTM_Norte = d.UTM_NORTE AND p.UTM_Este = d.UTM_ESTE AND {which}
""", "puntos_mapa", "derechos_coordenada")


def _basins_updated(which: str) -> str:
    return with_tables(f"""
SELECT {", ".join(f"c.{n} AS {n}" for n in PATH)}, c.Cod_Region AS Cod_Region,
       {", ".join(f"round(c.{n}, 6) AS {n}" for n in FLOWS)},
       c.total_puntos_unicos AS total_puntos_unicos, c.total_mediciones AS total_mediciones,
       d.puntos_con_derechos AS puntos_con_derechos, {", ".join(f"round(d.{n}, 6) AS {n}" for n in SUMS)}
FROM cuenca_stats c LEFT JOIN derechos_cuenca d
  ON c.Cod_Cuenca = d.COD_CUENCA AND c.Cod_Subcuenca = d.COD_SUBCUENCA
 AND c.Cod_Subsubcuenca = d.COD_SUBSUBCUENCA AND c.Cod_Region = d.REGION AND {which}
""", "cuenca_stats", "derechos_cuenca")


_WELL_115 = "Cod_Cuenca = 115 AND es_pozo_subterraneo AND codigo LIKE '%OB-%' AND APR = 0"


def oracle_sql() -> dict[str, str]:
    sql = {
        # Sources, sinks, updates.
        "fact_scan": with_tables(f"""
SELECT * REPLACE ({text("FECHA_MEDICION")}) FROM mf""", "mf"),
        "fact_row_count": with_tables("SELECT count(*) AS total_records FROM mf", "mf"),
        "gold_write_roundtrip": _TABLE_TEXT["puntos_mapa"],
        "points_add_rights_columns": with_tables(f"""
SELECT {_POINT_ROW}, {", ".join(f"cast(NULL AS {t}) AS {c}" for c, t in _RIGHT_TYPES.items())}
FROM puntos_mapa""", "puntos_mapa"),
        "points_rights_update": _points_updated("true"),
        "basin_rights_update": _basins_updated("true"),
        "points_rights_update_basin": _points_updated("p.Cod_Cuenca = 115"),
        "basin_rights_update_basin": _basins_updated("c.Cod_Cuenca = 115"),
        "csv_roundtrip": list_reporters(limit=None),
        "create_once": _TABLE_TEXT["cuencas_regiones"],

        # Builds from the fact.
        "build_measurements": _TABLE_TEXT["datos"],
        "build_basin_catalog": _TABLE_TEXT["cuencas_regiones"],
        "build_reporters": _TABLE_TEXT["informante"],
        "build_points": _TABLE_TEXT["puntos_mapa"],
        "build_points_by_coord": with_tables(f"""
SELECT {cols(POINT_KEYS)}, {r6(*FLOWS)}, n_mediciones, TIPO_DERECHO, {r6(*AMOUNTS)}
FROM puntos_por_coordenada""", "puntos_por_coordenada"),
        "build_daily_series": _TABLE_TEXT["series_tiempo"],
        "build_daily_series_by_coord": with_tables(
            f"SELECT {_SERIES} FROM series_por_coordenada", "series_por_coordenada"),
        "rights_per_point": with_tables(f"""
SELECT * FROM derechos_punto""", "derechos_punto"),
        "rights_per_basin": _RIGHTS_PER_BASIN,
        "rollup_rights_per_basin": _RIGHTS_PER_BASIN,
        "rights_per_coord": _RIGHTS_PER_COORD,
        "rollup_rights_per_coord": _RIGHTS_PER_COORD,
        "build_basin_stats": _TABLE_TEXT["cuenca_stats"],
        "build_filter_stats": _TABLE_TEXT["filtros"],
        "build_filter_stats_gsets": _TABLE_TEXT["filtros"],

        # The stored tables, as a refresh writes them.
        "scan_measurements": _TABLE_TEXT["datos"],
        "scan_basin_catalog": _TABLE_TEXT["cuencas_regiones"],
        "scan_reporters": _TABLE_TEXT["informante"],
        "scan_points": _TABLE_TEXT["puntos_mapa"],
        "scan_daily_series": _TABLE_TEXT["series_tiempo"],
        "scan_basin_stats": _TABLE_TEXT["cuenca_stats"],
        "scan_filter_stats": _TABLE_TEXT["filtros"],

        # Points.
        "points_count": count_points(),
        "points_count_filtered": count_points(
            "Region = 1 AND caudal_promedio >= 20.0 AND caudal_promedio <= 30.0 AND NOT es_pozo_subterraneo "
            "AND COD_SECTOR_SHA = 121 AND ID_JUNTA = 1.0",
            region=1, caudal_minimo=20.0, caudal_maximo=30.0, pozo=False, shac=121, id_junta=1.0),
        "points_count_null_subbasin": count_points(
            "Cod_Cuenca = 115 AND Cod_Subcuenca IS NULL",
            cod_cuenca=115, cod_subcuenca=11500, filtro_null_subcuenca=True),
        "points_count_path": count_points(
            "Cod_Subcuenca = 11500 AND Cod_Subsubcuenca = 115000 AND APR = 1",
            cod_subcuenca=11500, cod_subsubcuenca=115000, apr=True),
        "points_list": list_points(_WELL_115),
        "points_list_default": list_points(),
        "points_list_text": list_points("codigo LIKE '%B-1%'", None),
        "points_count_text": count_points("codigo LIKE '%-2-1%'", codigo_obra="-2-1"),
        "points_by_level": points_by_level(),
        "points_list_class": list_points("regexp_matches(codigo, 'OB-[1-3].-[^0]')", None),
        "points_list_wildcard": list_points("codigo LIKE '%OB-_1-%'", None),
        "point_info": point_info(6000000, 300000),
        "multi_point_flow_stats_table": pooled_stats_of_sectors(),
        "point_metric_stats": metric_stats(6000000, 300000),
        "multi_point_flow_stats": pooled_stats([(6000000, 300000), (6000100, 301000), (6000000, 300000)]),
        "valid_locations": with_tables("""
SELECT DISTINCT UTM_Norte AS UTM_Norte, UTM_Este AS UTM_Este,
       coalesce(UTM_Norte BETWEEN 0 AND 10000000 AND UTM_Este BETWEEN 0 AND 1000000, false) AS es_valida
FROM puntos_mapa""", "puntos_mapa"),
        "valid_locations_range": """
SELECT o_orderkey, o_orderkey * 1000 AS UTM_NORTE, o_custkey * 1000 AS UTM_ESTE,
       (o_orderkey * 1000 BETWEEN 0 AND 10000000) AND (o_custkey * 1000 BETWEEN 0 AND 1000000) AS es_valida
FROM orders""",
        "admin_divisions": with_tables("""
SELECT DISTINCT Region AS region, Provincia AS provincia, Comuna AS comuna
FROM puntos_mapa WHERE Region IS NOT NULL""", "puntos_mapa"),
        "distinct_regions": with_tables(
            "SELECT DISTINCT Region AS region FROM puntos_mapa WHERE Region IS NOT NULL", "puntos_mapa"),
        "points_total": with_tables("SELECT count(*) AS total_puntos_unicos FROM puntos_mapa", "puntos_mapa"),
        "points_lonlat": with_tables("""
SELECT UTM_Norte AS utm_norte, UTM_Este AS utm_este, codigo,
       CASE WHEN UTM_Norte IS NOT NULL AND UTM_Este IS NOT NULL THEN
         round(-69.0 + (UTM_Este - 500000) / (111320 * cos(radians((UTM_Norte - 10000000) / 111320::double))), 6)
       END AS longitud,
       CASE WHEN UTM_Norte IS NOT NULL AND UTM_Este IS NOT NULL THEN
         round((UTM_Norte - 10000000) / 111320::double, 6) END AS latitud
FROM puntos_mapa""", "puntos_mapa"),

        # Basins, sectors, boards, ranges.
        "basin_list": with_tables(
            f"SELECT {', '.join(f'{c} AS {c.lower()}' for c in [*PATH, 'Cod_Region'])} FROM cuencas_regiones",
            "cuencas_regiones"),
        "sector_list": sectors(),
        "sector_list_filtered": sectors("Region = 1 AND Cod_Cuenca = 115 AND Cod_Subcuenca = 11500"),
        "board_list": with_tables("""
SELECT ID_JUNTA AS id_junta, count(*) AS total_puntos FROM puntos_mapa
WHERE ID_JUNTA IS NOT NULL GROUP BY ID_JUNTA""", "puntos_mapa"),
        "filter_stats_read": filter_rows("nivel, nom_cuenca, nom_subcuenca"),
        "filter_stats_basin": filter_rows("nom_cuenca", "nivel = 'cuenca'"),
        "filter_stats_subbasin": filter_rows("nom_cuenca, nom_subcuenca", "nivel = 'subcuenca'"),
        "basin_stats": basin_stats("Cod_Cuenca = 115"),
        "basin_stats_path": basin_stats(
            "Cod_Cuenca = 115 AND Cod_Subcuenca = 11500 AND Cod_Subsubcuenca = 115000"),
        "basin_stats_global": basin_stats("true", with_global=True),
        "basin_subbasin_names": with_tables("""
SELECT Cod_Cuenca AS cod_cuenca, string_agg(Nom_Subcuenca, ', ' ORDER BY Nom_Subcuenca) AS subcuencas
FROM (SELECT DISTINCT Cod_Cuenca, Nom_Subcuenca FROM cuencas_regiones WHERE Nom_Subcuenca IS NOT NULL)
GROUP BY Cod_Cuenca""", "cuencas_regiones"),

        # Rights and reporters.
        "point_rights": point_rights(6000000, 300000),
        "point_rights_unknown_type": point_rights(6000200, 300000),
        "point_rights_monthly": with_tables(_months(_point_right(6000000, 300000), MONTHLY), "puntos_mapa"),
        "basin_rights": basin_rights("Cod_Cuenca = 115"),
        "basin_rights_unknown": basin_rights("Cod_Cuenca = -1"),
        "basin_rights_monthly": with_tables(_months(_basin_right("Cod_Cuenca = 115"), SUMS[1:]), "cuenca_stats"),
        "subbasin_rights": basin_rights("Cod_Cuenca = 115 AND Cod_Subcuenca = 11500"),
        "reporters_list": list_reporters(),
        "reporters_list_basin": list_reporters(
            "COD_CUENCA = 115 AND COD_SUBCUENCA = 11500 AND COD_SUBSUBCUENCA = 115000", None),
        "reporters_list_point": list_reporters("UTM_NORTE = 6000000 AND UTM_ESTE = 300000", 10),
        "reporter_full_names": with_tables(f"""
SELECT DISTINCT NOMB_INF, A_PAT_INF, A_MAT_INF, {_NAME} AS nombre_completo FROM informante""", "informante"),

        # Checks and the request log.
        "column_coverage": with_tables(" UNION ALL ".join([
            coverage(table, label, EXPECTED_COLUMNS[label])
            for table, label in (("puntos_mapa", "Puntos_Mapa"), ("series_tiempo", "Series_Tiempo"),
                                 ("mf", "Mediciones_full"))] + [coverage("puntos_mapa", "Puntos_Mapa_sin_APR", ["UTM_Norte"]), """
SELECT 'Puntos_Mapa_sin_APR' AS tabla, 'APR' AS columna, false AS presente, cast(NULL AS bigint) AS no_nulos"""]),
            "puntos_mapa", "series_tiempo"),
        "points_sample": with_tables(f"""
SELECT COD_SECTOR_SHA, SECTOR_SHA, APR, ID_JUNTA, CANAL_TRANSMISION FROM puntos_mapa
WHERE COD_SECTOR_SHA IS NOT NULL OR APR IS NOT NULL
ORDER BY {nulls_first("COD_SECTOR_SHA", "SECTOR_SHA", "APR", "ID_JUNTA", "CANAL_TRANSMISION")} LIMIT 5
""", "puntos_mapa"),
        "measurements_sample": with_tables(f"""
SELECT * REPLACE ({text("Fecha_Medicion")})
FROM (SELECT * FROM datos ORDER BY {nulls_first("UTM_Norte", "UTM_Este", "Huso", "Caudal", "Altura_Limnimetrica",
      "Totalizador", "Nivel_Freatico", "Fecha_Medicion", "es_pozo_subterraneo")} LIMIT 1)""", "datos"),
        "series_sample": with_tables(f"""
SELECT {_SERIES} FROM (SELECT * FROM series_tiempo ORDER BY {nulls_first(*_UPPER_PATH, "UTM_NORTE", "UTM_ESTE",
      "FECHA_MEDICION", *LEVELS, "TOTALIZADOR")} LIMIT 2)""", "series_tiempo"),
        "point_coverage": with_tables("""
SELECT w.utm_norte, w.utm_este, coalesce(d.n, 0) AS n_datos, coalesce(s.n, 0) AS n_series
FROM (SELECT DISTINCT UTM_NORTE AS utm_norte, UTM_ESTE AS utm_este FROM mf WHERE SECTOR_SHA LIKE '%tor 1%') w
LEFT JOIN (SELECT UTM_Norte, UTM_Este, count(*) AS n FROM datos GROUP BY ALL) d
  ON w.utm_norte = d.UTM_Norte AND w.utm_este = d.UTM_Este
LEFT JOIN (SELECT UTM_NORTE, UTM_ESTE, count(*) AS n FROM series_tiempo GROUP BY ALL) s
  ON w.utm_norte = s.UTM_NORTE AND w.utm_este = s.UTM_ESTE""", "datos", "series_tiempo"),
        "sectors_with_data": with_tables("""
SELECT DISTINCT p.COD_SECTOR_SHA AS cod_sector_sha, p.SECTOR_SHA AS sector_sha
FROM series_tiempo s JOIN puntos_mapa p ON s.UTM_NORTE = p.UTM_Norte AND s.UTM_ESTE = p.UTM_Este
WHERE p.COD_SECTOR_SHA IS NOT NULL""", "series_tiempo", "puntos_mapa"),
        "latency_by_endpoint": with_tables("""
SELECT method, endpoint, round(avg(time_ms), 6) AS avg_time, count(*) AS n_requests,
       count(*) FILTER (status BETWEEN 200 AND 299) AS pass_count
FROM registro GROUP BY method, endpoint""", "registro"),
        "latency_overall": with_tables("""
SELECT count(DISTINCT run_id) AS total_runs, count(*) AS total_tests,
       count(*) FILTER (status BETWEEN 200 AND 299) AS pass_count,
       count(*) FILTER (status NOT BETWEEN 200 AND 299) AS fail_count,
       round(count(*) FILTER (status BETWEEN 200 AND 299) / count(*) * 100, 6) AS success_rate,
       round(avg(time_ms), 6) AS avg_time
FROM registro""", "registro"),
        "latency_top5": with_tables("""
SELECT round(time_ms, 6) AS time_ms, method, endpoint, run_id, status,
       CASE WHEN status BETWEEN 200 AND 299 THEN 'PASS' ELSE 'FAIL' END AS result
FROM registro ORDER BY time_ms DESC, method, endpoint, run_id, status LIMIT 5""", "registro"),
    }

    by_code = nulls_first("cod_cuenca", "cod_subcuenca", "cod_subsubcuenca")
    sql.update({
        # Of rows that tie in the order all columns are equal, or all tied rows are taken.
        "basin_list_first": f"SELECT * FROM ({sql['basin_list']}) ORDER BY {by_code} LIMIT 5",
        "basin_stats_first": f"SELECT * FROM ({basin_stats()}) ORDER BY {by_code} LIMIT 7",
        "sector_list_first": f"SELECT * FROM ({sectors()}) ORDER BY {nulls_first('cod_sector_sha')} LIMIT 2",
        "filter_stats_first": f"""SELECT * FROM ({sql['filter_stats_read']})
ORDER BY CASE nivel WHEN 'global' THEN 1 WHEN 'cuenca' THEN 2 ELSE 3 END, {nulls_first('nom_cuenca', 'nom_subcuenca')} LIMIT 30""",
        "series_basin_flow_first":
            f"SELECT * FROM ({area_series('cuenca', 'caudal', '115')}) ORDER BY fecha_medicion DESC LIMIT 3",
        "series_point_flow_first":
            f"SELECT * FROM ({point_series('caudal', 6000000, 300000)}) ORDER BY fecha_medicion DESC LIMIT 3",
    })

    series = {
        "series_basin_flow": ("cuenca", "caudal", "115"),
        "series_basin_flow_by_name": ("cuenca", "caudal", "NATION_15"),
        "series_basin_flow_dated": ("cuenca", "caudal", "115", "1996-01-01", "1999-12-31"),
        "series_basin_flow_well": ("cuenca", "caudal", "115", None, None, True),
        "series_basin_gauge": ("cuenca", "altura_linimetrica", "115"),
        "series_basin_gauge_surface": ("cuenca", "altura_linimetrica", "115", None, None, False),
        "series_basin_table": ("cuenca", "nivel_freatico", "115"),
        "series_subbasin_flow": ("subcuenca", "caudal", "11500"),
        "series_subbasin_flow_well_dated": ("subcuenca", "caudal", "11500", "1995-01-01", None, True),
        "series_subbasin_gauge": ("subcuenca", "altura_linimetrica", "11500"),
        "series_subbasin_table": ("subcuenca", "nivel_freatico", "NATION_15 sub 0"),
        "series_subsubbasin_flow": ("subsubcuenca", "caudal", "115000"),
        "series_subsubbasin_gauge": ("subsubcuenca", "altura_linimetrica", "115000"),
        "series_subsubbasin_table": ("subsubcuenca", "nivel_freatico", "115000"),
        "series_subsubbasin_table_well": ("subsubcuenca", "nivel_freatico", "115000", None, None, True),
        "series_sector_flow": ("shac", "caudal", "121"),
        "series_sector_flow_by_name": ("shac", "caudal", "Sector 1"),
        "series_sector_flow_well": ("shac", "caudal", "121", None, None, True),
        "series_sector_gauge": ("shac", "altura_linimetrica", "121"),
        "series_sector_table": ("shac", "nivel_freatico", "121"),
        "series_sector_table_dated": ("shac", "nivel_freatico", "121", None, "1997-06-30"),
    }
    sql.update({key: area_series(*given) for key, given in series.items()})
    sql.update({
        "series_point_flow": point_series("caudal", 6000000, 300000),
        "series_point_flow_dated": point_series("caudal", 6000000, 300000, "1996-01-01", "1999-12-31"),
        "series_point_gauge": point_series("altura_linimetrica", 6000000, 300000),
        "series_point_table": point_series("nivel_freatico", 6000000, 300000),
        "series_point_gauge_count": point_series_count("altura_linimetrica", 6000000, 300000),
        "series_point_table_count": point_series_count("nivel_freatico", 6000000, 300000),
    })
    merged = {
        "merged_measurements": "scan_measurements",
        "merged_basin_catalog": "scan_basin_catalog",
        "merged_reporters": "scan_reporters",
        "merged_points": "scan_points",
        "merged_daily_series": "scan_daily_series",
        "merged_basin_stats": "scan_basin_stats",
        "merged_filter_stats": "scan_filter_stats",
        "merged_series_sector_flow": "series_sector_flow",
        "merged_series_point_flow": "series_point_flow",
        "merged_points_by_level": "points_by_level",
        "merged_points_text": "points_list_text",
        "merged_fact_row_count": "fact_row_count",
    }
    sql.update({key: sql[same] for key, same in merged.items()})
    return sql
