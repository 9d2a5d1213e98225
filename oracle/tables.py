"""The fact and the derived tables as SQL, each as one common table expression."""

from __future__ import annotations

from acequia.schema import MONTHS

MONTHLY = [f"CAUDAL_{m.upper()}" for m in MONTHS]
AMOUNTS = ["VOLUMEN_ANUAL", *MONTHLY]
RIGHTS = ["TIPO_DERECHO", *AMOUNTS]
SUMS = ["volumen_anual_total", *(f"caudal_{m}_sum" for m in MONTHS)]
BASIN_RIGHTS = ["puntos_con_derechos", *SUMS]
PATH = ["Cod_Cuenca", "Nom_Cuenca", "Cod_Subcuenca", "Nom_Subcuenca", "Cod_Subsubcuenca", "Nom_Subsubcuenca"]
POINT_KEYS = ["UTM_Norte", "UTM_Este", "Huso", "Region", "Provincia", "Comuna", *PATH, "codigo",
              "COD_SECTOR_SHA", "SECTOR_SHA", "APR", "ID_JUNTA", "PARTE_JUNTA", "REPRESENTA_JUNTA",
              "CANAL_TRANSMISION"]
FLOWS = ["caudal_promedio", "caudal_minimo", "caudal_maximo", "caudal_desviacion_estandar"]
LEVELS = ["CAUDAL", "ALTURA_LIMNIMETRICA", "NIVEL_FREATICO"]


def cols(names, pattern="{0} AS {0}") -> str:
    return ", ".join(pattern.format(n) for n in names)


def _right(i: int, name: str) -> str:
    return f"CASE WHEN s % 4 = 3 THEN NULL ELSE cast(s + k + {i} * 0.5 AS double) END AS {name}"


_NO_SUB = "s % 17 = 16 OR s % 3 = 2"
_FLOW_AGGREGATES = (
    "avg(CAUDAL) AS caudal_promedio, min(CAUDAL) AS caudal_minimo, max(CAUDAL) AS caudal_maximo, "
    "stddev_samp(CAUDAL) AS caudal_desviacion_estandar"
)
_POINTS = "count(DISTINCT concat(UTM_NORTE, '-', UTM_ESTE))"

# Name -> (tables it reads, text).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "mf": ((), f"""
SELECT
 CASE WHEN l_orderkey % 997 = 0 THEN NULL ELSE cast(6000000 + s * 100 AS int) END AS UTM_NORTE,
 cast(300000 + k * 1000 AS int) AS UTM_ESTE,
 cast(18 + s % 2 AS int) AS HUSO,
 cast(n_regionkey + 1 AS int) AS REGION,
 n_name AS PROVINCIA,
 n_name || '-' || cast(s % 3 AS varchar) AS COMUNA,
 CASE WHEN s % 17 = 16 THEN NULL ELSE cast(100 + s_nationkey AS int) END AS COD_CUENCA,
 CASE WHEN s % 17 = 16 THEN NULL ELSE n_name END AS NOM_CUENCA,
 CASE WHEN {_NO_SUB} THEN NULL ELSE cast((100 + s_nationkey) * 100 + s % 3 AS int) END AS COD_SUBCUENCA,
 CASE WHEN {_NO_SUB} THEN NULL ELSE n_name || ' sub ' || cast(s % 3 AS varchar) END AS NOM_SUBCUENCA,
 CASE WHEN {_NO_SUB} OR k = 3 THEN NULL
      ELSE cast(((100 + s_nationkey) * 100 + s % 3) * 10 + k AS int) END AS COD_SUBSUBCUENCA,
 CASE WHEN {_NO_SUB} OR k = 3 THEN NULL
      ELSE n_name || ' subsub ' || cast(k AS varchar)
           || CASE WHEN l_orderkey % 991 = 0 THEN ' (alt)' ELSE '' END END AS NOM_SUBSUBCUENCA,
 'OB-' || cast(s AS varchar) || '-' || cast(k AS varchar) AS CODIGO,
 cast(CASE WHEN k < 2 THEN 1 ELSE 2 END AS int) AS NATURALEZA,
 CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE cast(120 + s_suppkey % 5 AS int) END AS COD_SECTOR_SHA,
 CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE 'Sector ' || cast(s_suppkey % 5 AS varchar) END AS SECTOR_SHA,
 CASE WHEN k = 2 THEN NULL ELSE cast(s % 2 AS int) END AS APR,
 CASE WHEN s_suppkey % 7 > 3 THEN NULL ELSE cast(s_suppkey % 7 AS double) END AS ID_JUNTA,
 CASE WHEN s_suppkey % 7 <= 3 THEN cast(k % 2 AS int) END AS PARTE_JUNTA,
 CASE WHEN s_suppkey % 7 > 3 THEN NULL ELSE cast(s_suppkey % 2 AS int) END AS REPRESENTA_JUNTA,
 cast(s % 4 AS int) AS CANAL_TRANSMISION,
 cast(CASE s % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 99 ELSE NULL END AS int) AS TIPO_DERECHO,
 CASE WHEN s % 4 = 3 THEN NULL ELSE cast(s * 1000 + k * 10 AS double) END AS VOLUMEN_ANUAL,
 {", ".join(_right(i, c) for i, c in enumerate(MONTHLY))},
 CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS CAUDAL,
 CASE WHEN l_returnflag = 'R' THEN l_tax * 100 ELSE NULL END AS ALTURA_LIMNIMETRICA,
 CASE WHEN k < 2 THEN l_discount * 100 ELSE NULL END AS NIVEL_FREATICO,
 cast(floor(l_extendedprice) AS bigint) AS TOTALIZADOR,
 CASE WHEN l_orderkey % 499 = 0 THEN NULL ELSE l_shipdate END AS FECHA_MEDICION,
 CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE cast(o_custkey % 10 AS int) END AS INF,
 CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE 'Inf' || cast(o_custkey % 10 AS varchar) END AS NOMB_INF,
 CASE WHEN o_custkey % 10 = 0 THEN '  ' WHEN o_custkey IS NOT NULL THEN ' Perez ' END AS A_PAT_INF,
 CASE WHEN o_custkey % 10 >= 5 THEN 'Soto' END AS A_MAT_INF
FROM (SELECT l.*, l_suppkey AS s, l_partkey % 4 AS k FROM lineitem l
      UNION ALL
      SELECT l.*, l_suppkey AS s, l_partkey % 4 AS k FROM lineitem l WHERE l_orderkey % 50 = 0) l
LEFT JOIN orders ON l_orderkey = o_orderkey
LEFT JOIN supplier ON s_suppkey = s
LEFT JOIN nation ON n_nationkey = s_nationkey"""),

    "datos": (("mf",), """
SELECT DISTINCT UTM_NORTE AS UTM_Norte, UTM_ESTE AS UTM_Este, HUSO AS Huso, CAUDAL AS Caudal,
       ALTURA_LIMNIMETRICA AS Altura_Limnimetrica, TOTALIZADOR AS Totalizador,
       NIVEL_FREATICO AS Nivel_Freatico, FECHA_MEDICION AS Fecha_Medicion,
       CASE WHEN NATURALEZA = 1 THEN true ELSE false END AS es_pozo_subterraneo
FROM mf"""),

    "cuencas_regiones": (("mf",), f"""
SELECT DISTINCT {cols(PATH)}, REGION AS Cod_Region FROM mf WHERE COD_CUENCA IS NOT NULL"""),

    "informante": (("mf",), """
SELECT UTM_NORTE, UTM_ESTE, NOMB_INF, A_PAT_INF, A_MAT_INF, COD_CUENCA, COD_SUBCUENCA, COD_SUBSUBCUENCA,
       count(*) AS CANTIDAD_REPORTES, max(FECHA_MEDICION) AS ULTIMA_FECHA_MEDICION
FROM mf WHERE INF IS NOT NULL GROUP BY ALL"""),

    "puntos_mapa": (("mf",), f"""
SELECT {cols(POINT_KEYS)}, {_FLOW_AGGREGATES}, count(*) AS n_mediciones,
       coalesce(max(NATURALEZA) = 1, false) AS es_pozo_subterraneo, {cols(RIGHTS, "max({0}) AS {0}")}
FROM mf GROUP BY {", ".join(f"mf.{c}" for c in POINT_KEYS)}"""),

    "puntos_por_coordenada": (("mf",), f"""
SELECT UTM_NORTE AS UTM_Norte, UTM_ESTE AS UTM_Este, {cols(POINT_KEYS[2:], "max({0}) AS {0}")},
       {_FLOW_AGGREGATES}, count(*) AS n_mediciones, {cols(RIGHTS, "max({0}) AS {0}")}
FROM mf WHERE UTM_NORTE IS NOT NULL AND UTM_ESTE IS NOT NULL GROUP BY mf.UTM_NORTE, mf.UTM_ESTE"""),

    "series_tiempo": (("mf",), f"""
SELECT {cols([c.upper() for c in PATH])}, UTM_NORTE, UTM_ESTE,
       cast(FECHA_MEDICION AS date) AS FECHA_MEDICION,
       {cols(LEVELS, "avg({0}) AS {0}")}, max(TOTALIZADOR) AS TOTALIZADOR
FROM mf GROUP BY {", ".join(f"mf.{c}" for c in PATH)}, mf.UTM_NORTE, mf.UTM_ESTE, cast(mf.FECHA_MEDICION AS date)"""),

    "series_por_coordenada": (("mf",), f"""
SELECT {cols([c.upper() for c in PATH], "max({0}) AS {0}")}, UTM_NORTE, UTM_ESTE,
       cast(FECHA_MEDICION AS date) AS FECHA_MEDICION,
       {cols(LEVELS, "avg({0}) AS {0}")}, max(TOTALIZADOR) AS TOTALIZADOR
FROM mf WHERE UTM_NORTE IS NOT NULL AND UTM_ESTE IS NOT NULL AND mf.FECHA_MEDICION IS NOT NULL
GROUP BY mf.UTM_NORTE, mf.UTM_ESTE, cast(mf.FECHA_MEDICION AS date)"""),

    "derechos_punto": (("mf",), f"""
SELECT COD_CUENCA, COD_SUBCUENCA, COD_SUBSUBCUENCA, REGION, UTM_NORTE, UTM_ESTE, {cols(AMOUNTS, "max({0}) AS {0}")}
FROM mf WHERE mf.TIPO_DERECHO IS NOT NULL
GROUP BY COD_CUENCA, COD_SUBCUENCA, COD_SUBSUBCUENCA, REGION, UTM_NORTE, UTM_ESTE"""),

    "derechos_cuenca": (("derechos_punto",), f"""
SELECT COD_CUENCA, COD_SUBCUENCA, COD_SUBSUBCUENCA, REGION, count(*) AS puntos_con_derechos,
       {", ".join(f"sum({a}) AS {b}" for a, b in zip(AMOUNTS, SUMS))}
FROM derechos_punto GROUP BY COD_CUENCA, COD_SUBCUENCA, COD_SUBSUBCUENCA, REGION"""),

    "derechos_coordenada": (("mf",), f"""
SELECT UTM_NORTE, UTM_ESTE, {cols(RIGHTS, "max(mf.{0}) AS {0}")}
FROM mf WHERE mf.TIPO_DERECHO IS NOT NULL GROUP BY UTM_NORTE, UTM_ESTE"""),

    "cuenca_stats": (("mf", "derechos_cuenca"), f"""
SELECT {cols(PATH, "m.{0} AS {0}")}, m.REGION AS Cod_Region, {_FLOW_AGGREGATES},
       count(DISTINCT concat(m.UTM_NORTE, '-', m.UTM_ESTE)) AS total_puntos_unicos,
       count(*) AS total_mediciones, {cols(BASIN_RIGHTS, "max(coalesce(d.{0}, 0)) AS {0}")}
FROM mf m LEFT JOIN derechos_cuenca d
  ON m.COD_CUENCA = d.COD_CUENCA AND m.COD_SUBCUENCA = d.COD_SUBCUENCA
 AND m.COD_SUBSUBCUENCA = d.COD_SUBSUBCUENCA AND m.REGION = d.REGION
GROUP BY {cols(PATH, "m.{0}")}, m.REGION"""),

    "filtros": (("mf",), f"""
SELECT 'cuenca' AS nivel, NOM_CUENCA AS nom_cuenca, cast(NULL AS varchar) AS nom_subcuenca,
       min(CAUDAL) AS avgMin, max(CAUDAL) AS avgMax, {_POINTS} AS total_puntos
FROM mf GROUP BY mf.NOM_CUENCA
UNION ALL
SELECT 'subcuenca', NOM_CUENCA, NOM_SUBCUENCA, min(CAUDAL), max(CAUDAL), {_POINTS}
FROM mf GROUP BY mf.NOM_CUENCA, mf.NOM_SUBCUENCA"""),

    "registro": ((), """
SELECT user_id AS run_id, 'GET' AS method, event_type AS endpoint,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS time_ms
FROM events"""),
}


def with_tables(query: str, *names: str) -> str:
    """``query`` preceded by the named tables and those that they read."""
    needed: list[str] = []

    def add(name: str) -> None:
        for other in CTES[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    tables = ",\n".join(f"{n} AS ({CTES[n][1]}\n)" for n in needed)
    return f"WITH {tables}\n{query.strip()}" if needed else query.strip()
