"""Builds and reads against their SQL on random facts full of NULLs, zeros and duplicates."""

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pytest

from acequia import Warehouse, schema as S
from acequia.operators import builds, rollup
from acequia.plans.registry import presented
from acequia.plans.warehouse import Source, basin_stats
from compare import rows_of_duckdb, rows_of_spark
from acequia.sources import read_fact, write_table
from oracle import queries as expected
from oracle.tables import CTES

SEEDS = (1, 2)


def random_rows(seed, n=400):
    rng = random.Random(seed)

    def maybe(value, share=0.15):
        return None if rng.random() < share else value

    start = datetime(2022, 12, 20)
    rows = []
    for _ in range(n):
        basin, sub, subsub = rng.choice((115, 116)), rng.choice((11500, 11501)), rng.choice((115000, 115001))
        row = {
            "UTM_NORTE": maybe(6000000 + 100 * rng.randrange(3)), "UTM_ESTE": maybe(300000 + 1000 * rng.randrange(2)),
            "HUSO": 19, "REGION": maybe(rng.choice((1, 2)), 0.1), "PROVINCIA": "P", "COMUNA": maybe("C", 0.05),
            "COD_CUENCA": maybe(basin), "NOM_CUENCA": maybe(rng.choice(("NATION_15", "Otra"))),
            "COD_SUBCUENCA": maybe(sub), "NOM_SUBCUENCA": maybe(f"NATION_15 sub {sub % 10}"),
            "COD_SUBSUBCUENCA": maybe(subsub), "NOM_SUBSUBCUENCA": maybe("x"),
            "CODIGO": maybe(rng.choice(("OB-0-0", "OB-1-0")), 0.05), "NATURALEZA": maybe(rng.choice((1, 2))),
            "COD_SECTOR_SHA": maybe(rng.choice((121, 122)), 0.3), "SECTOR_SHA": maybe("Sector 1", 0.3),
            "APR": maybe(rng.randrange(2), 0.4), "ID_JUNTA": maybe(1.0, 0.5),
            "PARTE_JUNTA": maybe(rng.randrange(2), 0.8), "REPRESENTA_JUNTA": None, "CANAL_TRANSMISION": maybe(1, 0.1),
            "TIPO_DERECHO": maybe(rng.choice((1, 2, 99)), 0.4),
            **{c: maybe(rng.randrange(8) / 4, 0.2) for c in S.RIGHT_AMOUNTS},
            "CAUDAL": maybe(rng.choice((0.0, 0.125, 2.675, -1.5, 40.0)), 0.2),
            "ALTURA_LIMNIMETRICA": maybe(rng.randrange(5) / 2, 0.6), "NIVEL_FREATICO": maybe(0.0, 0.5),
            "TOTALIZADOR": maybe(rng.randrange(1000)),
            "FECHA_MEDICION": maybe(start + timedelta(hours=rng.randrange(24 * 30))),
            "INF": maybe(rng.randrange(3), 0.3), "NOMB_INF": maybe(rng.choice((" Ana", "Luz", "  "))),
            "A_PAT_INF": maybe("Soto", 0.5), "A_MAT_INF": maybe(" \t", 0.5),
        }
        rows.append(row)
        if rng.random() < 0.1:
            rows.append(dict(row))
    return rows


@pytest.fixture(scope="module", params=SEEDS)
def both(request, spark, tmp_path_factory):
    rows = random_rows(request.param)
    path = str(tmp_path_factory.mktemp("hechos") / "fact")
    write_table(spark.createDataFrame([tuple(r[c] for c in S.FACT.names) for r in rows], S.FACT).coalesce(2), path)
    w = Warehouse(spark, read_fact(spark, path), str(tmp_path_factory.mktemp("tablas")))
    w.refresh()
    types = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(),
             "timestamp_ntz": pa.timestamp("us")}
    schema = pa.schema([(f.name, types[f.dataType.simpleString()]) for f in S.FACT])
    db = duckdb.connect()
    db.register("mf", pa.Table.from_pylist(rows, schema=schema))
    return w, db


def over_given_fact(sql):
    """The SQL with the sample fact taken out, so that it reads the registered table."""
    head = f"WITH mf AS ({CTES['mf'][1]}\n)"
    assert sql.startswith(head)
    rest = sql[len(head):]
    return "WITH " + rest.removeprefix(",\n") if rest.startswith(",") else rest


BUILDS = {
    "build_measurements": lambda w: builds.measurements(w.fact),
    "build_basin_catalog": lambda w: builds.basin_catalog(w.fact),
    "scan_basin_catalog": lambda w: w.table("cuencas_regiones"),
    "scan_daily_series": lambda w: w.table("series_tiempo").drop(*S.SERIES_STATE),
    "build_reporters": lambda w: builds.reporters(w.fact),
    "build_points": lambda w: w.table("puntos_mapa"),
    "build_points_by_coord": lambda w: rollup.points_by_coord(w.table("rollup_puntos")),
    "build_daily_series": lambda w: builds.daily_series(w.fact),
    "build_daily_series_by_coord": lambda w: builds.daily_series_by_coord(w.fact),
    "rights_per_point": lambda w: builds.rights_per_point(w.fact),
    "build_basin_stats": lambda w: basin_stats(Source(w)),
    "scan_basin_stats": lambda w: w.table("cuenca_stats"),
    "build_filter_stats": lambda w: builds.filter_stats(builds.flow_range_per_point(w.fact)),
    "build_filter_stats_gsets": lambda w: builds.filter_stats_grouping_sets(builds.flow_range_per_point(w.fact)),
    "scan_filter_stats": lambda w: w.table("filtros_reactivos_stats"),
    "points_count_null_subbasin": None,
    "points_list": None,
    "points_list_default": None,
    "point_info": None,
    "point_metric_stats": None,
    "multi_point_flow_stats": None,
    "admin_divisions": None,
    "points_lonlat": None,
    "basin_stats_global": None,
    "basin_subbasin_names": None,
    "sector_list_filtered": None,
    "series_basin_flow": None,
    "series_basin_flow_well": None,
    "series_subbasin_table": None,
    "series_sector_flow": None,
    "series_sector_flow_by_name": None,
    "series_sector_flow_well": None,
    "series_point_flow": None,
    "point_rights": None,
    "basin_rights": None,
    "subbasin_rights": None,
    "reporters_list": None,
    "reporter_full_names": None,
    "point_coverage": None,
    "sectors_with_data": None,
}


def floats_last(rows):
    """Rows in the order of their exact columns; sums of doubles may differ in the last digit."""
    floats = {i for r in rows for i, v in enumerate(r) if isinstance(v, float)}
    order = [i for i in range(len(rows[0])) if i not in floats] + sorted(floats) if rows else []
    moved = [tuple(r[i] for i in order) for r in rows]
    return sorted(moved, key=lambda r: [(v is None, str(type(v)), 0 if v is None else v) for v in r])


@pytest.mark.parametrize("key", BUILDS)
def test_matches_sql(both, key):
    from acequia.plans.registry import EXACT, QUERIES

    w, db = both
    df = BUILDS[key](w) if BUILDS[key] else QUERIES[key](w, "")
    names, got = rows_of_spark(presented(df, exact=key in EXACT))
    expected_names, _, rows = rows_of_duckdb(db, over_given_fact(expected.oracle_sql()[key]))
    assert names == expected_names
    assert len(got) == len(rows)
    for a, b in zip(floats_last(got), floats_last(rows)):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, abs=2e-6) if isinstance(y, float) else y)
