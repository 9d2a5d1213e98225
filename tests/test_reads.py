"""Reads on small facts made for one rule each."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException

from acequia import Warehouse
from acequia import schema as S
from acequia.operators import basins, builds, checks, points, reporters, request_log, rights, series
from acequia.operators.filters import PointFilter
from facts import dicts, fact

PLACE = (6300000, 350000)


def house(spark, *rows):
    return Warehouse(spark, fact(spark, *rows))


def test_zero_flow_is_null_in_statistics_and_zero_in_detail(spark):
    w = house(spark, {"CAUDAL": 0.0}, {"CAUDAL": 0.0, "FECHA_MEDICION": datetime(2023, 6, 16)})
    (stats,) = dicts(w.point_statistics([PLACE]))
    assert stats["total_registros"] == 2
    assert [stats[c] for c in ("promedio", "minimo", "maximo", "desviacion_estandar")] == [None] * 4
    assert (stats["primera_fecha"], stats["ultima_fecha"]) == ("2023-06-15", "2023-06-16")
    assert dicts(w.point_info(*PLACE))[0]["caudal_promedio"] == 0.0


def test_metrics_without_values_are_left_out(spark):
    w = house(spark, {"NIVEL_FREATICO": 2.0})
    assert [r["metrica"] for r in dicts(w.point_statistics([PLACE]))] == ["nivel_freatico"]
    assert w.point_statistics([(1, 1)]).count() == 0


def test_a_location_listed_twice_is_asked_twice_and_read_once(spark):
    w = house(spark, {"CAUDAL": 1.0}, {"UTM_ESTE": 1, "CAUDAL": 3.0}, {"UTM_NORTE": 1, "UTM_ESTE": 1, "CAUDAL": 9.0},
              {"UTM_ESTE": 2, "CAUDAL": 50.0}, {"UTM_NORTE": None, "CAUDAL": 70.0})
    (row,) = dicts(w.point_statistics([PLACE, PLACE, (PLACE[0], 1), (7, 7)]))
    assert row["puntos_consultados"] == 4
    assert (row["total_registros_con_caudal"], row["caudal_promedio"]) == (2, 2.0)


def test_locations_are_checked(spark):
    w = house(spark, {})
    for bad in ([(10_000_001, 1)], [(1, -1)], []):
        with pytest.raises(ValueError):
            w.point_statistics(bad)


def test_mark_valid_locations(spark):
    df = spark.createDataFrame(
        [(0, 0), (10_000_000, 1_000_000), (10_000_001, 0), (0, 1_000_001), (-1, 0), (None, 0)],
        "UTM_NORTE int, UTM_ESTE int")
    assert [r["es_valida"] for r in dicts(points.mark_valid_locations(df))] == [True, True] + [False] * 4


def test_count_keeps_points_without_coordinates_and_list_drops_them(spark):
    w = house(spark, {}, {"UTM_NORTE": None})
    (row,) = dicts(w.count_points(PointFilter(region=1, pozo=False)))
    assert row["total_puntos_unicos"] == 2
    assert (row["region"], row["pozo"], row["shac"]) == (1, False, None)
    assert w.list_points().count() == 1


def test_null_subbasin_switch_overrides_the_code(spark):
    w = house(spark, {}, {"COD_SUBCUENCA": None})
    assert dicts(w.count_points(PointFilter(cod_subcuenca=10101)))[0]["total_puntos_unicos"] == 1
    both = PointFilter(cod_subcuenca=10101, filtro_null_subcuenca=True)
    assert dicts(w.count_points(both))[0]["total_puntos_unicos"] == 1
    assert [r["cod_subsubcuenca"] for r in dicts(w.list_points(both))] == [101011]


def test_flow_range_is_inclusive_and_skips_null(spark):
    w = house(spark, {"CODIGO": "a", "CAUDAL": 1.0}, {"CODIGO": "b", "CAUDAL": 2.0}, {"CODIGO": "c"})
    count = lambda **f: dicts(w.count_points(PointFilter(**f)))[0]["total_puntos_unicos"]
    assert count(caudal_minimo=1.0) == 2
    assert count(caudal_maximo=1.0) == 1
    assert count(caudal_minimo=0.0, caudal_maximo=5.0) == 2


def test_tri_state_flags(spark):
    w = house(spark, {"UTM_ESTE": 1, "APR": 1}, {"UTM_ESTE": 2, "APR": 0}, {"UTM_ESTE": 3, "APR": None})
    assert [r["apr"] for r in dicts(w.list_points())] == [True, False, None]
    assert dicts(w.count_points(PointFilter(apr=False)))[0]["total_puntos_unicos"] == 1


def test_list_limit(spark):
    w = house(spark, *({"UTM_ESTE": i} for i in range(130)))
    assert w.list_points().count() == S.DEFAULT_POINT_LIMIT
    assert w.list_points(limit=None).count() == 130
    assert [r["utm_este"] for r in dicts(w.list_points(limit=3))] == [0, 1, 2]


def test_point_info_of_an_unknown_place_is_empty(spark):
    assert house(spark, {}).point_info(1, 1).count() == 0


def shared_coordinate(spark):
    """Two catalog rows at one coordinate, one well and one sector each way."""
    return house(
        spark,
        {"CODIGO": "a", "NATURALEZA": 1, "COD_SECTOR_SHA": 7, "SECTOR_SHA": "S", "CAUDAL": 2.0, "TOTALIZADOR": 10},
        {"CODIGO": "b", "NATURALEZA": 1, "COD_SECTOR_SHA": 7, "SECTOR_SHA": "S", "CAUDAL": 4.0, "TOTALIZADOR": 8},
        {"CODIGO": "c", "UTM_ESTE": 1, "COD_SECTOR_SHA": 7, "SECTOR_SHA": "S", "CAUDAL": 9.0},
        {"CODIGO": "d", "UTM_NORTE": None, "NATURALEZA": 1, "COD_SECTOR_SHA": 7, "CAUDAL": 100.0},
    )


def test_each_catalog_row_counts_the_series_row_once(spark):
    w = shared_coordinate(spark)
    (plain,) = dicts(w.area_series("cuenca", "caudal", "101"))
    assert (plain["caudal_sumado"], plain["totalizador_sumado"]) == (112.0, 10)
    (sector,) = dicts(w.area_series("shac", "caudal", "7"))
    assert (sector["caudal_sumado"], sector["caudal"]) == (3.0 * 2 + 9.0, 5.0)
    assert (sector["totalizador_sumado"], sector["totalizador_max"]) == (20, 10)
    (wells,) = dicts(w.area_series("shac", "caudal", "S", well=True))
    assert (wells["caudal_sumado"], wells["caudal_promedio"]) == (6.0, 3.0)
    (surface,) = dicts(w.area_series("cuenca", "caudal", "101", well=False))
    assert surface["caudal_sumado"] == 9.0


def test_series_is_newest_first_with_unknown_dates_last(spark):
    w = house(spark, {"CAUDAL": 1.0, "FECHA_MEDICION": datetime(2020, 1, 1)}, {"CAUDAL": 1.0, "FECHA_MEDICION": None},
              {"CAUDAL": 1.0, "FECHA_MEDICION": datetime(2021, 1, 1, 23, 59)})
    for df in (w.area_series("cuenca", "caudal", "101"), w.point_series("caudal", *PLACE)):
        assert [r["fecha_medicion"] for r in dicts(df)] == ["2021-01-01", "2020-01-01", None]


def test_dates_are_inclusive_and_empty_text_is_no_bound(spark):
    w = house(spark, *({"CAUDAL": 1.0, "FECHA_MEDICION": datetime(2020, 1, d)} for d in (1, 2, 3)))
    dates = lambda **k: [r["fecha_medicion"][-1] for r in dicts(w.point_series("caudal", *PLACE, **k))]
    assert dates(start="2020-01-02") == ["3", "2"]
    assert dates(start="2020-01-01", end="2020-01-02") == ["2", "1"]
    assert dates(start="", end=None) == ["3", "2", "1"]


def test_a_malformed_date_fails(spark):
    w = house(spark, {"CAUDAL": 1.0})
    for text in ("2023-13-01", "20x", "yesterday"):
        with pytest.raises((PySparkException, ValueError)):
            w.point_series("caudal", *PLACE, start=text).collect()


def test_identifier_of_ascii_digits_is_a_code(spark):
    w = house(spark, {"CAUDAL": 1.0, "NOM_CUENCA": "²"}, {"CAUDAL": 5.0, "COD_CUENCA": 7, "NOM_CUENCA": "101"})
    flow = lambda text, **k: [r["caudal"] for r in dicts(w.area_series("cuenca", "caudal", text, **k))]
    assert flow("101") == [1.0]
    assert flow("²") == [1.0]
    assert flow("Rio") == []


def test_names_compare_by_the_given_collation(spark):
    w = house(spark, {"CAUDAL": 1.0, "NOM_CUENCA": "Río Ñ"})
    assert w.area_series("cuenca", "caudal", "río ñ").count() == 0
    assert w.area_series("cuenca", "caudal", "río ñ", collation="UTF8_LCASE").count() == 1


def test_point_series_counts(spark):
    w = house(spark, {"NIVEL_FREATICO": 1.0}, {"NIVEL_FREATICO": None, "FECHA_MEDICION": datetime(2020, 1, 1)})
    assert dicts(w.point_series_count("nivel_freatico", *PLACE)) == [{"total": 1}]
    assert dicts(w.point_series_count("nivel_freatico", *PLACE, end="2022-01-01")) == [{"total": 0}]


def with_right(kind, volume, january, june, **more):
    return {"TIPO_DERECHO": kind, "VOLUMEN_ANUAL": volume, **{c: 0.0 for c in S.MONTHLY_FLOWS},
            "CAUDAL_ENERO": january, "CAUDAL_JUNIO": june, **more}


def test_point_rights(spark):
    w = house(spark, with_right(1, 599184.0, 19.0, 9.5), with_right(99, 0.0, 0.0, 0.0, UTM_ESTE=2), {"UTM_ESTE": 3})
    (row,) = dicts(w.point_rights(*PLACE))
    assert (row["tipo_derecho"], row["tipo_derecho_label"], row["volumen_anual"]) == (1, "Consuntivo", 599184.0)
    folded = rights.with_month_map(w.point_rights(*PLACE), [c.lower() for c in S.MONTHLY_FLOWS], "caudal_mensual")
    (nested,) = dicts(folded)
    assert (nested["caudal_mensual"]["enero"], nested["caudal_mensual"]["junio"]) == (19.0, 9.5)
    assert dicts(w.point_rights(PLACE[0], 2))[0]["tipo_derecho_label"] == "Desconocido"
    assert w.point_rights(PLACE[0], 3).count() == 0


def test_basin_rights(spark):
    w = house(spark, with_right(1, 1_000_000.0, 50.0, 10.0), with_right(2, 5.0, 1.0, 1.0, COD_SUBCUENCA=2),
              {"COD_CUENCA": 7, "COD_SUBCUENCA": 9})
    (basin,) = dicts(w.basin_rights(101))
    assert (basin["puntos_con_derechos"], basin["volumen_anual_total"], basin["caudal_enero_sum"]) == (2, 1_000_005.0, 51.0)
    (sub,) = dicts(w.basin_rights(101, 10101))
    assert (sub["puntos_con_derechos"], sub["caudal_junio_sum"]) == (1, 10.0)
    (none,) = dicts(w.basin_rights(7))
    assert set(none.values()) == {0}
    (unknown,) = dicts(w.basin_rights(-1))
    assert set(unknown.values()) == {None}
    months = dicts(rights.by_month(w.basin_rights(101), S.MONTHLY_SUMS))
    assert [m["mes"] for m in months] == list(S.MONTHS) and months[0]["caudal"] == 51.0


def test_zero_points_make_every_figure_zero(spark):
    stats = spark.createDataFrame(
        [(101, 1, 0, 5.0, *[1.0] * 12)],
        "Cod_Cuenca int, Cod_Subcuenca int, " + ", ".join(f"{c} {'long' if i == 0 else 'double'}"
                                                          for i, c in enumerate(S.BASIN_RIGHTS)))
    assert set(dicts(rights.basin_rights(stats, 101))[0].values()) == {0}


def test_reporters(spark):
    w = house(spark, {"INF": 1, "NOMB_INF": " Ana ", "A_PAT_INF": "  ", "A_MAT_INF": "Soto"},
              {"INF": 2, "UTM_ESTE": 2, "FECHA_MEDICION": datetime(2020, 5, 4, 3, 2, 1, 250000)})
    rows = dicts(w.reporters())
    assert rows == [
        {"nombre_completo": "Ana Soto", "cantidad_reportes": 1, "ultima_fecha_medicion": "2023-06-15 10:30:00"},
        {"nombre_completo": "Desconocido", "cantidad_reportes": 1, "ultima_fecha_medicion": "2020-05-04 03:02:01.250000"},
    ]
    assert w.reporters(utm_este=2, cod_cuenca=101).count() == 1
    assert w.reporters(limit=1).count() == 1
    table = spark.createDataFrame([("A", None, None, None, None)],
                                  "NOMB_INF string, A_PAT_INF string, A_MAT_INF string, CANTIDAD_REPORTES long, "
                                  "ULTIMA_FECHA_MEDICION timestamp_ntz")
    assert dicts(reporters.list_reporters(table)) == [
        {"nombre_completo": "A", "cantidad_reportes": 0, "ultima_fecha_medicion": None}]


def test_global_figures_ignore_the_filter(spark):
    w = house(spark, {"CAUDAL": 1.0}, {"CAUDAL": 2.0}, {"COD_CUENCA": 7, "CAUDAL": 10.0}, {"COD_CUENCA": 8})
    (row,) = dicts(w.basin_stats(cod_cuenca=101, include_global=True))
    assert row["caudal_promedio"] == 1.5
    assert (row["global_promedio"], row["global_minimo"], row["global_maximo"]) == (5.75, 1.0, 10.0)
    assert w.basin_stats(cod_cuenca=-1, include_global=True).count() == 0


def test_filter_ranges_have_no_global_row(spark):
    w = house(spark, {"CAUDAL": 2.675})
    assert w.filter_ranges("global").count() == 0
    assert dicts(w.filter_ranges("cuenca")) == [{"nom_cuenca": "Rio", "avgMin": 2.67, "avgMax": 2.67, "total_puntos": 1}]
    assert [r["nivel"] for r in dicts(w.filter_ranges())] == ["cuenca", "subcuenca"]


def test_sorted_listings(spark):
    w = house(spark, {"COD_CUENCA": 9, "ID_JUNTA": 2.0, "REGION": 2}, {"COD_SUBCUENCA": None, "REGION": None},
              {"COD_SECTOR_SHA": 5, "ID_JUNTA": 1.0}, {"COD_CUENCA": None})
    assert [(r["cod_cuenca"], r["cod_subcuenca"]) for r in dicts(w.basins())] == [
        (9, 10101), (101, None), (101, 10101)]
    assert [r["id_junta"] for r in dicts(w.boards())] == [1.0, 2.0]
    assert [r["cod_sector_sha"] for r in dicts(w.sectors())] == [5]
    assert w.sectors(region=2).count() == 0
    assert [r["region"] for r in dicts(w.admin_divisions())] == [1, 2]


def test_subbasin_names(spark):
    f = fact(spark, {"NOM_SUBCUENCA": "b"}, {"NOM_SUBCUENCA": "a"}, {"NOM_SUBCUENCA": "b", "REGION": 2},
             {"NOM_SUBCUENCA": None})
    assert dicts(basins.subbasin_names(builds.basin_catalog(f))) == [{"cod_cuenca": 101, "subcuencas": "a, b"}]


def test_column_coverage_names_missing_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "Ab int, C string")
    assert [tuple(r) for r in checks.column_coverage(df, "t", ["AB", "c", "d"]).collect()] == [
        ("t", "AB", True, 2), ("t", "c", True, 1), ("t", "d", False, None)]


def test_point_coverage_and_sectors(spark):
    w = house(spark, {"SECTOR_SHA": "Lluta", "COD_SECTOR_SHA": 1, "CAUDAL": 1.0}, {"SECTOR_SHA": "Lluta", "CAUDAL": 2.0},
              {"SECTOR_SHA": "Lluta", "UTM_NORTE": None}, {"SECTOR_SHA": "Azapa", "UTM_ESTE": 2})
    tables = [w.table(n) for n in ("puntos_mapa", "datos", "series_tiempo")]
    got = {(r["utm_norte"], r["utm_este"]): (r["n_datos"], r["n_series"]) for r in dicts(
        checks.point_coverage(*tables, "lut"))}
    assert got == {(6300000, 350000): (2, 1), (None, 350000): (0, 0)}
    assert dicts(checks.sectors_with_data(tables[0], tables[2])) == [{"cod_sector_sha": 1, "sector_sha": "Lluta"}]


def test_latency_report(spark):
    log = spark.createDataFrame(
        [(1, "GET", "/a", 200, 10.0), (1, "GET", "/a", 299, 30.0), (2, "GET", "/a", 300, 20.0),
         (2, "POST", "/b", 199, 5.0), (2, "POST", "/b", None, None)],
        "run_id int, method string, endpoint string, status int, time_ms double")
    rows = {r["endpoint"]: r for r in dicts(request_log.latency_by_endpoint(log))}
    assert (rows["/a"]["avg_time"], rows["/a"]["n_requests"], rows["/a"]["pass_count"]) == (20.0, 3, 2)
    (total,) = dicts(request_log.latency_overall(log))
    assert (total["total_runs"], total["total_tests"], total["pass_count"], total["fail_count"]) == (2, 5, 2, 3)
    assert total["success_rate"] == pytest.approx(40.0)
    assert [r["time_ms"] for r in dicts(request_log.slowest_requests(log, 2))] == [30.0, 20.0]
    (empty,) = dicts(request_log.latency_overall(log.limit(0)))
    assert (empty["total_tests"], empty["success_rate"]) == (0, 0.0)


def test_unknown_level_or_metric(spark):
    w = house(spark, {})
    with pytest.raises(KeyError):
        w.area_series("pais", "caudal", "1")
    with pytest.raises(KeyError):
        series.point_series(w.table("series_tiempo"), "temperatura", 1, 1)
