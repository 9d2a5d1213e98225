"""Derived tables on small facts made for one rule each."""

from datetime import date, datetime
from statistics import stdev

import pytest

from acequia import Warehouse, schema as S
from acequia.operators import bitmaps, builds, rollup, updates
from acequia.plans.warehouse import Source, basin_stats
from facts import dicts, fact


def basin_flows(points):
    numbers = bitmaps.numbered_in_one_task(bitmaps.places(points))
    return rollup.basin_flows(points, bitmaps.path_bitmaps(points, numbers))


def right(kind, volume, january=1.0):
    return {"TIPO_DERECHO": kind, "VOLUMEN_ANUAL": volume, **{c: january for c in S.MONTHLY_FLOWS}}


def test_measurements_are_distinct_and_flagged_row_by_row(spark):
    f = fact(spark, {"NATURALEZA": 1}, {"NATURALEZA": 1}, {"NATURALEZA": 2}, {"NATURALEZA": None})
    assert sorted(r["es_pozo_subterraneo"] for r in dicts(builds.measurements(f))) == [False, True]


def test_point_with_both_natures_is_no_well(spark):
    f = fact(spark, {"NATURALEZA": 1}, {"NATURALEZA": 2}, {"CODIGO": "OB-2", "NATURALEZA": 1},
             {"CODIGO": "OB-3", "NATURALEZA": None})
    flags = {r["codigo"]: r["es_pozo_subterraneo"] for r in dicts(rollup.points(rollup.point_rollup(f)))}
    assert flags == {"OB-1": False, "OB-2": True, "OB-3": False}


def test_null_keys_stay_in_the_tables_and_leave_the_variants(spark):
    f = fact(spark, {"CAUDAL": 1.0}, {"UTM_NORTE": None}, {"FECHA_MEDICION": None}, {"COD_SUBCUENCA": None})
    assert builds.daily_series(f).count() == 4
    assert builds.daily_series_by_coord(f).count() == 1
    r = rollup.point_rollup(f)
    assert rollup.points(r).count() == 3
    assert rollup.points_by_coord(r).count() == 1


def test_rows_without_coordinates_count_as_one_point(spark):
    f = fact(spark, {}, {"UTM_NORTE": None, "UTM_ESTE": None}, {"UTM_NORTE": None, "UTM_ESTE": None},
             {"UTM_NORTE": None})
    assert [r["total_puntos_unicos"] for r in dicts(basin_stats(Source(Warehouse(f.sparkSession, f))))] == [3]
    for stats in (builds.filter_stats, builds.filter_stats_grouping_sets):
        assert {r["total_puntos"] for r in dicts(stats(builds.flow_range_per_point(f)))} == {3}


def test_filter_stats_tell_a_total_from_a_null_name(spark):
    f = fact(spark, {"CAUDAL": 1.0}, {"NOM_SUBCUENCA": None, "CAUDAL": 5.0}, {"NOM_CUENCA": None, "NOM_SUBCUENCA": None})
    expected = {
        ("cuenca", "Rio", None, 1.0, 5.0, 1), ("cuenca", None, None, None, None, 1),
        ("subcuenca", "Rio", "Rio alto", 1.0, 1.0, 1), ("subcuenca", "Rio", None, 5.0, 5.0, 1),
        ("subcuenca", None, None, None, None, 1),
    }
    for stats in (builds.filter_stats, builds.filter_stats_grouping_sets):
        got = [tuple(r) for r in stats(builds.flow_range_per_point(f)).collect()]
        assert set(got) == expected and len(got) == 5


def test_rights_count_once_per_point_and_skip_null_levels(spark):
    f = fact(
        spark, right(1, 10.0), right(1, 12.0), {"UTM_ESTE": 1, **right(2, 5.0)},
        {"COD_SUBSUBCUENCA": None, "NOM_SUBSUBCUENCA": None, **right(1, 100.0)},
        {"VOLUMEN_ANUAL": 999.0},
    )
    rows = {r["Cod_Subsubcuenca"]: r for r in dicts(basin_stats(Source(Warehouse(f.sparkSession, f))))}
    assert (rows[101011]["puntos_con_derechos"], rows[101011]["volumen_anual_total"]) == (2, 17.0)
    assert rows[101011]["caudal_enero_sum"] == 2.0
    assert (rows[None]["puntos_con_derechos"], rows[None]["volumen_anual_total"]) == (0, 0.0)


def test_two_spellings_of_a_basin_carry_the_same_rights(spark):
    f = fact(spark, right(1, 10.0), {"NOM_SUBSUBCUENCA": "Rio alto 1", **right(1, 10.0)})
    assert [r["volumen_anual_total"] for r in dicts(basin_stats(Source(Warehouse(f.sparkSession, f))))] == [10.0, 10.0]


def test_rights_of_the_rollup_ignore_reports_without_a_type(spark):
    f = fact(spark, right(1, 10.0), {"VOLUMEN_ANUAL": 999.0})
    r = rollup.point_rollup(f)
    assert dicts(rollup.rights_per_point(r)) == dicts(builds.rights_per_point(f))
    assert dicts(rollup.rights_per_coord(r)) == dicts(builds.rights_per_coord(f))
    assert dicts(rollup.points(r))[0]["VOLUMEN_ANUAL"] == 999.0


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_pooled_deviation_is_accurate(spark, offset):
    flows = [1.0, 2.0, 4.0, 7.0, 11.0, None]
    f = fact(spark, *({"CAUDAL": None if x is None else x + offset, "CODIGO": f"OB-{i % 3}"}
                      for i, x in enumerate(flows)),
             {"CODIGO": "OB-9", "COD_CUENCA": None, "CAUDAL": 3.0}, {"CODIGO": "OB-8", "REGION": 2})
    pooled = {(r["Cod_Cuenca"], r["Cod_Region"]): r for r in dicts(basin_flows(rollup.point_rollup(f)))}
    got = pooled[101, 1]
    assert got["caudal_desviacion_estandar"] == pytest.approx(stdev(flows[:5]), rel=1e-12)
    assert (got["caudal_promedio"], got["caudal_minimo"], got["caudal_maximo"]) == (
        5.0 + offset, 1.0 + offset, 11.0 + offset)
    assert (got["total_mediciones"], got["total_puntos_unicos"]) == (6, 1)
    assert (pooled[None, 1]["caudal_promedio"], pooled[None, 1]["caudal_desviacion_estandar"]) == (3.0, None)
    assert (pooled[101, 2]["caudal_promedio"], pooled[101, 2]["caudal_desviacion_estandar"]) == (None, None)


def test_daily_series_averages_and_keeps_the_highest_meter(spark):
    f = fact(spark, {"CAUDAL": 1.0, "TOTALIZADOR": 9}, {"CAUDAL": 3.0, "TOTALIZADOR": 5},
             {"FECHA_MEDICION": datetime(2023, 6, 16), "NIVEL_FREATICO": 0.0})
    rows = {r["FECHA_MEDICION"]: r for r in dicts(builds.daily_series(f))}
    assert (rows[date(2023, 6, 15)]["CAUDAL"], rows[date(2023, 6, 15)]["TOTALIZADOR"]) == (2.0, 9)
    assert (rows[date(2023, 6, 16)]["CAUDAL"], rows[date(2023, 6, 16)]["NIVEL_FREATICO"]) == (None, 0.0)


def test_daily_series_by_coord_weighs_reports_not_paths(spark):
    f = fact(spark, {"CAUDAL": 1.0}, {"CAUDAL": 2.0}, {"NOM_CUENCA": "Rio B", "CAUDAL": 6.0})
    (row,) = dicts(builds.daily_series_by_coord(f))
    assert (row["CAUDAL"], row["NOM_CUENCA"]) == (3.0, "Rio B")


def test_reporters_need_an_id(spark):
    f = fact(spark, {"INF": 1, "NOMB_INF": "A"}, {"INF": 1, "NOMB_INF": "A", "FECHA_MEDICION": datetime(2024, 1, 1)},
             {"INF": None, "NOMB_INF": "B"})
    (row,) = dicts(builds.reporters(f))
    assert (row["NOMB_INF"], row["CANTIDAD_REPORTES"], row["ULTIMA_FECHA_MEDICION"]) == ("A", 2, datetime(2024, 1, 1))


def test_update_changes_matching_rows_only(spark):
    target = spark.createDataFrame([(1, 1, "a"), (1, None, "b"), (2, 2, "c"), (1, 1, "d")], "N int, E int, v string")
    source = spark.createDataFrame([(1, 1, "new"), (3, 3, "x"), (2, 2, None)], "n2 int, e2 int, V string")
    got = updates.update_from(target, source, {"N": "n2", "E": "e2"}, ["V"])
    assert sorted(map(tuple, got.collect()), key=str) == [
        (1, 1, "new"), (1, 1, "new"), (1, None, "b"), (2, 2, None)]
    assert [c.lower() for c in got.columns] == ["n", "e", "v"]


def test_adding_columns_twice_adds_them_once(spark):
    target = spark.createDataFrame([(1, 5)], "a int, tipo_derecho int")
    once = updates.with_missing_columns(target, S.POINT_RIGHT_TYPES)
    again = updates.with_missing_columns(once, S.POINT_RIGHT_TYPES)
    assert again.columns == once.columns and len(once.columns) == 15
    assert dicts(once)[0]["tipo_derecho"] == 5 and dict(once.dtypes)["CAUDAL_ENERO"] == "double"
