"""Versions: sessions that write at once, cleaning up, merging new files, rewriting single files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from acequia import Warehouse, schema as S
from acequia.functions import contains_text
from acequia.operators import checks, cube, text_index
from acequia.operators.filters import PointFilter
from acequia.operators.points import row_count
from acequia.operators.series import METRICS, area_series
from acequia.plans.warehouse import MAX_PARTS, TABLES
from acequia.sources import StoredFact
from acequia.sources.log import Conflict, VersionLog
from facts import dicts, fact


def rows(df):
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]
    return sorted(map(str, df.select(*rounded).collect()))


def plus(column, value):
    return lambda df: df.withColumn(column, F.coalesce(F.col(column), F.lit(0.0)) + value)


# -- Sessions ------------------------------------------------------------------------


def test_of_two_sessions_both_updates_stay(spark, tmp_path):
    root = str(tmp_path)
    first = Warehouse(spark, fact(spark, {"CAUDAL": 1.0}), root)
    first.refresh()
    second = Warehouse.open(spark, root)
    assert second.table("puntos_mapa").count() == 1  # the second session has read the table already
    first.update("puntos_mapa", plus("VOLUMEN_ANUAL", 1.0))
    second.update("puntos_mapa", plus("CAUDAL_ENERO", 2.0))
    (row,) = dicts(Warehouse.open(spark, root).table("puntos_mapa"))
    assert (row["VOLUMEN_ANUAL"], row["CAUDAL_ENERO"]) == (1.0, 2.0)


def test_an_update_that_was_overtaken_is_computed_again(spark, tmp_path):
    root = str(tmp_path)
    first = Warehouse(spark, fact(spark, {"CAUDAL": 1.0}), root)
    first.refresh()
    second, calls = Warehouse.open(spark, root), []

    def slow(df):
        calls.append(1)
        if len(calls) == 1:  # meanwhile the other session commits
            first.update("puntos_mapa", plus("VOLUMEN_ANUAL", 1.0))
        return plus("VOLUMEN_ANUAL", 10.0)(df)
    second.update("puntos_mapa", slow)
    assert len(calls) == 2
    assert dicts(Warehouse.open(spark, root).table("puntos_mapa"))[0]["VOLUMEN_ANUAL"] == 11.0

    def overtaken(df):
        first.update("puntos_mapa", plus("VOLUMEN_ANUAL", 1.0))
        return df
    with pytest.raises(Conflict):
        second.update("puntos_mapa", overtaken)


def test_changes_of_other_tables_do_not_disturb(spark, tmp_path):
    root = str(tmp_path)
    first = Warehouse(spark, fact(spark, {"CAUDAL": 1.0, "TIPO_DERECHO": 1, "VOLUMEN_ANUAL": 5.0}), root)
    first.refresh()
    second, calls = Warehouse.open(spark, root), []

    def slow(df):
        calls.append(1)
        first.update("cuenca_stats", lambda df: df.withColumn("total_mediciones", F.lit(9).cast("long")))
        return plus("VOLUMEN_ANUAL", 10.0)(df)
    second.update("puntos_mapa", slow)
    found = Warehouse.open(spark, root)
    assert len(calls) == 1
    assert dicts(found.table("puntos_mapa"))[0]["VOLUMEN_ANUAL"] == 15.0
    assert dicts(found.table("cuenca_stats"))[0]["total_mediciones"] == 9


def test_a_version_number_is_taken_once(spark, tmp_path):
    log, other = VersionLog(spark, str(tmp_path)), VersionLog(spark, str(tmp_path))
    assert log.latest() == (0, {"tables": {}})
    assert log.put(1, {"tables": {"a": {"parts": []}}}) and not other.put(1, {"tables": {}})
    assert other.latest() == (1, {"tables": {"a": {"parts": []}}}) and log.numbers() == [1]
    assert log.put(2, {"tables": {}}) and other.latest()[0] == 2


# -- Cleaning up -----------------------------------------------------------------------


def folders(root):
    return {f"{p.parent.name}/{p.name}" for p in (root / "versiones").glob("*/*")}


def test_cleaning_leaves_readers_their_files(spark, tmp_path):
    w = Warehouse(spark, fact(spark, {"CAUDAL": 1.0}), str(tmp_path))
    w.refresh()
    reader, pinned = Warehouse.open(spark, w.root), Warehouse.open(spark, w.root)
    for _ in range(2):
        w.update("puntos_mapa", plus("VOLUMEN_ANUAL", 1.0))
    before = folders(tmp_path)
    assert w.clean() == [] and folders(tmp_path) == before  # superseded a moment ago
    assert dicts(reader.table("puntos_mapa"))[0]["VOLUMEN_ANUAL"] is None
    pinned.pin(3600)
    (gone,) = w.clean(grace=0)  # the version between; the pinned one and the last stay
    assert gone.endswith("/puntos_mapa")
    assert dicts(pinned.table("puntos_mapa"))[0]["VOLUMEN_ANUAL"] is None
    w.log.pin(pinned.version, -1)
    for name in (tmp_path / "lectores").glob("*.json"):
        name.unlink()
    assert len(w.clean(grace=0)) == 1
    assert dicts(Warehouse.open(spark, w.root).table("puntos_mapa"))[0]["VOLUMEN_ANUAL"] == 2.0
    assert Warehouse.open(spark, w.root).basin_stats().count() == 1 and w.log.numbers() == [w.version]


def test_files_of_a_failed_change_are_removed(spark, tmp_path):
    w = Warehouse(spark, fact(spark, {"CAUDAL": 1.0}), str(tmp_path))
    w.refresh()
    before = folders(tmp_path)
    with pytest.raises(Exception, match="lost"):
        w.update("puntos_mapa", lambda df: df.withColumn("codigo", F.raise_error("lost").cast("string")))
    w.clean(grace=0)
    assert folders(tmp_path) == before


# -- Merging new files ------------------------------------------------------------------


def reports(seed, n, years):
    rng = random.Random(seed)
    found = []
    for _ in range(n):
        s, k = rng.randrange(6), rng.randrange(3)
        found.append({
            "UTM_NORTE": rng.choice([None, 100 + s, 100 + s]), "UTM_ESTE": 10 + k, "CODIGO": f"OB-{s}-{k}",
            "COD_CUENCA": 100 + s % 3 if s < 5 else None, "COD_SUBCUENCA": rng.choice([None, 7, 8]),
            "COD_SECTOR_SHA": rng.choice([None, 120 + k]), "SECTOR_SHA": rng.choice([None, f"S{k}"]), "NATURALEZA": rng.choice([1, 2, None]),
            "CAUDAL": rng.choice([None, 1e6 + rng.randrange(8) / 8]), "NIVEL_FREATICO": rng.choice([None, float(k)]),
            "TOTALIZADOR": rng.choice([None, rng.randrange(50)]), "TIPO_DERECHO": rng.choice([None, 1, 2]),
            "VOLUMEN_ANUAL": rng.choice([None, float(s)]), "INF": rng.choice([None, 1]), "NOMB_INF": rng.choice(["a", None]),
            "FECHA_MEDICION": rng.choice([None] + [datetime(y, 5, 1) + timedelta(hours=rng.randrange(60)) for y in years]),
        })
    return found


class Watched(StoredFact):
    """A fact that notes which of its files are read."""

    def __init__(self, spark, path):
        super().__init__(spark, path)
        self.asked = []

    def read_files(self, names):
        self.asked.append(set(names))
        return super().read_files(names)


def add(spark, path, found):
    fact(spark, *found).coalesce(1).write.mode("append").parquet(path)


def test_merging_new_files_equals_a_full_rebuild(spark, tmp_path):
    path = str(tmp_path / "hechos")
    add(spark, path, reports(1, 400, (2001, 2002, 2003)))
    watched = Watched(spark, path)
    w = Warehouse(spark, watched, str(tmp_path / "tablas"))
    w.refresh()
    assert w.refresh_new() == {}
    arrivals = [reports(1, 40, (2003,)), [], reports(9, 60, (2003, 2004)), reports(5, 30, (2004,)) + reports(1, 20, (2001,))]
    for found in arrivals:
        earlier = {n for n, _, _ in watched.files()}
        if found:
            add(spark, path, found)
        asked = len(watched.asked)
        w.refresh_new()
        assert watched.asked[asked:] == ([{n for n, _, _ in watched.files()} - earlier] if found else [])
        fresh = Warehouse(spark, StoredFact(spark, path), str(tmp_path / f"nuevas{len(watched.asked)}"))
        fresh.refresh()
        opened = Warehouse.open(spark, w.root)
        for name in set(TABLES) - {"puntos_numero", "puntos_bitmap"}:  # new points have other numbers
            assert rows(opened.table(name)) == rows(fresh.table(name)), name
        assert rows(opened.points_by_level()) == rows(fresh.points_by_level())
        numbers = sorted(r.numero for r in opened.table("puntos_numero").collect())
        assert numbers == list(range(len(numbers)))
    w.clean(grace=0)  # the list of merged files stays
    assert w.refresh_new() == {}
    assert any(len(e["parts"]) > 1 for e in w.log.latest()[1]["tables"].values())


def test_only_touched_years_are_written(spark, tmp_path):
    path = str(tmp_path / "hechos")
    base = [{"CAUDAL": 1.0, "COD_SECTOR_SHA": 5, "FECHA_MEDICION": datetime(y, 1, d)} for y in (2001, 2002, 2003) for d in (1, 2)]
    add(spark, path, base)
    w = Warehouse(spark, StoredFact(spark, path), str(tmp_path / "tablas"))
    w.refresh()
    add(spark, path, [{"CAUDAL": 9.0, "COD_SECTOR_SHA": 5, "FECHA_MEDICION": datetime(2003, 1, 2)}])
    w.refresh_new()
    for name in ("series_tiempo", "series_areas", "cobertura_series"):
        first, second = w.log.latest()[1]["tables"][name]["parts"]
        assert first["without_years"] == [2003]
        assert {r.ANIO for r in spark.read.parquet(f"{w.root}/{second['path']}").select("ANIO").collect()} == {2003}
    for name in ("series_tiempo", "series_areas"):
        text = w.table(name)._jdf.queryExecution().executedPlan().toString()
        assert text.count("PartitionFilters: [") == 2 and "NOT (ANIO#" in text.split("PartitionFilters: [")[1]
    assert [r["caudal"] for r in dicts(w.area_series("shac", "caudal", "5"))] == [5.0, 1.0, 1.0, 1.0, 1.0, 1.0]
    assert len(w.log.latest()[1]["tables"]["datos"]["parts"]) == 2


def test_a_changed_file_means_a_full_refresh(spark, tmp_path):
    path = str(tmp_path / "hechos")
    add(spark, path, [{"CAUDAL": 1.0}])
    w = Warehouse(spark, StoredFact(spark, path), str(tmp_path / "tablas"))
    assert set(w.refresh_new()) == set(TABLES)  # nothing was refreshed yet
    fact(spark, {"CAUDAL": 3.0}).coalesce(1).write.mode("overwrite").parquet(path)
    changed = Warehouse(spark, StoredFact(spark, path), w.root)
    assert set(changed.refresh_new()) == set(TABLES)
    assert [r["caudal_promedio"] for r in dicts(changed.table("puntos_mapa"))] == [3.0]
    with pytest.raises(ValueError):
        Warehouse(spark, fact(spark, {}), w.root).refresh_new()


def test_many_folders_become_one(spark, tmp_path):
    path = str(tmp_path / "hechos")
    add(spark, path, [{"CAUDAL": 0.0}])
    w = Warehouse(spark, StoredFact(spark, path), str(tmp_path / "tablas"))
    w.refresh(["datos"])
    w.refresh()
    most = 0
    for i in range(1, MAX_PARTS + 2):
        add(spark, path, [{"CAUDAL": float(i)}])
        w.refresh_new()
        most = max(most, len(w.log.latest()[1]["tables"]["datos"]["parts"]))
    assert most == MAX_PARTS and len(w.log.latest()[1]["tables"]["datos"]["parts"]) < MAX_PARTS
    assert w.table("datos").count() == MAX_PARTS + 2


# -- Rewriting single files ------------------------------------------------------------------


def test_an_update_of_one_basin_writes_its_files_only(spark, tmp_path):
    many = [{"COD_CUENCA": 100 + i % 40, "NOM_CUENCA": f"c{i % 40}", "COD_SUBCUENCA": 1, "COD_SUBSUBCUENCA": 2, "UTM_NORTE": 1000 * (i % 40), "CODIGO": f"OB-{i}", "TIPO_DERECHO": 1,
             "VOLUMEN_ANUAL": float(i)} for i in range(400)]
    w = Warehouse(spark, fact(spark, *many), str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        w.refresh()
        for name in ("puntos_mapa", "cuenca_stats"):
            columns = S.RIGHTS if name == "puntos_mapa" else S.BASIN_RIGHTS
            w.update(name, lambda df: df.withColumns({c: F.lit(None).cast(dict(df.dtypes)[c]) for c in columns}))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = w.table("puntos_mapa")
    files = len(before.inputFiles())
    w.update_rights(cod_cuenca=107)
    after = w.table("puntos_mapa")
    first, second = w.log.latest()[1]["tables"]["puntos_mapa"]["parts"]
    assert files >= 4 and 1 <= len(first["without_files"]) <= 2
    written = spark.read.parquet(f"{w.root}/{second['path']}")
    assert 10 <= written.count() < 400 / 2 and written.where("Cod_Cuenca = 107").count() == 10
    assert after.count() == 400
    assert {r.Cod_Cuenca for r in after.where("VOLUMEN_ANUAL IS NOT NULL").collect()} == {107}
    stats = {r["Cod_Cuenca"]: r["puntos_con_derechos"] for r in dicts(w.table("cuenca_stats"))}
    assert stats[107] == 1 and stats[108] is None
    text = after._jdf.queryExecution().executedPlan().toString()
    assert "file_name" in text
    w.update_rights(cod_cuenca=108)
    w.update_rights(cod_cuenca=107)
    assert w.table("puntos_mapa").count() == 400
    assert {r.Cod_Cuenca for r in w.table("puntos_mapa").where("VOLUMEN_ANUAL IS NOT NULL").collect()} == {107, 108}
    w.clean(grace=0)
    w.update_rights()
    assert len(w.log.latest()[1]["tables"]["puntos_mapa"]["parts"]) == 1
    assert w.table("puntos_mapa").where("VOLUMEN_ANUAL IS NULL").count() == 0


def test_left_out_files_are_not_listed(spark, tmp_path):
    """The condition on file names is met before any file is opened."""
    many = [{"COD_CUENCA": i % 8, "CODIGO": f"OB-{i}", "UTM_NORTE": 1000 * (i % 8)} for i in range(64)]
    w = Warehouse(spark, fact(spark, *many), str(tmp_path))
    w.refresh()
    w.update("puntos_mapa", lambda df: df.withColumn("codigo", F.lit("x")), only={"Cod_Cuenca": 3})
    (part, _) = w.log.latest()[1]["tables"]["puntos_mapa"]["parts"]
    for name in part["without_files"]:
        (tmp_path / part["path"] / name).unlink()
    assert Warehouse.open(spark, w.root).table("puntos_mapa").where("codigo = 'x'").count() == 8


# -- Areas and figures ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def random_store(spark, tmp_path_factory):
    w = Warehouse(spark, fact(spark, *reports(3, 500, (2000, 2001))), str(tmp_path_factory.mktemp("areas")))
    w.refresh()
    return w


@pytest.mark.parametrize("metric", sorted(METRICS))
@pytest.mark.parametrize("level, identifier", [
    ("cuenca", "101"), ("cuenca", "Rio"), ("subcuenca", "7"), ("subsubcuenca", "101011"), ("shac", "121"), ("shac", "S1"), ("shac", "nada")])
def test_the_cube_answers_as_the_series_does(random_store, level, identifier, metric):
    w = random_store
    more = [{"well": False}, {"start": "2000-05-02", "end": "2001-05-01"}, {"collation": "UTF8_LCASE"}]
    for given in ({}, {"well": True}, *(more if metric == "caudal" else ())):
        plain = area_series(w.table("series_tiempo"), w.table("puntos_mapa"), level, metric, identifier, **given)
        days = cube.read_area_series(w.table("series_areas"), level, metric, identifier, **given)
        assert plain.columns == days.columns and plain.dtypes == days.dtypes
        assert rows(plain) == rows(days)
        dates = [r.fecha_medicion for r in days.collect()]
        assert [d for d in dates if d] == sorted((d for d in dates if d), reverse=True)


def test_stored_figures_equal_a_scan(random_store):
    w = random_store
    assert w.record_count().collect() == row_count(w.fact).collect()
    scanned = [checks.column_coverage(t, n, S.EXPECTED_COLUMNS[n]) for n, t in (
        ("Puntos_Mapa", w.table("puntos_mapa")), ("Series_Tiempo", w.table("series_tiempo")), ("Mediciones_full", w.fact))]
    got = w.column_coverage()
    assert got.dtypes == scanned[0].dtypes
    assert rows(got) == sorted(sum((rows(s) for s in scanned), []))


def test_figures_of_an_empty_fact_are_zero(spark, tmp_path):
    w = Warehouse(spark, fact(spark), str(tmp_path))
    w.refresh()
    assert w.record_count().first()[0] == 0
    assert {r["no_nulos"] for r in dicts(w.column_coverage())} == {0}
    assert w.area_series("shac", "caudal", "1").count() == 0


# -- Texts and bits ---------------------------------------------------------------------------


def test_texts_are_found_through_the_index_as_by_a_scan(spark, tmp_path):
    codes = ["OB-1", "ob-1", "OB-12", "ñandú-1", "aaaa", "aa", "", None, "a%b", "a_b-c", "x[1]y", "日本語です", "OB"]
    w = Warehouse(spark, fact(spark, *({"CODIGO": c, "SECTOR_SHA": c} for c in codes)), str(tmp_path))
    w.refresh()
    points = w.table("puntos_mapa")
    for text in ("OB-1", "OB-", "B-12", "aaa", "aa", "", "%", "a_b", "x[1]", "[0-9]", "本語で", "nada", "ñan", "aaaaa"):
        for column in ("codigo", "SECTOR_SHA"):
            found = text_index.rows_with(points, w.table("textos_puntos"), column, text)
            assert rows(found) == rows(points.where(contains_text(F.col(column), text))), text
        indexed = "textos_puntos" in w.list_points(PointFilter(codigo_obra=text))._jdf.queryExecution().executedPlan().toString()
        assert indexed == (len(text) >= 3 and not set(text) & set("%_["))


def test_a_text_search_reads_its_postings_only(random_store):
    text = random_store.list_points(PointFilter(codigo_obra="B-1"))._jdf.queryExecution().executedPlan().toString()
    assert "In(trigrama" in text or "EqualTo(trigrama,B-1)" in text
    assert "LeftSemi" in text and "EqualTo(columna,codigo)" in text


def test_points_are_counted_by_bits(spark, tmp_path):
    many = [{"UTM_NORTE": i if i % 7 else None, "UTM_ESTE": i % 11, "COD_CUENCA": 100 + i % 3, "NOM_CUENCA": f"c{i % 2}", "COD_SUBCUENCA": i % 4 or None,
             "REGION": i % 5} for i in range(700)]
    w = Warehouse(spark, fact(spark, *many), str(tmp_path))
    w.refresh()
    got = {(r["nivel"], r["region"], r["cod_cuenca"], r["cod_subcuenca"]): r["total_puntos_unicos"]
           for r in dicts(w.points_by_level()) if r["nivel"] != "subsubcuenca"}
    places = {}
    for r in many:
        c, s, g = r["COD_CUENCA"], r["COD_SUBCUENCA"], r["REGION"]
        for key in (("total", None, None, None), ("region", g, None, None), ("cuenca", None, c, None), ("subcuenca", None, c, s)):
            places.setdefault(key, set()).add((r["UTM_NORTE"], r["UTM_ESTE"]))
    assert got == {k: len(v) for k, v in places.items()}
    names = {r["nom_cuenca"]: r["total_puntos"] for r in dicts(w.table("filtros_reactivos_stats")) if r["nivel"] == "cuenca"}
    assert names == {f"c{n}": len({(r["UTM_NORTE"], r["UTM_ESTE"]) for r in many if r["NOM_CUENCA"] == f"c{n}"}) for n in (0, 1)}
    for df in (w.points_by_level(), w.basin_stats()):
        assert "distinct" not in df._jdf.queryExecution().executedPlan().toString()
