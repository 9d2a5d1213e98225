"""Writing, reopening and refreshing the stored tables; settings and sinks."""

import glob
from datetime import date, datetime
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from acequia import Warehouse
from acequia import schema as S
from acequia.operators.updates import update_from
from acequia.plans.registry import sample_root, warehouse
from acequia.plans.warehouse import TABLES, dependants
from acequia.session import session_settings
from acequia.sources import read_fact, read_table, shared_folder, write_csv, write_table
from acequia.sources.fact import conform, jdbc_slices
from acequia.sources.sample import sample_fact
from conftest import SF_SMALL
from facts import dicts, fact


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def sample(spark):
    return sample_fact(spark, SF_SMALL)


@pytest.fixture(scope="module")
def stored(spark, sample, tmp_path_factory):
    w = Warehouse(spark, sample, str(tmp_path_factory.mktemp("warehouse")))
    w.refresh()
    return w


@pytest.mark.parametrize("name", sorted(TABLES))
def test_stored_table_equals_its_plan(spark, sample, stored, name):
    planned, read = Warehouse(spark, sample).table(name), stored.table(name)
    assert sorted(planned.columns) == sorted(read.columns)
    if name == "puntos_bitmap":
        planned, read = (t.selectExpr("* EXCEPT (bits)", "hex(bits) AS bits") for t in (planned, read))
    rounded = [f"round({c}, 6) AS {c}" if t == "double" else c for c, t in sorted(planned.dtypes)]
    assert rows(planned.selectExpr(*rounded)) == rows(read.selectExpr(*rounded))


def test_reopened_tables_answer_the_same(spark, stored):
    opened = Warehouse.open(spark, stored.root)
    for ask in (
        lambda w: w.area_series("cuenca", "caudal", "115", well=True, start="1996-01-01"),
        lambda w: w.area_series("shac", "nivel_freatico", "121"),
        lambda w: w.reporters(),
        lambda w: w.basin_stats(include_global=True),
    ):
        assert [tuple(r) for r in ask(opened).collect()] == [tuple(r) for r in ask(stored).collect()]
    with pytest.raises(ValueError):
        opened.fact
    assert opened.record_count().first()[0] == stored.fact.count()


def test_refresh_replaces_the_rows(spark, tmp_path):
    root = str(tmp_path)
    Warehouse(spark, fact(spark, {"CAUDAL": 1.0}, {"CODIGO": "b"}), root).refresh()
    second = Warehouse(spark, fact(spark, {"CAUDAL": 5.0}), root)
    second.refresh()
    assert second.table("puntos_mapa").count() == 1
    assert dicts(second.area_series("cuenca", "caudal", "101"))[0]["caudal"] == 5.0
    second.refresh(["informante"])
    assert second.table("informante").count() == 0


def test_reads_never_write(spark, tmp_path):
    root = str(tmp_path)
    first = Warehouse(spark, fact(spark, {"CAUDAL": 1.0}), root)
    with pytest.raises(ValueError, match="refresh first"):
        first.count_points()
    with pytest.raises(ValueError, match="refresh first"):
        Warehouse.open(spark, root)
    first.refresh()
    files = sorted(p for p in tmp_path.rglob("*"))
    second = Warehouse(spark, fact(spark, {"CAUDAL": 1.0}, {"CODIGO": "b"}), root)
    assert dicts(second.count_points())[0]["total_puntos_unicos"] == 1
    assert sorted(p for p in tmp_path.rglob("*")) == files


def test_refresh_rebuilds_what_follows(spark, tmp_path):
    root = str(tmp_path)
    Warehouse(spark, fact(spark, {"CAUDAL": 1.0}), root).refresh()
    second = Warehouse(spark, fact(spark, {"CAUDAL": 1.0}, {"CODIGO": "b", "CAUDAL": 7.0}), root)
    assert set(second.refresh(["rollup_puntos"])) == {
        "rollup_puntos", "puntos_numero", "puntos_bitmap", "cuencas_regiones", "puntos_mapa", "textos_puntos",
        "series_areas", "cuenca_stats", "filtros_reactivos_stats"}
    assert second.table("puntos_mapa").count() == 2
    assert [r["total_mediciones"] for r in dicts(second.basin_stats())] == [2]
    assert dependants(["series_tiempo"]) == ["series_tiempo", "series_puntos", "series_areas", "cobertura_series"]
    with pytest.raises(ValueError):
        second.refresh(["otra"])


def test_a_version_is_published_at_once(spark, tmp_path):
    root = str(tmp_path)
    first = Warehouse(spark, fact(spark, {"CAUDAL": 1.0}), root)
    first.refresh()
    reader = Warehouse.open(spark, root)
    before = reader.table("puntos_mapa")
    broken = Warehouse(spark, fact(spark, {"CAUDAL": 2.0}).withColumn("INF", F.raise_error("lost").cast("int")), root)
    with pytest.raises(Exception, match="lost"):
        broken.refresh()
    assert dicts(Warehouse.open(spark, root).table("puntos_mapa"))[0]["caudal_promedio"] == 1.0
    Warehouse(spark, fact(spark, {"CAUDAL": 3.0}), root).refresh()
    assert dicts(before)[0]["caudal_promedio"] == 1.0
    assert dicts(Warehouse.open(spark, root).table("puntos_mapa"))[0]["caudal_promedio"] == 3.0


def test_a_year_that_is_gone_leaves_the_series(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for days in ((datetime(1999, 1, 1), datetime(2001, 1, 1)), (datetime(2001, 1, 1),)):
            w = Warehouse(spark, fact(spark, *({"FECHA_MEDICION": d, "CAUDAL": 1.0} for d in days)), str(tmp_path / "w"))
            w.refresh()
        assert [r["ANIO"] for r in dicts(w.table("series_tiempo"))] == [2001]
        for n in (2, 1):
            write_table(spark.range(n).selectExpr("id AS x", "id AS y"), str(tmp_path / "p"), partition_by=("x",))
        assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_rights_update_is_stored(spark, tmp_path):
    f = fact(spark, {"TIPO_DERECHO": 1, "VOLUMEN_ANUAL": 5.0}, {"UTM_NORTE": 77, "CODIGO": "b"})
    w = Warehouse(spark, f, str(tmp_path))
    w.refresh()
    w.update("puntos_mapa", lambda df: df.drop(*S.RIGHTS))
    assert "VOLUMEN_ANUAL" not in Warehouse.open(spark, w.root).table("puntos_mapa").columns
    w.update_rights()
    stored = Warehouse.open(spark, w.root).table("puntos_mapa")
    assert sorted((r["VOLUMEN_ANUAL"] or 0.0) for r in dicts(stored)) == [0.0, 5.0]


def test_update_refuses_a_repeated_key(spark):
    target = spark.createDataFrame([(1, None)], "k int, v double")
    source = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double")
    with pytest.raises(Exception, match="repeats a key"):
        update_from(target, source, {"k": "k"}, ["v"]).collect()
    once = source.where("v = 2").union(spark.createDataFrame([(None, 9.0), (None, 8.0)], "k int, v double"))
    assert [r.v for r in update_from(target, once, {"k": "k"}, ["v"]).collect()] == [2.0]


def test_tables_answer_sql_by_name(spark, stored):
    stored.create_views()
    (row,) = spark.sql("""
        SELECT count(*) AS n, max(p.es_pozo_subterraneo) AS pozo
        FROM Series_Tiempo s JOIN Puntos_Mapa p ON s.UTM_NORTE = p.UTM_Norte AND s.UTM_ESTE = p.UTM_Este
        WHERE s.COD_CUENCA = 115 AND s.ANIO = 1996""").collect()
    assert row.n > 0 and row.pozo is True


def test_refresh_needs_a_folder(spark):
    with pytest.raises(ValueError):
        Warehouse(spark, fact(spark, {})).refresh()


def test_first_build_does_not_replace(spark, tmp_path):
    df, path = spark.range(3).toDF("x"), str(tmp_path / "t")
    write_table(df, path, mode="errorifexists")
    with pytest.raises(AnalysisException):
        write_table(df, path, mode="errorifexists")
    write_table(spark.range(2).toDF("x"), path)
    assert read_table(spark, path, df.schema).count() == 2
    with pytest.raises(ValueError):
        write_table(df, path, mode="append")


def test_csv_sink(spark, tmp_path):
    path = str(tmp_path / "log")
    write_csv(spark.createDataFrame([("a", 1.5), ("b", None)], "endpoint string, time_ms double").coalesce(1), path)
    (part,) = glob.glob(f"{path}/*.csv")
    with open(part) as f:
        assert f.read().splitlines() == ["endpoint,time_ms", "a,1.5", "b,"]


def test_fact_is_read_with_its_schema(spark, sample, tmp_path):
    path = str(tmp_path / "fact")
    write_table(sample, path)
    assert read_fact(spark, path).schema == S.FACT
    assert read_fact(spark, path).count() == sample.count()
    odd = sample.selectExpr("cast(utm_norte AS bigint) AS utm_norte", *[c.lower() for c in S.FACT.names[1:]])
    assert conform(odd).schema.simpleString() == S.FACT.simpleString()


def test_tables_go_to_the_folder_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named
    assert warehouse(spark, SF_SMALL).root.startswith(f"{named}/acequia/")
    assert warehouse(spark, SF_SMALL) is warehouse(spark, SF_SMALL)


@pytest.mark.parametrize("master", ["local[4]", "yarn"])
def test_the_library_needs_a_named_folder(master):
    session = SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        shared_folder(session)
    if master == "yarn":
        with pytest.raises(ValueError):
            sample_root(session)


def test_settings_follow_the_data():
    small, large = session_settings(1, 8), session_settings(100 * 10**12, 4000)
    assert small["spark.sql.shuffle.partitions"] == "8"
    for s in (small, large):
        assert s["spark.sql.files.maxPartitionBytes"] == str(128 * 1024**2)
    assert int(large["spark.sql.shuffle.partitions"]) == -(-(100 * 10**12) // (128 * 1024**2))
    assert session_settings(100, 1, partition_bytes=10)["spark.sql.shuffle.partitions"] == "10"


def test_jdbc_slices_hold_every_row_once():
    slices = jdbc_slices("d", [date(2000, 1, 1), date(2001, 1, 1)], null_key="k", null_parts=3)
    rows = [(d, k) for d in ("1999-05-05", "2000-01-01", "2000-07-07", "2001-01-01", "2009-01-01", None)
            for k in (-4, -1, 0, 5, None)]
    db = duckdb.connect()
    db.execute("CREATE TABLE t (d DATE, k INT)")
    db.executemany("INSERT INTO t VALUES (?, ?)", rows)
    found = [r for s in slices for r in db.execute(f"SELECT * FROM t WHERE {s}").fetchall()]
    assert len(found) == len(rows) and len(slices) == 7
    assert jdbc_slices("n", [5]) == ["n < 5", "n >= 5", "n IS NULL"]
    with pytest.raises(ValueError):
        jdbc_slices("n", [5, 5])


@pytest.mark.parametrize("table, key", [("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("orders", "o_orderkey")])
def test_sample_keys_are_unique(spark, table, key):
    keys = spark.read.parquet(f"{SF_SMALL}/{table}.parquet").select(key)
    assert keys.count() == keys.distinct().count()
