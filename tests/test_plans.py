"""The physical plans: what reaches the scan, how tables join, what is shuffled."""

import glob
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from acequia import Warehouse, schema as S
from acequia.operators import builds, checks, rollup
from acequia.plans.registry import registered
from acequia.plans.warehouse import TABLES, Source, basin_stats
from acequia.sources import read_fact, write_table
from acequia.sources.sample import sample_fact
from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return re.findall(r"FileScan parquet \[([^\]]*)\].*?ReadSchema: struct<([^>]*)>", text)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    w = Warehouse(spark, sample_fact(spark, SF_SMALL), str(tmp_path_factory.mktemp("planes")))
    w.refresh()
    return w


@pytest.fixture(scope="module")
def fact(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hechos") / "fact")
    write_table(sample_fact(spark, SF_SMALL), path)
    return read_fact(spark, path)


@pytest.mark.parametrize("key", sorted(registered()))
def test_no_cross_join_and_no_python(spark, key):
    text = plan(registered()[key](spark, SF_SMALL))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "MapInPandas", "FlatMapGroups"):
        assert node not in text, node


@pytest.mark.parametrize("build, joined", [
    (builds.measurements, set()),
    (builds.daily_series, {"supplier", "nation"}),
    (rollup.point_rollup, {"supplier", "nation"}),
    (builds.reporters, {"supplier", "orders"}),
])
def test_sample_fact_joins_only_what_is_read(spark, build, joined):
    text = plan(build(sample_fact(spark, SF_SMALL)))
    assert {t for t in ("supplier", "nation", "orders") if f"/{t}.parquet" in text} == joined


def test_series_read_prunes_years_rows_and_columns(stored):
    text = plan(stored.area_series("cuenca", "caudal", "115", start="1996-01-01", end="1996-12-31"))
    assert re.search(r"PartitionFilters: \[[^\]]*ANIO#\d+ >= 1996\)[^\]]*ANIO#\d+ <= 1996\)", text)
    assert "NIVEL#" in text and "EqualTo(CODIGO,115)" in text and "GreaterThan(CAUDAL_n_todas,0)" in text
    (columns, _), = scans(text)
    assert len(columns.split(",")) == 8 and "NIVEL_FREATICO" not in text and "pozo" not in text
    assert "Join" not in text


@pytest.mark.parametrize("level, identifier, well", [
    ("shac", "121", None), ("shac", "Sector 1", True), ("cuenca", "115", True), ("subsubcuenca", "115000", False)])
def test_areas_of_the_catalog_are_read_without_a_join(stored, level, identifier, well):
    """Sectors and wells: one scan of the area's own rows, in which one shuffle moves a row per day."""
    text = plan(stored.area_series(level, "caudal", identifier, well=well))
    assert "Join" not in text and len(scans(text)) == 1 and "series_areas" in text
    assert re.search(rf"PartitionFilters: \[[^\]]*\(NIVEL#\d+ = {level}\)", text)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\((CODIGO|NOMBRE),", text)
    assert text.count("Exchange hashpartitioning(FECHA_MEDICION") == 1 and "partial_sum" in text


def test_an_area_read_scans_one_row_per_day(spark, stored):
    days = stored.table("series_areas").where("NIVEL = 'shac' AND CODIGO = 121")
    series = stored.table("series_tiempo")
    assert days.groupBy("NOMBRE", "FECHA_MEDICION").count().where("count > 1").isEmpty()
    assert days.count() < series.count() / 3


def test_point_read_pushes_both_coordinates(stored):
    text = plan(stored.point_series("nivel_freatico", 6000000, 300000))
    assert "EqualTo(UTM_NORTE,6000000)" in text and "EqualTo(UTM_ESTE,300000)" in text


def test_several_points_need_no_join(stored):
    text = plan(stored.point_statistics([(6000000, 300000), (6000100, 301000)]))
    assert "Join" not in text and "In(UTM_NORTE, [6000000,6000100])" in text


@pytest.mark.parametrize("build, columns", [
    (builds.measurements, 9),
    (builds.basin_catalog, 7),
    (builds.reporters, 10),
    (builds.daily_series, 13),
    (rollup.point_rollup, 20 + 3 + len(S.RIGHTS)),
    (builds.flow_range_per_point, 5),
])
def test_builds_scan_the_fact_once_and_read_their_columns(fact, build, columns):
    found = scans(plan(build(fact)))
    assert len(found) == 1
    assert len(found[0][0].split(",")) == columns


@pytest.mark.parametrize("build", [
    builds.measurements, builds.basin_catalog, builds.reporters, builds.daily_series, builds.rights_per_point,
    builds.flow_range_per_point, rollup.point_rollup,
])
def test_builds_combine_before_their_only_shuffle(fact, build):
    text = plan(build(fact))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_top_rows_need_no_full_sort(stored):
    assert "TakeOrderedAndProject" in plan(stored.list_points())
    assert "TakeOrderedAndProject" in plan(stored.reporters())


def test_filter_ranges_share_one_exchange(spark, fact):
    df = builds.filter_stats(builds.flow_range_per_point(fact))
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_basin_statistics_read_the_fact_once(spark, fact, tmp_path):
    w = Warehouse(spark, fact, str(tmp_path))
    w.refresh(["rollup_puntos"])
    text = plan(basin_stats(Source(w)))
    assert "rollup_puntos" in text and "hechos" not in text


def test_series_by_coordinate_is_shuffled_once(fact):
    assert plan(builds.daily_series_by_coord(fact)).count("Exchange hashpartitioning") == 1


def test_overall_figures_are_one_subquery(stored):
    df = stored.basin_stats(include_global=True)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("scalar-subquery") <= 4 and len(text) < 20_000


def overlapping(folder, columns, place):
    """Files and row groups, and how many of them may hold a coordinate by their statistics."""
    files = groups = hit_files = hit_groups = 0
    for path in glob.glob(f"{folder}/**/*.parquet", recursive=True):
        meta, hit = pq.read_metadata(path), False
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            stats = [meta.row_group(g).column(names.index(c)).statistics for c in columns]
            inside = all(s.has_min_max and s.min <= v <= s.max for s, v in zip(stats, place, strict=True))
            groups, hit_groups, hit = groups + 1, hit_groups + inside, hit or inside
        files, hit_files = files + 1, hit_files + hit
    return files, hit_files, groups, hit_groups


@pytest.mark.parametrize("table, columns", [
    ("series_puntos", ("UTM_NORTE", "UTM_ESTE")), ("datos", ("UTM_Norte", "UTM_Este"))])
def test_a_coordinate_lies_in_few_files(spark, tmp_path, table, columns):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        w = Warehouse(spark, sample_fact(spark, SF_SMALL), str(tmp_path))
        w.refresh(["series_tiempo", "datos"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    folder = w.table(table).inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    files, hit_files, groups, hit_groups = overlapping(folder, columns, (6000500, 301000))
    assert files >= 6 and 1 <= hit_files <= 2 and hit_groups <= 2


def test_coverage_shuffles_counts_only(stored):
    df = checks.point_coverage(stored.table("puntos_mapa"), stored.table("datos"), stored.table("series_puntos"), "tor")
    text = plan(df)
    assert "LeftSemi" not in text and text.count("partial_count(1)") >= 2


def rows_scanned(df):
    """Rows that the scan of an executed plan hands on, before its filter."""
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        for i in range(node.children().size()):
            nodes.append(node.children().apply(i))
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
    return found


def grid(spark, side):
    """A catalog of ``side`` by ``side`` points, in no useful order, basins striped across it."""
    return spark.range(side * side).selectExpr(
        f"cast(6000000 + 100 * (id * 7919 % {side}) AS int) AS UTM_Norte", f"cast(300000 + 100 * (id div {side}) AS int) AS UTM_Este",
        "cast(id % 50 AS int) AS Cod_Cuenca", "concat('OB-', id) AS codigo", "1.0D AS caudal_promedio", "id AS n_mediciones")


@pytest.mark.parametrize("side", [60, 190])
def test_one_point_reads_as_many_rows_of_a_catalog_ten_times_as_large(spark, tmp_path, side):
    spec = TABLES["puntos_mapa"]
    write_table(grid(spark, side).coalesce(4), str(tmp_path / "t"), near_by=spec.near_by, range_by=spec.range_by, options=spec.options)
    stored = spark.read.parquet(str(tmp_path / "t"))
    for norte, este in ((6000000 + 100 * (side // 3), 300000 + 100 * (side // 2)), (6000500, 300700)):
        found = stored.where((F.col("UTM_Norte") == norte) & (F.col("UTM_Este") == este)).select("codigo")
        assert found.count() == 1
        assert 0 < rows_scanned(found.select("codigo")) <= 3000


def test_points_at_one_place_are_spread_by_their_other_columns(spark, tmp_path):
    df = spark.range(8000).selectExpr("1 AS UTM_Norte", "2 AS UTM_Este", "cast(id % 40 AS int) AS Cod_Cuenca", "string(id) AS codigo")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_table(df, str(tmp_path / "t"), near_by=("UTM_Norte", "UTM_Este"), range_by=("Cod_Cuenca", "codigo"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [pq.read_metadata(f).num_rows for f in glob.glob(f"{tmp_path}/t/*.parquet")]
    assert len(sizes) >= 6 and max(sizes) < 3000


def test_pooled_statistics_scan_the_series_once(stored):
    places = stored.table("puntos_mapa").selectExpr("UTM_Norte AS UTM_NORTE", "UTM_Este AS UTM_ESTE")
    assert plan(stored.pooled_statistics(places)).count("FileScan parquet [UTM_NORTE#") == 1


def test_stored_figures_need_no_scan_of_fact_or_series(stored):
    for df in (stored.record_count(), stored.column_coverage()):
        text = plan(df)
        assert "lineitem" not in text and "series_tiempo" not in text and "/informante" not in text
