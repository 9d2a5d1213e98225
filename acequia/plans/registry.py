"""The registered queries over the sample tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from acequia import schema as S
from acequia.operators import basins, builds, checks, points, reporters, request_log, rights, rollup, updates
from acequia.operators.filters import PointFilter
from acequia.plans.warehouse import Source, Warehouse, basin_stats
from acequia.sources.fact import StoredFact
from acequia.sources.sample import sample_fact
from acequia.sources.tables import read_csv, read_table, shared_folder, write_csv, write_table

Query = Callable[[Warehouse, str], DataFrame]

_POINT = (6000000, 300000)
_warehouses: dict[str, Warehouse] = {}
_own_folder: list[str] = []
_lock = threading.RLock()


def sample_root(spark: SparkSession) -> str:
    """Where the tables of the samples go: the shared folder that the session names.

    A local session that names none, as in tests, gets a folder of its own. Executors of
    a cluster share no local disk, so there it is an error.
    """
    master = spark.sparkContext.master
    if spark.conf.get("spark.checkpoint.dir", None) or not master.startswith("local") or "cluster" in master:
        return shared_folder(spark)
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="acequia-"))
    return _own_folder[0]


def _version(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the sample's files, so that changed files are read anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return ";".join(sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files))


class BuiltOnRead(Warehouse):
    """A warehouse in which the first read of a table builds it and what it is computed from."""

    def table(self, name: str) -> DataFrame:
        self.build_missing([name])
        return super().table(name)


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    """Derived tables of one folder of sample tables, each built once per application and version
    of the files, when it is first read."""
    label = sha256(f"{folder}\n{_version(spark, folder)}".encode()).hexdigest()[:16]
    root = f"{sample_root(spark)}/acequia/{spark.sparkContext.applicationId}/{label}"
    with _lock:
        if root not in _warehouses:
            _warehouses[root] = BuiltOnRead(spark, sample_fact(spark, folder), root)
        return _warehouses[root]


# Queries whose doubles are stored or largest values, not sums or means.
EXACT = {"fact_scan", "build_measurements", "scan_measurements", "merged_measurements",
         "measurements_sample", "rights_per_point"}


def presented(df: DataFrame, exact: bool) -> DataFrame:
    """Computed doubles to six decimals, dates and timestamps as text, so engines compare equal."""
    def shown(field: T.StructField):
        c = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType) and not exact:
            c = F.round(c, 6)
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        return c.alias(field.name)

    return df.select(*map(shown, df.schema.fields))


def _build(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda w, _: f(w.fact)


def _stored(name: str) -> Query:
    return lambda w, _: w.table(name).drop(*S.SERIES_STATE)


def _read(f: Callable[[Warehouse], DataFrame]) -> Query:
    return lambda w, _: f(w)


def _area(level: str, metric: str, identifier: str, **given) -> Query:
    return lambda w, _: w.area_series(level, metric, identifier, **given)


def _roundtrip(w: Warehouse, _: str) -> DataFrame:
    """Write the point catalog over its previous version and read it back."""
    df = rollup.points(w.table("rollup_puntos"))
    path = f"{w.root}/ida_y_vuelta"
    write_table(df, path, sort_by=("Cod_Cuenca", "UTM_Norte", "UTM_Este"))
    return read_table(w.spark, path, df.schema)


def _csv_roundtrip(w: Warehouse, _: str) -> DataFrame:
    """Write the reporters as CSV files with a header and read them back."""
    df, path = w.reporters(limit=None), f"{w.root}/informantes_csv"
    write_csv(df, path)
    return read_csv(w.spark, path, df.schema)


def _create_once(w: Warehouse, _: str) -> DataFrame:
    """A first build into a folder of its own; a second one there must not replace it."""
    path = f"{w.root}/una_vez/{uuid.uuid4().hex}"
    write_table(w.table("cuencas_regiones"), path, mode="errorifexists")
    try:
        write_table(w.table("cuencas_regiones").limit(0), path, mode="errorifexists")
    except AnalysisException:
        return read_table(w.spark, path, w.table("cuencas_regiones").schema)
    raise RuntimeError("the first build was replaced")


def _first(n: int, f: Callable[[Warehouse], DataFrame]) -> Query:
    """The first ``n`` rows in the read's own order, so that the order decides the rows."""
    return lambda w, _: f(w).limit(n)


def _points_without_rights(w: Warehouse) -> DataFrame:
    return updates.with_missing_columns(w.table("puntos_mapa").drop(*S.RIGHTS), S.POINT_RIGHT_TYPES)


def _once(name: str, make: Callable[[Warehouse, str], Warehouse]) -> Callable[[Warehouse, str], Warehouse]:
    """A further warehouse under a root of its own, made once for each warehouse of samples."""
    def made(w: Warehouse, folder: str) -> Warehouse:
        root = f"{w.root}/{name}"
        with _lock:
            if root not in _warehouses:
                _warehouses[root] = make(w, root)
            return _warehouses[root]
    return made


def _with_rights_updated(w: Warehouse, root: str) -> Warehouse:
    """Points and basins are stored without rights, then updated."""
    old = Warehouse(w.spark, None, root)
    old.publish({
        "rollup_puntos": w.table("rollup_puntos"),
        "puntos_mapa": w.table("puntos_mapa").drop(*S.RIGHTS),
        "cuenca_stats": w.table("cuenca_stats").drop(*S.BASIN_RIGHTS),
    })
    old.update_rights()
    return old


def _with_one_basin_updated(w: Warehouse, root: str) -> Warehouse:
    """Points and basins whose rights are all NULL, then updated in one basin."""
    old = Warehouse(w.spark, None, root)
    old.publish({
        "rollup_puntos": w.table("rollup_puntos"),
        "puntos_mapa": w.table("puntos_mapa").withColumns(
            {c: F.lit(None).cast(t) for c, t in S.POINT_RIGHT_TYPES.items()}),
        "cuenca_stats": w.table("cuenca_stats").withColumns(
            {c: F.lit(None).cast(t) for c, t in S.BASIN_RIGHT_TYPES.items()}),
    })
    old.update_rights(cod_cuenca=115)
    return old


def _arrives_late() -> Column:
    """Reports of the last months, and some of another year or without a date."""
    date = F.col("FECHA_MEDICION")
    recent = F.coalesce(date >= F.lit("1998-07-01").cast("timestamp_ntz"), F.lit(False))
    return recent | (F.coalesce(F.col("CAUDAL") > 49, F.lit(False)) & F.coalesce(F.year(date) == 1997, F.lit(True)))


def _with_new_files(*tables: str) -> Callable[[Warehouse, str], Warehouse]:
    """A fact of stored files, refreshed, to which later reports are added in a second file and merged."""
    def made(w: Warehouse, root: str) -> Warehouse:
        late, path = _arrives_late(), f"{root}/hechos"
        w.fact.where(~late).write.mode("overwrite").parquet(path)
        found = Warehouse(w.spark, StoredFact(w.spark, path), f"{root}/tablas", tables)
        found.refresh()
        w.fact.where(late).write.mode("append").parquet(path)
        found.refresh_new()
        return found
    return made


_updated_warehouse = _once("derechos", _with_rights_updated)
_basin_warehouse = _once("derechos_cuenca", _with_one_basin_updated)

# Tables of one pass over the fact are refreshed and merged together, and only when one of them is read.
_DELTAS = {name: _once(f"incremental/{name}", _with_new_files(*tables)) for name, tables in {
    "puntos": ("textos_puntos", "cuencas_regiones", "cuenca_stats", "filtros_reactivos_stats"),
    "datos": ("datos",),
    "informante": ("informante",),
    "series": ("series_puntos", "cobertura_series"),
    "areas": ("series_areas",),
}.items()}


def _updated(table: str) -> Query:
    """The stored result of an update of rights."""
    return lambda w, folder: _updated_warehouse(w, folder).table(table)


def _updated_basin(table: str) -> Query:
    return lambda w, folder: _basin_warehouse(w, folder).table(table)


def _merged(of: str, read: Callable[[Warehouse], DataFrame]) -> Query:
    """A read after new files were merged into stored tables."""
    return lambda w, folder: read(_DELTAS[of](w, folder))


def _pooled_locations(w: Warehouse, folder: str) -> DataFrame:
    """Statistics of all points that lie in a sector, as a table of locations."""
    places = w.table("puntos_mapa").where(F.col("COD_SECTOR_SHA").isNotNull()).select(
        F.col("UTM_Norte").alias("UTM_NORTE"), F.col("UTM_Este").alias("UTM_ESTE"))
    return w.pooled_statistics(places)


def _valid_locations(w: Warehouse, _: str) -> DataFrame:
    return points.mark_valid_locations(w.table("puntos_mapa").select("UTM_Norte", "UTM_Este").distinct())


def _valid_locations_range(w: Warehouse, folder: str) -> DataFrame:
    orders = w.spark.read.parquet(f"{folder}/orders.parquet")
    return points.mark_valid_locations(orders.select(
        "o_orderkey",
        (F.col("o_orderkey") * 1000).alias("UTM_NORTE"),
        (F.col("o_custkey") * 1000).alias("UTM_ESTE"),
    ))


def _column_coverage(w: Warehouse, _: str) -> DataFrame:
    """The stored figures, and those of a catalog that lacks a column."""
    without = w.table("puntos_mapa").drop("APR")
    return w.column_coverage().unionByName(
        checks.column_coverage(without, "Puntos_Mapa_sin_APR", ("UTM_Norte", "APR")))


def _request_log(w: Warehouse, folder: str) -> DataFrame:
    """Requests from the events table: errors have status 500, all others 200."""
    events = w.spark.read.parquet(f"{folder}/events.parquet")
    return events.select(
        F.col("user_id").alias("run_id"),
        F.lit("GET").alias("method"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("time_ms"),
    )


def _log(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda w, folder: f(_request_log(w, folder))


QUERIES: dict[str, Query] = {
    # Sources, sinks, updates.
    "fact_scan": _build(lambda fact: fact),
    "fact_row_count": _read(Warehouse.record_count),
    "gold_write_roundtrip": _roundtrip,
    "points_add_rights_columns": _read(_points_without_rights),
    "points_rights_update": _updated("puntos_mapa"),
    "basin_rights_update": _updated("cuenca_stats"),
    "points_rights_update_basin": _updated_basin("puntos_mapa"),
    "basin_rights_update_basin": _updated_basin("cuenca_stats"),
    "csv_roundtrip": _csv_roundtrip,
    "create_once": _create_once,
    # Builds from the fact.
    "build_measurements": _build(builds.measurements),
    "build_basin_catalog": _build(builds.basin_catalog),
    "build_reporters": _build(builds.reporters),
    "build_points": _build(lambda fact: rollup.points(rollup.point_rollup(fact))),
    "build_points_by_coord": _read(lambda w: rollup.points_by_coord(w.table("rollup_puntos"))),
    "build_daily_series": _build(builds.daily_series),
    "build_daily_series_by_coord": _build(builds.daily_series_by_coord),
    "rights_per_point": _build(builds.rights_per_point),
    "rights_per_basin": _build(lambda fact: builds.rights_per_basin(builds.rights_per_point(fact))),
    "rights_per_coord": _build(builds.rights_per_coord),
    "rollup_rights_per_basin": _read(lambda w: builds.rights_per_basin(
        rollup.rights_per_point(w.table("rollup_puntos")))),
    "rollup_rights_per_coord": _read(lambda w: rollup.rights_per_coord(w.table("rollup_puntos"))),
    "build_basin_stats": _read(lambda w: basin_stats(Source(w))),
    "build_filter_stats": _build(lambda fact: builds.filter_stats(builds.flow_range_per_point(fact))),
    "build_filter_stats_gsets": _build(
        lambda fact: builds.filter_stats_grouping_sets(builds.flow_range_per_point(fact))),
    # The stored tables, as a refresh writes them.
    "scan_measurements": _stored("datos"),
    "scan_basin_catalog": _stored("cuencas_regiones"),
    "scan_reporters": _stored("informante"),
    "scan_points": _stored("puntos_mapa"),
    "scan_daily_series": _stored("series_tiempo"),
    "scan_basin_stats": _stored("cuenca_stats"),
    "scan_filter_stats": _stored("filtros_reactivos_stats"),
    # The same tables after new reports were merged in.
    "merged_measurements": _merged("datos", lambda w: w.table("datos")),
    "merged_basin_catalog": _merged("puntos", lambda w: w.table("cuencas_regiones")),
    "merged_reporters": _merged("informante", lambda w: w.table("informante")),
    "merged_points": _merged("puntos", lambda w: w.table("puntos_mapa")),
    "merged_daily_series": _merged("series", lambda w: w.table("series_tiempo").drop(*S.SERIES_STATE)),
    "merged_basin_stats": _merged("puntos", lambda w: w.table("cuenca_stats")),
    "merged_filter_stats": _merged("puntos", lambda w: w.table("filtros_reactivos_stats")),
    "merged_series_sector_flow": _merged("areas", lambda w: w.area_series("shac", "caudal", "121")),
    "merged_series_point_flow": _merged("series", lambda w: w.point_series("caudal", *_POINT)),
    "merged_points_by_level": _merged("puntos", Warehouse.points_by_level),
    "merged_points_text": _merged("puntos", lambda w: w.list_points(PointFilter(codigo_obra="B-1"), limit=None)),
    "merged_fact_row_count": _merged("puntos", Warehouse.record_count),
    # Points.
    "points_count": _read(Warehouse.count_points),
    "points_count_filtered": _read(lambda w: w.count_points(PointFilter(
        region=1, caudal_minimo=20.0, caudal_maximo=30.0, pozo=False, shac=121, id_junta=1.0))),
    "points_count_null_subbasin": _read(lambda w: w.count_points(PointFilter(
        cod_cuenca=115, cod_subcuenca=11500, filtro_null_subcuenca=True))),
    "points_count_path": _read(lambda w: w.count_points(PointFilter(
        cod_subcuenca=11500, cod_subsubcuenca=115000, apr=True))),
    "points_list": _read(lambda w: w.list_points(PointFilter(
        cod_cuenca=115, pozo=True, codigo_obra="OB-", apr=False))),
    "points_list_default": _read(Warehouse.list_points),
    "points_list_text": _read(lambda w: w.list_points(PointFilter(codigo_obra="B-1"), limit=None)),
    "points_count_text": _read(lambda w: w.count_points(PointFilter(codigo_obra="-2-1"))),
    "points_list_class": _read(lambda w: w.list_points(PointFilter(codigo_obra="OB-[1-3]_-[^0]"), limit=None)),
    "points_list_wildcard": _read(lambda w: w.list_points(PointFilter(codigo_obra="OB-_1-"), limit=None)),
    "point_info": _read(lambda w: w.point_info(*_POINT)),
    "point_metric_stats": _read(lambda w: w.point_statistics([_POINT])),
    "multi_point_flow_stats": _read(lambda w: w.point_statistics([_POINT, (6000100, 301000), _POINT])),
    "multi_point_flow_stats_table": _pooled_locations,
    "valid_locations": _valid_locations,
    "valid_locations_range": _valid_locations_range,
    "admin_divisions": _read(Warehouse.admin_divisions),
    "distinct_regions": _read(lambda w: points.distinct_regions(w.table("puntos_mapa"))),
    "points_total": _read(lambda w: points.total_points(w.table("puntos_mapa"))),
    "points_lonlat": _read(lambda w: points.points_lon_lat(w.table("puntos_mapa"))),
    # Basins, sectors, boards, ranges.
    "basin_list": _read(Warehouse.basins),
    "sector_list": _read(Warehouse.sectors),
    "sector_list_filtered": _read(lambda w: w.sectors(region=1, cod_cuenca=115, cod_subcuenca=11500)),
    "board_list": _read(Warehouse.boards),
    "filter_stats_read": _read(Warehouse.filter_ranges),
    "filter_stats_basin": _read(lambda w: w.filter_ranges("cuenca")),
    "filter_stats_subbasin": _read(lambda w: w.filter_ranges("subcuenca")),
    "basin_stats": _read(lambda w: w.basin_stats(cod_cuenca=115)),
    "basin_stats_path": _read(lambda w: w.basin_stats(
        cod_cuenca=115, cod_subcuenca=11500, cod_subsubcuenca=115000)),
    "basin_stats_global": _read(lambda w: w.basin_stats(include_global=True)),
    "points_by_level": _read(Warehouse.points_by_level),
    # The first rows of ordered reads.
    "basin_list_first": _first(5, Warehouse.basins),
    "basin_stats_first": _first(7, Warehouse.basin_stats),
    "sector_list_first": _first(2, Warehouse.sectors),
    "filter_stats_first": _first(30, Warehouse.filter_ranges),
    "series_basin_flow_first": _first(3, lambda w: w.area_series("cuenca", "caudal", "115")),
    "series_point_flow_first": _first(3, lambda w: w.point_series("caudal", *_POINT)),
    "basin_subbasin_names": _read(lambda w: basins.subbasin_names(w.table("cuencas_regiones"))),
    # Series of areas.
    "series_basin_flow": _area("cuenca", "caudal", "115"),
    "series_basin_flow_by_name": _area("cuenca", "caudal", "NATION_15"),
    "series_basin_flow_dated": _area("cuenca", "caudal", "115", start="1996-01-01", end="1999-12-31"),
    "series_basin_flow_well": _area("cuenca", "caudal", "115", well=True),
    "series_basin_gauge": _area("cuenca", "altura_linimetrica", "115"),
    "series_basin_gauge_surface": _area("cuenca", "altura_linimetrica", "115", well=False),
    "series_basin_table": _area("cuenca", "nivel_freatico", "115"),
    "series_subbasin_flow": _area("subcuenca", "caudal", "11500"),
    "series_subbasin_flow_well_dated": _area("subcuenca", "caudal", "11500", start="1995-01-01", well=True),
    "series_subbasin_gauge": _area("subcuenca", "altura_linimetrica", "11500"),
    "series_subbasin_table": _area("subcuenca", "nivel_freatico", "NATION_15 sub 0"),
    "series_subsubbasin_flow": _area("subsubcuenca", "caudal", "115000"),
    "series_subsubbasin_gauge": _area("subsubcuenca", "altura_linimetrica", "115000"),
    "series_subsubbasin_table": _area("subsubcuenca", "nivel_freatico", "115000"),
    "series_subsubbasin_table_well": _area("subsubcuenca", "nivel_freatico", "115000", well=True),
    "series_sector_flow": _area("shac", "caudal", "121"),
    "series_sector_flow_by_name": _area("shac", "caudal", "Sector 1"),
    "series_sector_flow_well": _area("shac", "caudal", "121", well=True),
    "series_sector_gauge": _area("shac", "altura_linimetrica", "121"),
    "series_sector_table": _area("shac", "nivel_freatico", "121"),
    "series_sector_table_dated": _area("shac", "nivel_freatico", "121", end="1997-06-30"),
    # Series of points.
    "series_point_flow": _read(lambda w: w.point_series("caudal", *_POINT)),
    "series_point_flow_dated": _read(lambda w: w.point_series(
        "caudal", *_POINT, start="1996-01-01", end="1999-12-31")),
    "series_point_gauge": _read(lambda w: w.point_series("altura_linimetrica", *_POINT)),
    "series_point_table": _read(lambda w: w.point_series("nivel_freatico", *_POINT)),
    "series_point_gauge_count": _read(lambda w: w.point_series_count("altura_linimetrica", *_POINT)),
    "series_point_table_count": _read(lambda w: w.point_series_count("nivel_freatico", *_POINT)),
    # Rights and reporters.
    "point_rights": _read(lambda w: w.point_rights(*_POINT)),
    "point_rights_unknown_type": _read(lambda w: w.point_rights(6000200, 300000)),
    "point_rights_monthly": _read(lambda w: rights.by_month(
        w.point_rights(*_POINT), [c.lower() for c in S.MONTHLY_FLOWS])),
    "basin_rights": _read(lambda w: w.basin_rights(115)),
    "basin_rights_unknown": _read(lambda w: w.basin_rights(-1)),
    "basin_rights_monthly": _read(lambda w: rights.by_month(w.basin_rights(115), S.MONTHLY_SUMS)),
    "subbasin_rights": _read(lambda w: w.basin_rights(115, 11500)),
    "reporters_list": _read(Warehouse.reporters),
    "reporters_list_basin": _read(lambda w: w.reporters(
        cod_cuenca=115, cod_subcuenca=11500, cod_subsubcuenca=115000, limit=None)),
    "reporters_list_point": _read(lambda w: w.reporters(utm_norte=6000000, utm_este=300000, limit=10)),
    "reporter_full_names": _read(lambda w: reporters.reporter_names(w.table("informante"))),
    # Checks and the request log.
    "column_coverage": _column_coverage,
    "points_sample": _read(lambda w: checks.sample_rows(
        w.table("puntos_mapa"),
        ("COD_SECTOR_SHA", "SECTOR_SHA", "APR", "ID_JUNTA", "CANAL_TRANSMISION"),
        any_of=("COD_SECTOR_SHA", "APR"), n=5)),
    "measurements_sample": _read(lambda w: points.first_rows(w.table("datos"), 1)),
    "series_sample": _read(lambda w: points.first_rows(w.table("series_tiempo").drop(*S.SERIES_STATE), 2)),
    "point_coverage": _read(lambda w: w.points_in_sectors("tor 1")),
    "sectors_with_data": _read(lambda w: checks.sectors_with_data(
        w.table("puntos_mapa"), w.table("series_tiempo"))),
    "latency_by_endpoint": _log(request_log.latency_by_endpoint),
    "latency_overall": _log(request_log.latency_overall),
    "latency_top5": _log(request_log.slowest_requests),
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(key: str, query: Query) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            folder = folder.rstrip("/")
            return presented(query(warehouse(spark, folder), folder), exact=key in EXACT)
        return run

    return {key: bound(key, query) for key, query in QUERIES.items()}
