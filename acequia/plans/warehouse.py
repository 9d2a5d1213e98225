"""The derived tables as one refreshable set, and the reads over them.

A full refresh scans the fact four times, each scan reading only its own columns:
for the point rollup, the daily series, the reporters and the distinct measurements.
All other tables follow from the point rollup or the daily series. Where files were added to
the fact, ``refresh_new`` reads only those and merges them in.

Only ``refresh``, ``refresh_new`` and the updates write. Each writes new files under a folder of its
own and then commits a version that names the files of every table, so a reader sees the tables of
one version. A change that was computed from tables which another session has changed meanwhile is
computed again.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from acequia import schema as S
from acequia.operators import (
    basins, bitmaps, builds, checks, cube, merges, points, reporters, rights, rollup, series, text_index, updates,
)
from acequia.operators.filters import PointFilter, equal_to, where
from acequia.sources.fact import StoredFact
from acequia.sources.log import Conflict, VersionLog
from acequia.sources.tables import in_years, read_part, read_parts, write_table

#: A table of more folders than this is written anew as one.
MAX_PARTS = 8
#: How often a change is computed again because another session was faster.
ATTEMPTS = 5


@dataclass(frozen=True)
class Change:
    """New rows of a table and what they replace: all rows, those of some years, or those of some files of
    its folders; nothing where rows are only added."""

    rows: DataFrame
    everything: bool = True
    years: Sequence[int | None] = ()
    files: Mapping[str, Sequence[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class StoredTable:
    """How a table is computed, from which others, and how its files are laid out.

    ``extend`` gives the change that new reports make, ``source.fact`` being only these; without it the
    table is computed again from those that it reads.
    """

    compute: Callable[[Source], DataFrame]
    reads: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()
    range_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    near_by: tuple[str, ...] = ()
    options: Mapping[str, str] = field(default_factory=dict)
    extend: Callable[[Source], Change] | None = None


def basin_stats(source: Source) -> DataFrame:
    points_ = source.table("rollup_puntos")
    sums = builds.rights_per_basin(rollup.rights_per_point(points_))
    return builds.with_basin_rights(rollup.basin_flows(points_, source.table("puntos_bitmap")), sums)


def _numbers(source: Source) -> DataFrame:
    found = bitmaps.places(source.table("rollup_puntos"))
    if not source.stores:
        return bitmaps.numbered_in_one_task(found)
    return bitmaps.numbered(source.kept(bitmaps.ordered(found), "lugares"))


def _more_numbers(source: Source) -> Change:
    """Numbers of new points follow those of the known ones, which keep theirs."""
    known = source.stored("puntos_numero")
    new = bitmaps.places(source.table("rollup_puntos")).join(known, "punto", "left_anti")
    last = known.agg(F.max("numero")).first()[0]
    start = 0 if last is None else last + 1
    return Change(bitmaps.numbered(source.kept(bitmaps.ordered(new), "lugares"), start), False)


def _daily(source: Source) -> DataFrame:
    return builds.daily_states(source.fact).withColumn("ANIO", F.year("FECHA_MEDICION"))


def _extended_daily(source: Source) -> Change:
    """The days of the years that new reports fall in, merged with them."""
    new = source.kept(_daily(source), "dias_nuevos")
    source.years = [r.ANIO for r in new.select("ANIO").distinct().collect()]
    old = source.stored("series_tiempo")
    return Change(merges.merge_daily(old.where(in_years(old, source.years)), new), False, source.years)


def _of_years(name: str, compute: Callable[[Source, DataFrame], DataFrame]) -> Callable[[Source], Change]:
    """A table that follows from the daily series year by year: only the touched years are computed."""
    def extend(source: Source) -> Change:
        days = source.table("series_tiempo")
        return Change(compute(source, days.where(in_years(days, source.years))), False, source.years)
    return extend


def _extended_areas(source: Source) -> Change:
    """Area sums of the touched years; of all years where the catalog lists an older coordinate anew."""
    days, catalog = source.table("series_tiempo"), source.table("puntos_mapa")
    if cube.changed_listings(source.stored("puntos_mapa"), catalog).limit(1).count():
        return Change(cube.area_days(days, catalog))
    return Change(cube.area_days(days.where(in_years(days, source.years)), catalog), False, source.years)


def _places(source: Source, days: DataFrame) -> DataFrame:
    return days.select(*S.COORD, "FECHA_MEDICION", *S.LEVELS, "TOTALIZADOR")


def _coverage(source: Source, days: DataFrame) -> DataFrame:
    return checks.coverage_by_year(days, S.EXPECTED_COLUMNS["Series_Tiempo"])


def _merged(name: str, merge: Callable[[DataFrame, DataFrame], DataFrame],
            build: Callable[[DataFrame], DataFrame]) -> Callable[[Source], Change]:
    return lambda source: Change(merge(source.stored(name), build(source.fact)))


def _new_measurements(source: Source) -> Change:
    new = source.kept(builds.measurements(source.fact), "mediciones_nuevas")
    return Change(merges.new_measurements(source.stored("datos"), new), False)


# In build order. Reads of areas use the cube: its level is a partition, and rows lie together by
# code and name. Whole years of the series are skipped by partition, and within a year rows lie together
# by basin path. Reads of points select from a copy of its measured columns in which every file holds
# a range of coordinates; the date ends the range, so even a coordinate with very many days is
# split. The catalog follows a curve through the plane and has short pages, so one coordinate is read from
# a few of them however many points there are.
TABLES: dict[str, StoredTable] = {
    "rollup_puntos": StoredTable(
        lambda s: rollup.point_rollup(s.fact),
        extend=_merged("rollup_puntos", merges.merge_rollups, rollup.point_rollup),
    ),
    "puntos_numero": StoredTable(_numbers, reads=("rollup_puntos",), extend=_more_numbers),
    "puntos_bitmap": StoredTable(
        lambda s: bitmaps.path_bitmaps(s.table("rollup_puntos"), s.table("puntos_numero")),
        reads=("rollup_puntos", "puntos_numero"), cluster_by=("Cod_Cuenca",), sort_by=("Cod_Cuenca", "Cod_Subcuenca"),
    ),
    "datos": StoredTable(
        lambda s: builds.measurements(s.fact), range_by=("UTM_Norte", "UTM_Este", "Fecha_Medicion"),
        extend=_new_measurements,
    ),
    "cuencas_regiones": StoredTable(
        lambda s: builds.basin_catalog(s.table("rollup_puntos")), reads=("rollup_puntos",)
    ),
    "informante": StoredTable(
        lambda s: builds.reporters(s.fact), cluster_by=("COD_CUENCA",), sort_by=("COD_CUENCA", *S.COORD),
        extend=_merged("informante", merges.merge_reporters, builds.reporters),
    ),
    "puntos_mapa": StoredTable(
        lambda s: rollup.points(s.table("rollup_puntos")), reads=("rollup_puntos",),
        near_by=("UTM_Norte", "UTM_Este"), range_by=("Cod_Cuenca", "codigo"),
        options={"parquet.page.row.count.limit": "1000", "parquet.block.size": str(16 << 20)},
    ),
    "textos_puntos": StoredTable(
        lambda s: text_index.postings(s.table("puntos_mapa"), ("codigo", "SECTOR_SHA")), reads=("puntos_mapa",),
        cluster_by=("columna", "trigrama"), sort_by=("columna", "trigrama"),
        options={"parquet.page.row.count.limit": "1000"},
    ),
    "series_tiempo": StoredTable(
        _daily,
        partition_by=("ANIO",),
        cluster_by=("ANIO", "COD_CUENCA"),
        sort_by=(*S.BASIN_CODES, *S.COORD, "FECHA_MEDICION"),
        extend=_extended_daily,
    ),
    "series_puntos": StoredTable(
        lambda s: _places(s, s.table("series_tiempo")),
        reads=("series_tiempo",), range_by=(*S.COORD, "FECHA_MEDICION"),
        extend=_of_years("series_puntos", _places),
    ),
    "series_areas": StoredTable(
        lambda s: cube.area_days(s.table("series_tiempo"), s.table("puntos_mapa")),
        reads=("series_tiempo", "puntos_mapa"), partition_by=("NIVEL", "ANIO"), cluster_by=("NIVEL", "ANIO"),
        sort_by=("CODIGO", "NOMBRE", "FECHA_MEDICION"),
        extend=_extended_areas,
    ),
    "cobertura_series": StoredTable(
        lambda s: _coverage(s, s.table("series_tiempo")), reads=("series_tiempo",),
        extend=_of_years("cobertura_series", _coverage),
    ),
    "cuenca_stats": StoredTable(basin_stats, reads=("rollup_puntos", "puntos_bitmap")),
    "filtros_reactivos_stats": StoredTable(
        lambda s: bitmaps.filter_stats(s.table("rollup_puntos"), s.table("puntos_bitmap")),
        reads=("rollup_puntos", "puntos_bitmap"),
    ),
}


def dependants(names: Sequence[str]) -> list[str]:
    """The named tables and all that follow from them, in build order."""
    found: list[str] = []
    for name, spec in TABLES.items():
        if name in names or any(r in found for r in spec.reads):
            found.append(name)
    unknown = set(names) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    return found


def needed(names: Sequence[str]) -> list[str]:
    """The named tables and all that they are computed from, in build order."""
    unknown = set(names) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    found = set(names)
    for name, spec in reversed(TABLES.items()):
        if name in found:
            found.update(spec.reads)
    return [n for n in TABLES if n in found]


class Source:
    """What a table is computed from: the fact, and tables as the running change leaves them.

    Notes which stored tables were read, for a change stands only while these stay as they were.
    """

    def __init__(self, warehouse: Warehouse, fact: DataFrame | None = None, folder: str = ""):
        self._warehouse, self._fact, self._folder = warehouse, fact, folder
        self.built: dict[str, DataFrame] = {}
        self.reads: set[str] = set()
        self.temporary: list[str] = []
        self.years: list[int | None] = []

    @property
    def fact(self) -> DataFrame:
        return self._warehouse.fact if self._fact is None else self._fact

    @property
    def stores(self) -> bool:
        """Whether steps can be written, or all is one plan."""
        return self._warehouse.root is not None

    def stored(self, name: str) -> DataFrame:
        self.reads.add(name)
        return self._warehouse.table(name)

    def table(self, name: str) -> DataFrame:
        return self.built[name] if name in self.built else self.stored(name)

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        """Rows that several steps of a change use, as a table in the folder of the change."""
        path = f"{self._warehouse.root}/{self._folder}/{label}"
        self.temporary.append(f"{self._folder}/{label}")
        write_table(df, path, mode="errorifexists")
        return self._warehouse.spark.read.schema(df.schema).parquet(path)


class Warehouse:
    """Derived tables of one fact.

    With ``root``, a folder that all executors reach, tables are those of the last version that
    was committed there when this warehouse first asked or last wrote; a read never writes, and a
    table that was never built is an error. Without it each table is a plan over the fact.
    ``tables`` names those to keep where not all are wanted; they, what they are computed from and what
    is stored there already is what a full refresh builds and new files are merged into.
    """

    def __init__(self, spark: SparkSession, fact: DataFrame | StoredFact | None, root: str | None = None,
                 tables: Sequence[str] = tuple(TABLES)):
        self.spark = spark
        self._stored_fact = fact if isinstance(fact, StoredFact) else None
        self._fact = fact.read() if isinstance(fact, StoredFact) else fact
        self.root = root.rstrip("/") if root else None
        self.log = VersionLog(spark, self.root) if self.root else None
        self._version: tuple[int, dict] | None = None
        self._tables: dict[str, DataFrame] = {}
        self._wanted = needed(tables)
        self._lock = threading.RLock()

    @classmethod
    def open(cls, spark: SparkSession, root: str, fact: DataFrame | StoredFact | None = None) -> Warehouse:
        """Tables that an earlier refresh has committed under ``root``."""
        found = cls(spark, fact, root)
        if not found._current():
            raise ValueError(f"no tables under {root}: refresh first")
        return found

    @property
    def fact(self) -> DataFrame:
        if self._fact is None:
            raise ValueError("this warehouse was opened without its fact table")
        return self._fact

    @property
    def version(self) -> int:
        """Number of the version that is read."""
        with self._lock:
            if self._version is None:
                self._version = self.log.latest()
            return self._version[0]

    def _current(self) -> dict[str, dict]:
        """Entry of each table in the version that is read."""
        self.version
        return self._version[1]["tables"]

    def _kept(self) -> list[str]:
        """Tables that are wanted or stored, in build order."""
        return [n for n in TABLES if n in self._wanted or n in self._current()]

    def _move(self, version: tuple[int, dict]) -> None:
        """Read another version from now on."""
        before = self._version[1]["tables"] if self._version else {}
        self._version = version
        for name in [n for n in self._tables if before.get(n) != version[1]["tables"].get(n)]:
            del self._tables[name]

    def table(self, name: str) -> DataFrame:
        if self.root is None:
            return TABLES[name].compute(Source(self))
        with self._lock:
            if name not in self._tables:
                entry = self._current().get(name)
                if entry is None:
                    raise ValueError(f"table {name!r} is not built under {self.root}: refresh first")
                self._tables[name] = read_parts(self.spark, self.root, entry)
            return self._tables[name]

    # -- Writes ------------------------------------------------------------------

    def refresh(self, names: Sequence[str] | None = None) -> dict[str, float]:
        """Rebuild the named tables, by default all that are kept, and all that follow from them; commit them
        together.

        A table that follows from one that is neither stored nor rebuilt is left out. Returns the
        seconds that each took.
        """
        def changes(source: Source) -> dict[str, Callable[[], Change]]:
            found: dict[str, Callable[[], Change]] = {}
            kept = self._kept()
            asked = kept if names is None else names
            for n in dependants(asked):
                if (n in kept or n in asked) and all(r in found or r in self._current() for r in TABLES[n].reads):
                    found[n] = lambda n=n: Change(TABLES[n].compute(source))
            return found

        whole = names is None or set(names) == set(TABLES)
        files = self._stored_fact.files() if self._stored_fact and whole else None
        fact = self._stored_fact.read_files(sorted(n for n, _, _ in files)) if files else None
        return self._commit(changes, fact=fact, files=files)

    def build_missing(self, names: Sequence[str]) -> dict[str, float]:
        """Build those of the named tables, and of the tables they are computed from, that are not stored yet.

        Stored tables stay as they are, so this is for a fact that does not change; a ``StoredFact`` is an error.
        """
        if self._stored_fact is not None:
            raise ValueError("tables of a StoredFact are built by refresh and refresh_new")

        def changes(source: Source) -> dict[str, Callable[[], Change]]:
            return {n: lambda n=n: Change(TABLES[n].compute(source)) for n in needed(names) if n not in self._current()}

        with self._lock:
            if all(n in self._current() for n in needed(names)):
                return {}
            return self._commit(changes)

    def refresh_new(self) -> dict[str, float]:
        """Merge the reports of files that were added to the fact since the last refresh.

        Only these files are read of the fact, and only the years they touch are written of the series.
        Where an earlier file is gone or changed, or nothing was refreshed yet, everything is rebuilt.
        The result equals that of ``refresh``, but for the order of floating-point sums.
        """
        if self._stored_fact is None:
            raise ValueError("merging new files needs a StoredFact")
        with self._lock:
            self._move(self.log.latest())
            files, listed = self._stored_fact.files(), self._version[1].get("fact")
            if listed is None or any(n not in self._current() for n in self._kept()):
                return self.refresh()
            known = {tuple(r) for r in self.spark.read.parquet(f"{self.root}/{listed}").collect()}
            if known - files:
                return self.refresh()
            if not files - known:
                return {}
            fact = self._stored_fact.read_files(sorted(n for n, _, _ in files - known))

            def changes(source: Source) -> dict[str, Callable[[], Change]]:
                if self._version[1].get("fact") != listed:
                    raise Conflict("another session has merged new files")
                return {n: lambda spec=TABLES[n]: spec.extend(source) if spec.extend else Change(spec.compute(source))
                        for n in self._kept()}

            return self._commit(changes, fact=fact, files=files)

    def publish(self, tables: dict[str, DataFrame]) -> None:
        """Commit tables computed elsewhere, laid out as this warehouse lays them out."""
        self._commit(lambda source: {n: lambda df=df: Change(df) for n, df in tables.items()})

    def update(self, name: str, change: Callable[[DataFrame], DataFrame], only: Mapping[str, object] | None = None) -> None:
        """Commit a new version of one table: its present rows under ``change``.

        ``only`` names columns and values of the rows that change; files without such a row stay as they are.
        """
        self._commit(lambda source: {name: lambda: self._rewritten(source, name, change, only)})

    def _rewritten(self, source: Source, name: str, change: Callable[[DataFrame], DataFrame],
                   only: Mapping[str, object] | None) -> Change:
        table = source.stored(name)
        if not only:
            return Change(change(table))
        entry, asked = self._current()[name], equal_to(dict(only))
        schema, rows, files = table.schema, [], {}
        for part in entry["parts"]:
            df = read_part(self.spark, self.root, part, schema)
            held = where(df, asked).select(F.col("_metadata.file_name").alias("f")).distinct()
            files[part["path"]] = sorted(r.f for r in held.collect())
            rows.append(df.where(F.col("_metadata.file_name").isin(files[part["path"]])))
        found = rows[0]
        for other in rows[1:]:
            found = found.unionByName(other)
        same = F.lit(True)
        for condition in asked:
            same = same & F.coalesce(condition, F.lit(False))
        changed = change(found.where(same)).unionByName(found.where(~same), allowMissingColumns=True)
        return Change(changed.select(*(F.col(f.name).cast(f.dataType) for f in schema.fields)), False, files=files)

    def update_rights(self, cod_cuenca: int | None = None) -> None:
        """Add the rights columns to points and basins where they are missing, and fill them.

        Points take the rights of their coordinate, basin paths the sums of their points;
        rows without rights keep what they have. Both tables are committed together. With a basin,
        only its rows are updated, and only the files that hold some are written.
        """
        def of_points(source: Source, rows: DataFrame) -> DataFrame:
            return updates.update_from(
                updates.with_missing_columns(rows, S.POINT_RIGHT_TYPES),
                rollup.rights_per_coord(source.table("rollup_puntos")),
                {"UTM_Norte": "UTM_NORTE", "UTM_Este": "UTM_ESTE"}, S.RIGHTS)

        def of_basins(source: Source, rows: DataFrame) -> DataFrame:
            return updates.update_from(
                updates.with_missing_columns(rows, S.BASIN_RIGHT_TYPES),
                builds.rights_per_basin(rollup.rights_per_point(source.table("rollup_puntos"))),
                {"Cod_Cuenca": "COD_CUENCA", "Cod_Subcuenca": "COD_SUBCUENCA",
                 "Cod_Subsubcuenca": "COD_SUBSUBCUENCA", "Cod_Region": "REGION"}, S.BASIN_RIGHTS)

        def changes(source: Source) -> dict[str, Callable[[], Change]]:
            found = {}
            for name, change, columns in (("puntos_mapa", of_points, S.RIGHTS), ("cuenca_stats", of_basins, S.BASIN_RIGHTS)):
                # A table without the columns is written whole, for its files do not have them.
                whole = cod_cuenca is None or not set(columns) <= set(source.stored(name).columns)
                only = None if whole else {"Cod_Cuenca": cod_cuenca}
                if whole and cod_cuenca is not None:
                    raise ValueError(f"{name} has no rights columns yet: update all basins first")
                found[name] = lambda name=name, change=change, only=only: self._rewritten(
                    source, name, lambda rows: change(source, rows), only)
            return found

        self._commit(changes)

    def _commit(self, changes: Callable[[Source], dict[str, Callable[[], Change]]],
                fact: DataFrame | None = None, files: set | None = None) -> dict[str, float]:
        """Write the changed tables and commit them as the next version.

        Starts from the last version, whoever committed it. If a table that the change has read is changed
        before it is committed, it is computed again from the then last version; changes of other tables
        are kept.
        """
        if self.root is None:
            raise ValueError("writing tables needs a root folder")
        with self._lock:
            for _ in range(ATTEMPTS):
                self._move(self.log.latest())
                base = dict(self._current())
                folder = f"versiones/{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}"
                source = Source(self, fact, folder)
                seconds, entries = {}, {}
                for name, change in changes(source).items():
                    start = time.perf_counter()
                    entries[name] = self._write(f"{folder}/{name}", name, base.get(name), change())
                    source.built[name] = read_parts(self.spark, self.root, entries[name])
                    seconds[name] = time.perf_counter() - start
                extra = {}
                if files is not None:
                    extra["fact"] = f"{folder}/archivos"
                    self.spark.createDataFrame(sorted(files), "nombre string, bytes long, fecha long").write.parquet(
                        f"{self.root}/{extra['fact']}")
                done = self._put(base, entries, source.reads, extra)
                for step in source.temporary:
                    self.log.delete(step)
                if done:
                    return seconds
            raise Conflict(f"{sorted(source.reads)} under {self.root} kept changing")

    def _put(self, base: dict, entries: dict, reads: set[str], extra: dict) -> bool:
        while True:
            number, content = self.log.latest()
            if any(content["tables"].get(n) != base.get(n) for n in reads):
                return False
            if extra and not set(content["tables"]) <= {*base, *entries}:
                return False  # a table that another session has added would miss the files that this version names
            content = {**content, **extra, "tables": {**content["tables"], **entries}}
            if self.log.put(number + 1, content):
                self._move((number + 1, content))
                return True

    def _write(self, path: str, name: str, before: dict | None, change: Change) -> dict:
        """Write the new rows and describe the table that results. One of many folders is written as one."""
        spec, parts, rows = TABLES[name], [], change.rows
        if not change.everything and before:
            for part in before["parts"]:
                files = sorted({*part.get("without_files", ()), *change.files.get(part["path"], ())})
                years = [*part.get("without_years", ()), *(y for y in change.years if y not in part.get("without_years", ()))]
                parts.append({"path": part["path"], "without_files": files, "without_years": years})
            if len(parts) >= MAX_PARTS:
                rows = read_parts(self.spark, self.root, {**before, "parts": parts}).unionByName(rows)
                parts = []
        write_table(
            rows, f"{self.root}/{path}", mode="errorifexists", partition_by=spec.partition_by, cluster_by=spec.cluster_by,
            range_by=spec.range_by, sort_by=spec.sort_by, near_by=spec.near_by, options=spec.options,
        )
        return {"schema": rows.schema.jsonValue(), "parts": [*parts, {"path": path}]}

    def pin(self, seconds: float) -> None:
        """Keep the files of the version that is read for so long, whatever ``clean`` removes."""
        self.log.pin(self.version, seconds)

    def clean(self, grace: float = 24 * 3600) -> list[str]:
        """Remove the files of versions that were superseded more than ``grace`` seconds ago and that no
        reader has pinned. Returns the folders that went."""
        return self.log.clean(grace)

    def create_views(self) -> None:
        """Make every table readable by name in ``spark.sql``, in this session."""
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)

    # -- Reads -------------------------------------------------------------------

    def count_points(self, filters: PointFilter = PointFilter()) -> DataFrame:
        return points.count_points(self.table("puntos_mapa"), filters, self._texts(filters.codigo_obra))

    def list_points(
        self, filters: PointFilter = PointFilter(), limit: int | None = S.DEFAULT_POINT_LIMIT
    ) -> DataFrame:
        return points.list_points(self.table("puntos_mapa"), filters, limit, self._texts(filters.codigo_obra))

    def _texts(self, searched: str | None) -> DataFrame | None:
        """The index of texts, where it is stored and something is searched."""
        return self.table("textos_puntos") if self.root is not None and searched is not None else None

    def points_in_sectors(self, sector_text: str) -> DataFrame:
        """Points whose sector name contains a text, with their rows in measurements and series."""
        return checks.point_coverage(self.table("puntos_mapa"), self.table("datos"), self.table("series_tiempo"),
                                     sector_text, self._texts(sector_text))

    def points_by_level(self) -> DataFrame:
        """Distinct points of every region and basin at every level."""
        return bitmaps.points_by_level(self.table("puntos_bitmap"))

    def point_info(self, norte: int, este: int) -> DataFrame:
        return points.point_info(self.table("puntos_mapa"), norte, este)

    def point_statistics(self, locations: Sequence[tuple[int, int]]) -> DataFrame:
        """Per metric for one location, pooled flow for several."""
        for place in locations:
            if not points.is_valid_location(*place):
                raise ValueError(f"location outside the grid: {place}")
        daily = self.table("series_puntos")
        if len(locations) == 1:
            return points.point_metric_stats(daily, *locations[0])
        return points.multi_point_flow_stats(daily, locations)

    def pooled_statistics(self, locations: DataFrame) -> DataFrame:
        """Pooled flow of the points in a table of locations (``UTM_NORTE``, ``UTM_ESTE``)."""
        return points.pooled_flow_stats(self.table("series_puntos"), locations)

    def admin_divisions(self) -> DataFrame:
        return points.admin_divisions(self.table("puntos_mapa"))

    def basins(self) -> DataFrame:
        return basins.list_basins(self.table("cuencas_regiones"))

    def sectors(self, **given: int | None) -> DataFrame:
        return basins.list_sectors(self.table("puntos_mapa"), **given)

    def boards(self) -> DataFrame:
        return basins.list_boards(self.table("puntos_mapa"))

    def filter_ranges(self, level: str | None = None) -> DataFrame:
        stored = self.table("filtros_reactivos_stats")
        return basins.read_filter_level(stored, level) if level else basins.read_filter_stats(stored)

    def basin_stats(self, **given) -> DataFrame:
        return basins.read_basin_stats(self.table("cuenca_stats"), **given)

    def area_series(self, level: str, metric: str, identifier: str, **given) -> DataFrame:
        if self.root is not None:
            return cube.read_area_series(self.table("series_areas"), level, metric, identifier, **given)
        needs_points = level == "shac" or given.get("well") is not None
        catalog = self.table("puntos_mapa") if needs_points else None
        return series.area_series(self.table("series_tiempo"), catalog, level, metric, identifier, **given)

    def point_series(self, metric: str, norte: int, este: int, **given) -> DataFrame:
        return series.point_series(self.table("series_puntos"), metric, norte, este, **given)

    def point_series_count(self, metric: str, norte: int, este: int, **given) -> DataFrame:
        return series.point_series_count(self.table("series_puntos"), metric, norte, este, **given)

    def point_rights(self, norte: int, este: int) -> DataFrame:
        return rights.point_rights(self.table("puntos_mapa"), norte, este)

    def basin_rights(self, cod_cuenca: int, cod_subcuenca: int | None = None) -> DataFrame:
        return rights.basin_rights(self.table("cuenca_stats"), cod_cuenca, cod_subcuenca)

    def reporters(self, **given) -> DataFrame:
        return reporters.list_reporters(self.table("informante"), **given)

    def record_count(self) -> DataFrame:
        """Reports in the fact, as the last refresh counted them."""
        figures = rollup.fact_figures(self.table("rollup_puntos"), ())
        return figures.select(F.col("filas").alias("total_records"))

    def column_coverage(self) -> DataFrame:
        """For each column that reads expect of the catalog, the series and the fact: is it there, and in how
        many rows does it have a value. Only the catalog is read for it; the other figures are stored."""
        catalog, expected = self.table("puntos_mapa"), S.EXPECTED_COLUMNS
        fact = rollup.fact_figures(self.table("rollup_puntos"), expected["Mediciones_full"])
        return (
            checks.column_coverage(catalog, "Puntos_Mapa", expected["Puntos_Mapa"])
            .unionByName(checks.stored_coverage(
                self.table("cobertura_series"), "Series_Tiempo", expected["Series_Tiempo"]))
            .unionByName(checks.stored_coverage(fact, "Mediciones_full", expected["Mediciones_full"]))
        )
