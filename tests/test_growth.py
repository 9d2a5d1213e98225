"""What larger tables need: groups that fit a task, narrow shuffles, and no table that a read does not use."""

from datetime import datetime

import pytest

from acequia import Warehouse
from acequia.operators import builds, merges
from acequia.plans.registry import BuiltOnRead
from acequia.plans.warehouse import TABLES, needed
from acequia.sources import StoredFact
from acequia.sources.sample import sample_fact
from conftest import SF_SMALL
from facts import dicts, fact


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def reports(spark):
    day = datetime(2001, 2, 3, 4)
    return fact(spark, {"CAUDAL": 1.0}, {"CAUDAL": 1.0}, {"CAUDAL": 3.0, "TOTALIZADOR": 4}, {"CAUDAL": None},
                *({"UTM_NORTE": n, "FECHA_MEDICION": d, "CAUDAL": c}
                  for n in (None, 7) for d in (None, day) for c in (None, 2.0, 6.0, 6.0)))


@pytest.mark.parametrize("build", [
    builds.measurements, builds.daily_series,
    lambda f: merges.merge_daily(builds.daily_states(f).localCheckpoint(), builds.daily_states(f).localCheckpoint())])
def test_rows_that_hardly_combine_are_grouped_after_their_shuffle(spark, build):
    """A map task that groups them holds its whole split, which spills where splits are large."""
    text = plan(build(reports(spark)))  # printed from the result down to the scan
    assert text.count("Exchange hashpartitioning") == 1
    assert text.rindex("HashAggregate") < text.index("Exchange hashpartitioning")


def test_days_and_measurements_with_null_and_repeated_keys(spark):
    given = reports(spark)
    days = {(r["UTM_NORTE"], r["FECHA_MEDICION"] and r["FECHA_MEDICION"].year): r["CAUDAL"] for r in dicts(builds.daily_series(given))}
    mean = 14 / 3
    assert days == {(6300000, 2023): pytest.approx(5 / 3), **{(n, y): pytest.approx(mean) for n in (None, 7) for y in (None, 2001)}}
    assert builds.measurements(given).count() == 3 + 4 * 3


def test_orders_join_line_items_before_places_do(spark):
    text = plan(sample_fact(spark, SF_SMALL))
    at = [text.index(f"/{t}.parquet") for t in ("lineitem", "orders", "supplier", "nation")]
    assert at == sorted(at)


@pytest.mark.parametrize("read, stored", [
    (lambda w: w.point_info(7, 350000), {"rollup_puntos", "puntos_mapa"}),
    (lambda w: w.record_count(), {"rollup_puntos"}),
    (lambda w: w.points_by_level(), {"rollup_puntos", "puntos_numero", "puntos_bitmap"}),
    (lambda w: w.point_series("caudal", 7, 350000), {"series_tiempo", "series_puntos"}),
])
def test_a_read_builds_the_tables_behind_it_only(spark, tmp_path, read, stored):
    given = reports(spark)
    w = BuiltOnRead(spark, given, str(tmp_path / "a"))
    assert rows(read(w)) == rows(read(Warehouse(spark, given)))
    assert set(w.log.latest()[1]["tables"]) == stored
    before = w.log.latest()
    read(w)
    assert w.log.latest() == before and w.build_missing(sorted(stored)) == {}


def test_missing_tables_are_built_from_stored_ones(spark, tmp_path):
    w = Warehouse(spark, reports(spark), str(tmp_path / "a"))
    w.refresh(["rollup_puntos"])
    kept = w.log.latest()[1]["tables"]["rollup_puntos"]
    stored = set(w.log.latest()[1]["tables"])
    w.build_missing(list(TABLES))
    assert stored and set(w.log.latest()[1]["tables"]) == set(TABLES)
    assert w.log.latest()[1]["tables"]["rollup_puntos"] == kept
    reports(spark).write.parquet(str(tmp_path / "hechos"))
    with pytest.raises(ValueError):
        Warehouse(spark, StoredFact(spark, str(tmp_path / "hechos")), str(tmp_path / "b")).build_missing(["datos"])
    with pytest.raises(ValueError):
        needed(["nada"])


def test_new_files_are_merged_into_the_tables_that_are_kept(spark, tmp_path):
    path, root = str(tmp_path / "hechos"), str(tmp_path / "t")
    reports(spark).coalesce(1).write.parquet(path)
    some = Warehouse(spark, StoredFact(spark, path), root, ["cuenca_stats", "series_puntos"])
    some.refresh()
    held = {"rollup_puntos", "puntos_numero", "puntos_bitmap", "cuenca_stats", "series_tiempo", "series_puntos"}
    assert set(some.log.latest()[1]["tables"]) == held
    fact(spark, {"CAUDAL": 8.0}, {"UTM_NORTE": 9, "CAUDAL": 4.0}).write.mode("append").parquet(path)
    assert set(some.refresh_new()) == held
    fresh = Warehouse(spark, StoredFact(spark, path))
    for name in ("cuenca_stats", "series_puntos"):
        assert rows(some.table(name)) == rows(fresh.table(name))
    # Once a session that keeps all tables has stored them, the first one merges into all of them.
    Warehouse(spark, StoredFact(spark, path), root).refresh()
    fact(spark, {"CAUDAL": 5.0}).write.mode("append").parquet(path)
    assert set(some.refresh_new()) == set(TABLES)
    assert rows(some.table("datos")) == rows(Warehouse(spark, StoredFact(spark, path)).table("datos"))

