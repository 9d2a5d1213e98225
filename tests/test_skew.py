"""A third of all rows on one point, with joins forced to shuffle, against a plain computation."""

from collections import defaultdict
from datetime import datetime, timedelta
from statistics import fmean

import pytest

from acequia import Warehouse
from acequia.operators import checks
from acequia.operators.series import area_series
from facts import dicts, fact

HOT = 900


def hot_rows():
    start = datetime(2020, 1, 1)
    rows = []
    for i in range(3 * HOT):
        hot = i % 3 == 0
        rows.append({
            "UTM_NORTE": 1 if hot else 2 + i % 50,
            "UTM_ESTE": 1,
            "CODIGO": f"OB-{i % 7 if hot else 0}",
            "COD_SECTOR_SHA": 5 if hot or i % 2 else 6,
            "NATURALEZA": 1 if i % 5 else 2,
            "CAUDAL": None if i % 11 == 0 else float(i % 13),
            "TOTALIZADOR": i,
            "FECHA_MEDICION": start + timedelta(days=i % 10),
        })
    return rows


@pytest.fixture()
def shuffled_joins(spark):
    saved = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
        if spark.conf.get(k, None) is not None}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, saved[k]) if k in saved else spark.conf.unset(k)


def expected_sector_series(rows, sector):
    daily, catalog = defaultdict(list), set()
    for r in rows:
        daily[r["UTM_NORTE"], r["FECHA_MEDICION"].date()].append(r)
        catalog.add((r["UTM_NORTE"], r["CODIGO"], r["COD_SECTOR_SHA"]))
    out = defaultdict(lambda: ([], [], []))
    for (norte, day), group in daily.items():
        flows = [r["CAUDAL"] for r in group if r["CAUDAL"] is not None]
        if not flows:
            continue
        for n, _, s in catalog:
            if n == norte and s == sector:
                flow, meter, high = out[str(day)]
                flow.append(fmean(flows))
                meter.append(max(r["TOTALIZADOR"] for r in group))
    return {
        day: (fmean(flow), sum(flow), sum(meter), max(meter)) for day, (flow, meter, _) in out.items()
    }


def test_hot_point_in_a_sector_series(spark, shuffled_joins):
    rows = hot_rows()
    w = Warehouse(spark, fact(spark, *rows))
    got = {
        r["fecha_medicion"]: (r["caudal_promedio"], r["caudal_sumado"], r["totalizador_sumado"], r["totalizador_max"])
        for r in dicts(w.area_series("shac", "caudal", "5"))
    }
    expected = expected_sector_series(rows, 5)
    assert got.keys() == expected.keys() and len(got) == 10
    for day, values in expected.items():
        assert got[day] == pytest.approx(values), day


def test_hot_point_in_counts(spark, shuffled_joins):
    rows = hot_rows()
    w = Warehouse(spark, fact(spark, *({**r, "SECTOR_SHA": "S"} for r in rows)))
    got = {r["utm_norte"]: (r["n_datos"], r["n_series"]) for r in dicts(checks.point_coverage(
        w.table("puntos_mapa"), w.table("datos"), w.table("series_tiempo"), "S"))}
    assert got[1] == (len({(r["CAUDAL"], r["TOTALIZADOR"]) for r in rows if r["UTM_NORTE"] == 1}),
                      len({r["FECHA_MEDICION"] for r in rows if r["UTM_NORTE"] == 1}))
    assert len(got) == len({r["UTM_NORTE"] for r in rows})


def test_join_on_a_hot_coordinate_is_split(spark, shuffled_joins):
    """A third of the series on one coordinate: the plan that ran divides its partition."""
    given = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k",
    }
    hot = "IF(id % 3 = 0, 1, CAST(id % 5000 AS INT) + 2)"
    series = spark.range(0, 300_000, 1, 8).selectExpr(
        f"{hot} AS UTM_NORTE", "1 AS UTM_ESTE", "DATE'2000-01-01' + CAST(id % 700 AS INT) AS FECHA_MEDICION",
        "CAST(id AS DOUBLE) AS CAUDAL", "id AS TOTALIZADOR")
    points = spark.range(0, 5002).selectExpr(
        "CAST(id AS INT) AS UTM_Norte", "1 AS UTM_Este", "7 AS COD_SECTOR_SHA", "'S' AS SECTOR_SHA", "true AS es_pozo_subterraneo")
    for name, value in given.items():
        spark.conf.set(name, value)
    try:
        df = area_series(series, points, "shac", "caudal", "7")
        assert sum(r.caudal_sumado for r in df.collect()) == 300_000 * 299_999 / 2
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in given:
            spark.conf.unset(name)
