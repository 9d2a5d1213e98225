import random
from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from acequia.functions import (
    contains_text, false_if_null, full_name, lon_lat, month_map, right_type_label,
    round_half_even, round_or_null_if_zero, timestamp_text,
)


def values(spark, items, type_):
    return spark.createDataFrame([(v,) for v in items], f"x {type_}")


def one_column(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_round_matches_exact_half_even(spark):
    rng = random.Random(7)
    items = [0.125, 0.375, 2.675, -0.125, 1.005, 0.615, -2.675, 0.0, 5e-324, 1e15, -7.5e18, 4.4e13 + 0.005]
    items += [rng.uniform(-1e3, 1e3) for _ in range(2000)]
    items += [k / 8 for k in range(-400, 400)]
    items += [k / 1000 + 0.005 for k in range(-2000, 2000)]
    items += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 11) for _ in range(2000)]
    got = one_column(values(spark, items, "double"), round_half_even(F.col("x")))
    assert got == [round(v, 2) for v in items]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9), min_size=1, max_size=200), st.integers(0, 6))
def test_round_matches_for_any_decimals(spark, items, decimals):
    got = one_column(values(spark, items, "double"), round_half_even(F.col("x"), decimals))
    assert got == [round(v, decimals) for v in items]


def test_round_keeps_null_and_nan(spark):
    got = one_column(values(spark, [None, float("nan")], "double"), round_half_even(F.col("x")))
    assert got[0] is None and got[1] != got[1]


def test_round_or_null_if_zero(spark):
    got = one_column(values(spark, [0.0, -0.0, None, 0.001, 1.234], "double"), round_or_null_if_zero(F.col("x")))
    assert got == [None, None, None, 0.0, 1.23]


def test_full_name(spark):
    rows = [
        ("Juan", "Perez", "Soto"), (" Juan\t", None, " Soto "), (None, "  ", "\t\n"), (None, None, None),
        (" Ana ", "de la Cruz", ""), ("\x1fAna", "", None),
    ]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    expected = [" ".join(p.strip() for p in r if p and p.strip()) or "Desconocido" for r in rows]
    assert one_column(df, full_name(F.col("a"), F.col("b"), F.col("c"))) == expected


@pytest.mark.parametrize("text, hits", [
    ("B-1", {"OB-12", "ob B-1"}),
    ("b-_2", set()),
    ("B-_2", {"OB-12"}),
    ("O%2", {"OB-12", "O\\2"}),
    ("\\", {"O\\2"}),
    ("[O]B", {"OB-12"}),
    ("[^a-z]-[0-9]", {"OB-12", "ob B-1"}),
    ("[", {"x[y"}),
    ("", {"OB-12", "ob B-1", "O\\2", "x[y"}),
])
def test_contains_text(spark, text, hits):
    df = values(spark, ["OB-12", "ob B-1", "O\\2", "x[y", None], "string")
    assert {r.x for r in df.filter(contains_text(F.col("x"), text)).collect()} == hits


def test_lon_lat(spark):
    df = spark.createDataFrame([(6300000, 350000), (6300000, None), (None, 350000)], "n int, e int")
    lon, lat = lon_lat(F.col("n"), F.col("e"))
    got = [tuple(r) for r in df.select(lon, lat).collect()]
    assert got[0] == (pytest.approx(-70.61102068, abs=1e-8), pytest.approx(-33.23751347, abs=1e-8))
    assert got[1:] == [(None, None), (None, None)]


def test_timestamp_text(spark):
    df = values(spark, [datetime(2023, 10, 25, 14, 30), datetime(2023, 3, 1, 0, 0, 0, 500000), None], "timestamp_ntz")
    assert one_column(df, timestamp_text(F.col("x"))) == [
        "2023-10-25 14:30:00", "2023-03-01 00:00:00.500000", None]


def test_timestamp_text_ignores_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Santiago")
        df = spark.sql("SELECT timestamp_ntz'2023-09-03 00:30:00' AS x")  # inside a skipped hour
        assert one_column(df, timestamp_text(F.col("x"))) == ["2023-09-03 00:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_labels_and_flags(spark):
    df = values(spark, [1, 2, 99, None], "int")
    assert one_column(df, right_type_label(F.col("x"))) == [
        "Consuntivo", "No Consuntivo", "Desconocido", "Desconocido"]
    assert one_column(values(spark, [1, 0, None], "int"), false_if_null(F.col("x"))) == [True, False, False]


def test_month_map(spark):
    df = spark.createDataFrame([tuple(float(i) for i in range(12))], ", ".join(f"m{i} double" for i in range(12)))
    got = one_column(df, month_map([f"m{i}" for i in range(12)]))[0]
    assert got["enero"] == 0.0 and got["diciembre"] == 11.0 and len(got) == 12
