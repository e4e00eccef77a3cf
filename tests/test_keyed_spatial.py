import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import haversine_km
from quillon.operators import keyed, spatial

from .conftest import rows

KEYS = [("5",), ("05",), ("5.0",), (" 5 ",), ("abc",), ("",), (None,), ("12",)]


def test_equal_is_on_stripped_text(spark):
    df = spark.createDataFrame(KEYS, "k string")
    assert rows(keyed.equal(df, "k", " 5")) == [(" 5 ",), ("5",)]
    assert keyed.equal(df, "K", "").count() == 1
    assert keyed.equal(df, 0, "abc").count() == 1


def test_equal_number_compares_numbers_and_falls_back(spark):
    df = spark.createDataFrame(KEYS, "k string")
    assert keyed.equal_number(df, "k", "5").count() == 4
    assert rows(keyed.equal_number(df, "k", "abc")) == [("abc",)]


def test_ranges(spark):
    df = spark.createDataFrame(KEYS, "k string")
    assert [r.k for r in keyed.in_range(df, "btree", "k", "5", "12").collect()][-1] == "12"
    assert keyed.in_range(df, "btree", "k", 5, 12).count() == 5
    assert {r.k for r in keyed.in_range(df, "isam", "k", "05", "12").collect()} == {"05", "12"}
    with pytest.raises(ValueError):
        keyed.in_range(df, "hash", "k", 1, 2)


def test_insert_and_delete_round_trip(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    more = keyed.insert(df, [("3", "c"), (4,)])
    assert rows(more) == [(1, "a"), (2, None), (3, "c"), (4, None)]
    kept, removed = keyed.delete(more, "id", 3)
    assert rows(removed) == [(3, "c")] and kept.count() == 3
    kept, removed = keyed.delete(more, "name", "a")
    assert rows(removed) == [(1, "a")] and kept.filter("name is null").count() == 2
    with pytest.raises(ValueError):
        keyed.insert(df, [(1, 2, 3)])


def test_project_scan_page_and_layout(spark):
    df = spark.createDataFrame([("b", 2), ("a", 10), ("c", 1)], "k string, n int")
    assert keyed.project(df, ["N", "none"]).collect()[0].asDict().keys() == {"N", "none"}
    assert [r.k for r in keyed.scan(df, "sequential", "k").collect()] == ["a", "b", "c"]
    assert [r.n for r in keyed.scan(df, "btree", "n").collect()] == [1, 2, 10]
    assert [r.n for r in keyed.scan(df, "isam", "n").collect()] == [1, 10, 2]
    assert [r.k for r in keyed.page(df, [F.col("k")], 1, 2).collect()] == ["c"]
    assert sum(r.n for r in keyed.layout_stats(keyed.stored(df, "btree", "k")).collect()) == 3
    assert keyed.scan(df.limit(0)).count() == 0


def test_haversine_of_one_degree(spark):
    one = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first().d
    assert round(one, 4) == 111.1949


def _km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, x)))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(-90, 90), st.floats(-180, 180), st.floats(1, 8000))
def test_box_never_loses_a_place(spark, lat, lon, km):
    points = [(a / 2.0, o / 1.0) for a in range(-180, 181, 23) for o in range(-180, 181, 17)]
    df = spark.createDataFrame(points, "lat double, lon double")
    got = {(r.lat, r.lon) for r in spatial.radius(df, lat, lon, km).collect()}
    assert {p for p in points if _km(lat, lon, *p) <= km - 1e-6} <= got <= {p for p in points if _km(lat, lon, *p) <= km + 1e-6}


def test_places_and_dispatch(spark):
    df = spark.createDataFrame([("0", "0"), ("91", "0"), ("NaN", "0"), ("", "0"), ("0", "1")], "platform string, lat string").withColumnRenamed("platform", "lon")
    ok = spatial.places(df, "lon", "lat")
    assert ok.count() == 2
    assert spatial.coordinate_columns(spark.createDataFrame([(1, 2, 3)], "platform int, lat int, lon int")) == ("lat", "lon")
    assert spatial.search(ok, 0, 0, "1", lat="lon", lon="lat").count() == 1
    assert spatial.search(ok, 0, 0, "200.5", lat="lon", lon="lat").count() == 2
    assert spatial.radius(ok, 0, 0, 0, "lon", "lat").count() == 0
    assert spatial.nearest(ok, 0, 0, 99, "lon", "lat").count() == 2
