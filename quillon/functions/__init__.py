"""Column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: mean radius of the Earth in km.
EARTH_KM = 6371.0


def stripped(c: Column) -> Column:
    """The string without white space at either end."""
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def number(c: Column) -> Column:
    """The value as a double, null if it is none."""
    return stripped(c).try_cast("double")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def dot(x: Column, y: Column) -> Column:
    """Inner product of two arrays of equal length, in double."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(x, x))


def cosine_sim(x: Column, y: Column) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    return let(norm(x) * norm(y), lambda size: F.when(size > 0, dot(x, y) / size).otherwise(F.lit(0.0)))


def l1_normalised(x: Column) -> Column:
    """The array divided by its sum; unchanged where that is 0."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    return let(x, lambda v: let(total(v), lambda t: F.when(t > 0, F.transform(v, lambda e: e / t)).otherwise(v)))


def basename(path: Column) -> Column:
    """The part of a path after its last separator."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def minutes_seconds(seconds: Column) -> Column:
    """Seconds as m:ss."""
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def combined_text(*parts: Column) -> Column:
    """Non-empty parts joined by blanks, nulls left out."""
    return F.trim(F.concat_ws(" ", *[F.when(p.cast("string") != "", p.cast("string")) for p in parts]))


def register_sql(spark: SparkSession) -> None:
    """Make ``haversine_km`` and ``cosine_sim`` callable from SQL, as plain SQL expressions."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE
        RETURN 2 * 6371.0D * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2)
          + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"""
    )
    product = "aggregate(zip_with({0}, {1}, (a, b) -> CAST(a AS DOUBLE) * CAST(b AS DOUBLE)), 0D, (s, v) -> s + v)"
    dot_xy, dot_xx, dot_yy = (product.format(a, b) for a, b in (("x", "y"), ("x", "x"), ("y", "y")))
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION cosine_sim(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN CASE WHEN {dot_xx} > 0 AND {dot_yy} > 0 THEN {dot_xy} / (sqrt({dot_xx}) * sqrt({dot_yy})) ELSE 0D END"""
    )
