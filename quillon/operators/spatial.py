"""Radius and nearest-neighbour search around a place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import haversine_km, number

#: Fixed value: km in a degree of latitude, for the bounding box.
KM_PER_DEGREE = 111.0


def coordinate_columns(df: DataFrame) -> tuple[str, str]:
    """The columns of latitude and longitude: by whole word in the name, then by its beginning, then the fifth and sixth."""
    words = {c: c.lower().replace("-", "_").split("_") for c in df.columns}

    def find(names: tuple[str, ...]) -> str | None:
        whole = [c for c in df.columns if set(words[c]) & set(names)]
        start = [c for c in df.columns if any(w.startswith(names[0]) for w in words[c])]
        return next(iter(whole + start), None)

    lat, lon = find(("lat", "latitude")), find(("lon", "longitude", "lng", "long"))
    if lat and lon:
        return lat, lon
    if len(df.columns) > 5:
        return df.columns[4], df.columns[5]
    raise ValueError(f"no coordinates among {df.columns}")


def places(df: DataFrame, lat: str | None = None, lon: str | None = None) -> DataFrame:
    """Rows whose coordinates are numbers on the globe, with these as doubles in place of what they were."""
    if lat is None or lon is None:
        lat, lon = coordinate_columns(df)
    kinds = dict(df.dtypes)
    for c in (lat, lon):
        if kinds[c] != "double":
            df = df.withColumn(c, number(F.col(f"`{c}`")))
    ok = lambda c, top: F.col(f"`{c}`").between(-top, top) & ~F.isnan(f"`{c}`")
    return df.filter(ok(lat, 90.0) & ok(lon, 180.0))


def in_box(lat: Column, lon: Column, at_lat: float, at_lon: float, radius_km: float) -> Column:
    """The bounding box of a circle; it goes on across the date line and around the poles."""
    d_lat = radius_km / KM_PER_DEGREE
    inside = lat.between(at_lat - d_lat, at_lat + d_lat)
    if abs(at_lat) + d_lat >= 89.0:
        return inside
    d_lon = d_lat / max(math.cos(math.radians(abs(at_lat) + d_lat)), 0.01)
    if d_lon >= 180.0:
        return inside
    low, high = at_lon - d_lon, at_lon + d_lon
    around = lon.between(low, high)
    if low < -180:
        around = around | (lon >= low + 360)
    if high > 180:
        around = around | (lon <= high - 360)
    return inside & around


def _distance(df: DataFrame, lat: str, lon: str, at_lat: float, at_lon: float) -> Column:
    return haversine_km(F.lit(float(at_lat)), F.lit(float(at_lon)), F.col(f"`{lat}`"), F.col(f"`{lon}`"))


def radius(df: DataFrame, at_lat: float, at_lon: float, radius_km: float, lat: str = "lat", lon: str = "lon", tie: str | None = None) -> DataFrame:
    """Rows within the radius with ``dist`` in km, closest first. The box reaches the scan, the distance refines it.

    A radius of 0 or less gives no rows. Places across the date line are found.
    """
    if radius_km <= 0:
        return df.withColumn("dist", F.lit(0.0)).filter("false")
    boxed = df.filter(in_box(F.col(f"`{lat}`"), F.col(f"`{lon}`"), at_lat, at_lon, radius_km))
    near = boxed.withColumn("dist", _distance(df, lat, lon, at_lat, at_lon)).filter(F.col("dist") <= radius_km)
    return near.orderBy("dist", *([tie] if tie else []))


def nearest(df: DataFrame, at_lat: float, at_lon: float, k: int, lat: str = "lat", lon: str = "lon", tie: str | None = None) -> DataFrame:
    """The k closest rows with ``dist`` in km; ties by ``tie``."""
    far = df.withColumn("dist", _distance(df, lat, lon, at_lat, at_lon))
    return far.orderBy(F.round("dist", 6), *([tie] if tie else [])).limit(max(0, k))


def search(df: DataFrame, at_lat: float, at_lon: float, parameter: int | float | str, **columns: str) -> DataFrame:
    """k-NN for an int or digits, else radius."""
    text = str(parameter).strip()
    if text.lstrip("+-").isdigit():
        return nearest(df, at_lat, at_lon, int(text), **columns)
    return radius(df, at_lat, at_lon, float(text), **columns)


def formatted(df: DataFrame) -> DataFrame:
    """Distances with three decimals."""
    return df.withColumn("dist", F.round("dist", 3))
