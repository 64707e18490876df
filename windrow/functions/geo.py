"""Distances, bearings and local plane coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from windrow.functions.exprs import ColumnLike, col

# fixed values
EARTH_KM = 6_371.0088
EARTH_M = 6_371_008.8
KM_PER_LON_DEGREE = 111.320
KM_PER_LAT_DEGREE = 110.574


def haversine_km(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    a1, a2 = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat, half_lon = (a2 - a1) / 2.0, F.radians(col(lon2) - col(lon1)) / 2.0
    h = F.sin(half_lat) * F.sin(half_lat) + F.cos(a1) * F.cos(a2) * F.sin(half_lon) * F.sin(half_lon)
    return EARTH_KM * 2.0 * F.asin(F.sqrt(F.greatest(F.least(h, F.lit(1.0)), F.lit(0.0))))


def local_xy_km(lat: ColumnLike, lon: ColumnLike, lat0: ColumnLike, lon0: ColumnLike) -> tuple[Column, Column]:
    x = (col(lon) - col(lon0)) * KM_PER_LON_DEGREE * F.cos(F.radians(col(lat0)))
    return x, (col(lat) - col(lat0)) * KM_PER_LAT_DEGREE


def displacement_m(lat0: ColumnLike, lon0: ColumnLike, lat: ColumnLike, lon: ColumnLike) -> tuple[Column, Column]:
    """East and north offset in metres."""
    north = F.radians(col(lat) - col(lat0)) * EARTH_M
    east = F.radians(col(lon) - col(lon0)) * EARTH_M * F.cos(F.radians(col(lat0)))
    return east, north


def bearing(east: ColumnLike, north: ColumnLike) -> Column:
    return F.pmod(F.degrees(F.atan2(col(east), col(north))), F.lit(360.0))


def parse_dms(text: ColumnLike) -> tuple[Column, Column]:
    """Degrees, minutes and seconds with N/S and E/W letters, eight tokens, to signed decimal degrees; null otherwise."""
    tokens = F.regexp_extract_all(F.upper(col(text)), F.lit(r"([\d.]+|[NSEW])"), 1)
    ok = F.size(tokens) == 8

    def part(first: int, negative: str) -> Column:
        d, m, s = [F.try_element_at(tokens, F.lit(first + i)).try_cast("double") for i in range(3)]
        value = d + m / 60.0 + s / 3600.0
        return F.when(ok, F.when(F.try_element_at(tokens, F.lit(first + 3)) == negative, -value).otherwise(value))

    return part(1, "S"), part(5, "W")
