"""Great-circle distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from particlelake import fixed_values as fv


def _chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    return half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon


def station_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.lit(2.0 * fv.EARTH_RADIUS_STATION_KM) * F.asin(F.sqrt(_chord(lat1, lon1, lat2, lon2)))


def map_distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = _chord(lat1, lon1, lat2, lon2)
    return F.lit(fv.EARTH_RADIUS_MAP_KM) * 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))
