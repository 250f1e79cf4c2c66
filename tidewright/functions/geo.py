"""Spherical geometry on columns of degrees (OP-40, 42, 43, 88, 89, 91)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """OP-88: great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(h.isNotNull(), F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def destination(lat: Column, lon: Column, km: Column, bearing: Column) -> tuple[Column, Column]:
    """The point at a distance and bearing (radians) on the sphere."""
    d, a = km / EARTH_KM, F.radians(lat)
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(bearing))
    east = F.atan2(F.sin(bearing) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.degrees(to), lon + F.degrees(east)


def annulus_point(lat: Column, lon: Column, inner_km: float, outer_km: float, u: Column, v: Column) -> tuple[Column, Column]:
    """OP-40: a point uniform by area in the ring between two distances; u and v are uniform in [0, 1)."""
    km = F.sqrt(u * (outer_km**2 - inner_km**2) + inner_km**2)
    return destination(lat, lon, km, v * (2 * math.pi))


def clamp_lat(lat: Column) -> Column:
    return F.when(lat.isNotNull(), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), lat)))


def wrap_lon(lon: Column) -> Column:
    """OP-42: into [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def lon_360(lon: Column) -> Column:
    """OP-43: into [0, 360)."""
    return F.pmod(lon, F.lit(360.0))


def pixel_km(step_lat: float, step_lon: float, mean_lat: Column) -> tuple[Column, Column]:
    """OP-91: a cell's height and its width at a latitude."""
    return F.lit(KM_PER_DEGREE * step_lat), F.lit(KM_PER_DEGREE * step_lon) * F.cos(F.radians(mean_lat))
