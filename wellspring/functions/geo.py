"""Distances, grid cells and reference evapotranspiration."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellspring.functions.numeric import half_even

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_dp = (p2 - p1) / F.lit(2.0)
    half_dl = F.radians(lon2 - lon1) / F.lit(2.0)
    a = F.sin(half_dp) * F.sin(half_dp) + F.cos(p1) * F.cos(p2) * F.sin(half_dl) * F.sin(half_dl)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.hypot(lat1 - lat2, lon1 - lon2) * F.lit(KM_PER_DEGREE)


def snap(coord: Column, degrees: float) -> Column:
    """Nearest multiple of ``degrees``, half to even, at 4 decimals."""
    return half_even(F.rint(coord / F.lit(degrees)) * F.lit(degrees), 4)


def hargreaves_et0(lat: Column, doy: Column, tmax: Column, tmin: Column, tmean: Column) -> Column:
    """FAO-56 Hargreaves reference evapotranspiration in mm/day, never negative."""
    phi = F.radians(lat)
    angle = F.lit(2 * math.pi) * doy / F.lit(365)
    sun_distance = F.lit(1) + F.lit(0.033) * F.cos(angle)
    declination = F.lit(0.409) * F.sin(angle - F.lit(1.39))
    sunset = F.acos(
        F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -F.tan(phi) * F.tan(declination)))
    )
    radiation = (
        F.lit(24 * 60 / math.pi * 0.0820)
        * sun_distance
        * (
            sunset * F.sin(phi) * F.sin(declination)
            + F.cos(phi) * F.cos(declination) * F.sin(sunset)
        )
    )
    spread = F.when(tmax.isNotNull() & tmin.isNotNull(), F.greatest(tmax - tmin, F.lit(0.0)))
    raw = F.lit(0.0023) * (tmean + F.lit(17.8)) * F.sqrt(spread) * radiation * F.lit(0.408)
    return F.when(raw.isNotNull(), F.greatest(raw, F.lit(0.0)))
