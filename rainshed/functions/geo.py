"""Angles, distances and grid geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rainshed import policy


def bearing_toward(e: Column, n: Column) -> Column:
    """Direction a vector points to, degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(e, n)) + 360.0, F.lit(360.0))


def wind_from(u: Column, v: Column) -> Column:
    """Meteorological direction: where the flow comes from."""
    return F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))


def angular_difference(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


# Eight compass sectors and their wind names.
COMPASS = (
    "N-Tramontana",
    "NE-Grecale",
    "E-Levante",
    "SE-Scirocco",
    "S-Ostro",
    "SW-Libeccio",
    "W-Ponente",
    "NW-Maestrale",
)


def compass_sector(deg: Column) -> Column:
    i = F.floor(F.pmod(deg + 22.5, F.lit(360.0)) / 45.0).cast("int")
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in COMPASS]), i), F.lit("NA"))


def dir_sin(deg: Column) -> Column:
    return F.sin(F.radians(deg))


def dir_cos(deg: Column) -> Column:
    return F.cos(F.radians(deg))


def sector_low(deg: Column) -> Column:
    return F.pmod(F.floor(F.pmod(deg, F.lit(360.0)) / policy.SECTOR_STEP_DEG), F.lit(policy.N_SECTORS)).cast("int")


def sector_high(deg: Column) -> Column:
    return F.pmod(sector_low(deg) + 1, F.lit(policy.N_SECTORS))


def sector_fraction(deg: Column) -> Column:
    pos = F.pmod(deg, F.lit(360.0)) / policy.SECTOR_STEP_DEG
    return pos - F.floor(pos)


def sector_nearest(deg: Column) -> Column:
    """Nearest sector centre; halves go to the even sector."""
    step = policy.SECTOR_STEP_DEG
    return F.pmod(F.bround(F.pmod(deg, F.lit(360.0)) / step) * step, F.lit(360.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * policy.EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    x = F.sin(dl) * F.cos(p2)
    y = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(x, y)) + 360.0, F.lit(360.0))


def spherical_area(lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column) -> Column:
    r2 = policy.EARTH_RADIUS_M**2
    return (
        F.lit(r2)
        * F.abs(F.sin(F.radians(lat_hi)) - F.sin(F.radians(lat_lo)))
        * F.abs(F.radians(lon_hi) - F.radians(lon_lo))
    )


def kernel_weight(area: Column, distance_km: Column, angle: Column, sigma: Column | float, scale: Column | float) -> Column:
    return area * F.exp(-distance_km / scale) * F.exp(-0.5 * F.pow(angle / sigma, 2))
