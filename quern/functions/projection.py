"""Transverse Mercator both ways, as column expressions: series in the third flattening to its fourth power, good to a millimetre within a zone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid, and scale and false easting and northing of UTM.
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257223563
SCALE, EAST, NORTH = 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
#: Radius of the sphere of the same meridian, and the eccentricity.
RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ECC = 2 * math.sqrt(_N) / (1 + _N)
# Coefficients of the series (to the plane, from it, and from conformal to geographic latitude), by powers of the third flattening.
TO_PLANE = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4, 61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4)
FROM_PLANE = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - 1 / 360 * _N**4, 1 / 48 * _N**2 + 1 / 15 * _N**3 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4)
LATITUDE = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4)


def central(epsg: Column) -> Column:
    """The central meridian, in degrees, of a UTM zone given by its EPSG code (32601 to 32660 north, 32701 to 32760 south)."""
    return (epsg % 100) * 6 - 183


def _sum(series: tuple[float, ...], f) -> Column:
    out = F.lit(0.0)
    for j, a in enumerate(series, 1):
        out = out + a * f(2 * j)
    return out


def to_utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """struct(x, y): metres in a UTM zone of a place in degrees; null for null."""
    phi, off = F.radians(lat), F.radians(lon - central(epsg))
    t = F.sinh(F.atanh(F.sin(phi)) - ECC * F.atanh(ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(off)), F.atanh(F.sin(off) / F.sqrt(1 + t * t))
    x = EAST + SCALE * RADIUS * (eta + _sum(TO_PLANE, lambda k: F.cos(k * xi) * F.sinh(k * eta)))
    y = F.when(epsg >= 32700, NORTH).otherwise(0.0) + SCALE * RADIUS * (xi + _sum(TO_PLANE, lambda k: F.sin(k * xi) * F.cosh(k * eta)))
    return F.struct(x.alias("x"), y.alias("y"))


def from_utm(x: Column, y: Column, epsg: Column) -> Column:
    """struct(lon, lat): degrees of a place in metres of a UTM zone."""
    xi = (y - F.when(epsg >= 32700, NORTH).otherwise(0.0)) / (SCALE * RADIUS)
    eta = (x - EAST) / (SCALE * RADIUS)
    xi_, eta_ = xi - _sum(FROM_PLANE, lambda k: F.sin(k * xi) * F.cosh(k * eta)), eta - _sum(FROM_PLANE, lambda k: F.cos(k * xi) * F.sinh(k * eta))
    chi = F.asin(F.sin(xi_) / F.cosh(eta_))
    lat = F.degrees(chi + _sum(LATITUDE, lambda k: F.sin(k * chi)))
    return F.struct((central(epsg) + F.degrees(F.atan2(F.sinh(eta_), F.cos(xi_)))).alias("lon"), lat.alias("lat"))
