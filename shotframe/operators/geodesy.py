"""Coordinates as native column expressions: ellipsoids, transverse Mercator, datum shifts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def transverse_mercator(lon: Column, lat: Column, lon0: float, lat0: float = 0.0, k0: float = 0.9996, fe: float = 500000.0, fn: float = 0.0, a: float = WGS84_A, f: float = WGS84_F) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees, by the usual series to the sixth power."""
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(lon0))
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = F.lit(a) / F.sqrt(F.lit(1.0) - e2 * sin * sin)
    t, c, big_a = tan * tan, ep2 * cos * cos, lam * cos
    m, m0 = meridian_arc(phi, a, e2), meridian_arc_of(math.radians(lat0), a, e2)
    p = lambda k: F.pow(big_a, F.lit(float(k)))
    east = fe + k0 * n * (big_a + (1 - t + c) * p(3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * p(5) / 120)
    north = fn + k0 * (m - m0 + n * tan * (p(2) / 2 + (5 - t + 9 * c + 4 * c * c) * p(4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * p(6) / 720))
    return east, north


def _arc_terms(e2: float) -> tuple[float, float, float, float]:
    return (
        1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024,
        15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)


def meridian_arc(phi: Column, a: float, e2: float) -> Column:
    k0, k2, k4, k6 = _arc_terms(e2)
    return a * (k0 * phi - k2 * F.sin(2 * phi) + k4 * F.sin(4 * phi) - k6 * F.sin(6 * phi))


def meridian_arc_of(phi: float, a: float, e2: float) -> float:
    k0, k2, k4, k6 = _arc_terms(e2)
    return a * (k0 * phi - k2 * math.sin(2 * phi) + k4 * math.sin(4 * phi) - k6 * math.sin(6 * phi))


def inverse_transverse_mercator(east: Column, north: Column, lon0: float, lat0: float = 0.0, k0: float = 0.9996, fe: float = 500000.0, fn: float = 0.0, a: float = WGS84_A, f: float = WGS84_F) -> tuple[Column, Column]:
    """(lon, lat) in degrees, by the footpoint latitude."""
    e2 = f * (2 - f)
    ep2, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    m = meridian_arc_of(math.radians(lat0), a, e2) + (north - fn) / k0
    mu = m / (a * _arc_terms(e2)[0])
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    sin, cos, tan = F.sin(foot), F.cos(foot), F.tan(foot)
    c, t = ep2 * cos * cos, tan * tan
    w = F.lit(1.0) - e2 * sin * sin
    n, r = a / F.sqrt(w), a * (1 - e2) / (w * F.sqrt(w))
    d = (east - fe) / (n * k0)
    p = lambda k: F.pow(d, F.lit(float(k)))
    lat = foot - (n * tan / r) * (p(2) / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * p(4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * p(6) / 720)
    lon = (d - (1 + 2 * t + c) * p(3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * p(5) / 120) / cos
    return F.degrees(lon) + lon0, F.degrees(lat)


def geocentric(lon: Column, lat: Column, height: Column, a: float = WGS84_A, f: float = WGS84_F) -> tuple[Column, Column, Column]:
    e2 = f * (2 - f)
    phi, lam = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(F.lit(1.0) - e2 * F.sin(phi) * F.sin(phi))
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - e2) + height) * F.sin(phi)


def helmert(x: Column, y: Column, z: Column, shift: tuple[float, ...]) -> tuple[Column, Column, Column]:
    """Seven parameters: metres, arc seconds (position vector), parts per million."""
    dx, dy, dz, rx, ry, rz, ppm = shift
    rx, ry, rz = (v * math.pi / 648000 for v in (rx, ry, rz))
    k = 1 + ppm * 1e-6
    return dx + k * (x - rz * y + ry * z), dy + k * (rz * x + y - rx * z), dz + k * (-ry * x + rx * y + z)


def utm_zone(lon: Column) -> Column:
    zone = F.floor((lon + 180) / 6) + 1
    return F.when(zone < 1, 1).when(zone > 60, 60).otherwise(zone).cast("int")
