"""Map projections as native column expressions, forward and inverse, and shifts between datums.

A null coordinate gives null. Latitudes come back from auxiliary latitudes by sine series whose coefficients are
computed for the ellipsoid while the plan is built, so no row iterates.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geodesy import WGS84_A, WGS84_F, geocentric, helmert, inverse_transverse_mercator, transverse_mercator

TERMS = 7
SAMPLES = 64


@dataclass(frozen=True)
class Projection:
    """Degrees and metres; ``f`` 0 is a sphere. lat_ts is a latitude of true scale (second variants)."""

    method: str
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float | None = None
    lat2: float | None = None
    lat_ts: float | None = None
    k0: float = 1.0
    fe: float = 0.0
    fn: float = 0.0
    a: float = WGS84_A
    f: float = WGS84_F

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    @property
    def polar(self) -> int:
        """1 at the north pole, -1 at the south pole, else 0."""
        return 0 if abs(abs(self.lat0) - 90) > 1e-9 else int(math.copysign(1, self.lat0))

    def parallel(self, lat: float) -> float:
        """Radius of a parallel over a."""
        phi = math.radians(lat)
        return math.cos(phi) / math.sqrt(1 - self.e2 * math.sin(phi) ** 2)


# --- auxiliary latitudes of numbers, in radians ---


def isometric_of(phi: float, e: float) -> float:
    return math.copysign(math.asinh(math.tan(abs(phi))) - e * math.atanh(e * math.sin(abs(phi))), phi)


def _conformal_of(phi: float, e: float) -> float:
    return math.atan(math.sinh(isometric_of(phi, e)))


def authalic_q_of(phi: float, e: float) -> float:
    s = math.sin(phi)
    return (1 - e * e) * (s / (1 - (e * s) ** 2) + math.atanh(e * s) / e) if e else 2 * s


def _authalic_of(phi: float, e: float) -> float:
    return math.asin(max(-1.0, min(1.0, authalic_q_of(phi, e) / authalic_q_of(math.pi / 2, e))))


def _arc_of(phi: float, e: float) -> float:
    """Meridian arc over a, by Simpson's rule."""
    n = 200
    h, g = phi / n, lambda t: (1 - e * e) / (1 - (e * math.sin(t)) ** 2) ** 1.5
    return h / 3 * (g(0.0) + g(phi) + 4 * sum(g(h * k) for k in range(1, n, 2)) + 2 * sum(g(h * k) for k in range(2, n, 2)))


def _rectifying_of(phi: float, e: float) -> float:
    return _arc_of(phi, e) / _arc_of(math.pi / 2, e) * math.pi / 2


@cache
def _sines(of: Callable[[float, float], float], e: float, back: bool = True) -> tuple[float, ...]:
    """Coefficients c_k with latitude = aux + sum c_k sin(2 k aux); without back those of the way there."""
    if not e:
        return ()
    grid = [j * math.pi / 2 / SAMPLES for j in range(1, SAMPLES)]
    if back:
        gaps = []
        for aux in grid:
            low, high = 0.0, math.pi / 2
            for _ in range(60):
                middle = (low + high) / 2
                low, high = (middle, high) if of(middle, e) < aux else (low, middle)
            gaps.append((low + high) / 2 - aux)
    else:
        gaps = [of(phi, e) - phi for phi in grid]
    return tuple(2 / SAMPLES * sum(g * math.sin(2 * k * x) for g, x in zip(gaps, grid, strict=True)) for k in range(1, TERMS + 1))


def _series(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = x
    for k, c in enumerate(coefficients, 1):
        out = out + c * F.sin(2 * k * x)
    return out


# --- the same of columns ---


def _isometric(phi: Column, e: float) -> Column:
    size = F.abs(phi)
    return F.signum(phi) * (F.asinh(F.tan(size)) - e * F.atanh(e * F.sin(size)))


def _latitude_of_isometric(psi: Column, e: float) -> Column:
    return _series(F.atan(F.sinh(psi)), _sines(_conformal_of, e))


def _authalic_q(phi: Column, e: float) -> Column:
    s = F.sin(phi)
    return (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(e * s) / e) if e else 2 * s


def _unit(x: Column) -> Column:
    return F.when(x > 1, 1.0).when(x < -1, -1.0).otherwise(x)


def _root(x: Column) -> Column:
    return F.sqrt(F.when(x < 0, 0.0).otherwise(x))


def _turn(degrees: Column) -> Column:
    """Degrees within -180 to 180."""
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


# --- methods: forward (lam, phi in radians) -> (x, y); inverse (x, y) -> (lam, phi) ---


def _cone(p: Projection) -> tuple[float, float, float]:
    """Conformal cone: n, radius factor, radius of the origin."""
    first = p.lat0 if p.lat1 is None else p.lat1
    second = first if p.lat2 is None else p.lat2
    psi = lambda lat: isometric_of(math.radians(lat), p.e)
    one = abs(first - second) < 1e-9
    n = math.sin(math.radians(first)) if one else math.log(p.parallel(first) / p.parallel(second)) / (psi(second) - psi(first))
    if abs(n) < 1e-10:
        raise ValueError("a conic needs standard parallels that aren't mirrored at the equator")
    scale = p.a * p.parallel(first) * math.exp(n * psi(first)) / n * (p.k0 if one else 1.0)
    return n, scale, 0.0 if p.polar else scale * math.exp(-n * psi(p.lat0))


def _lcc(lam, phi, p):
    n, scale, origin = _cone(p)
    rho = scale * F.exp(-n * _isometric(phi, p.e))
    return rho * F.sin(n * lam), origin - rho * F.cos(n * lam)


def _lcc_back(x, y, p):
    n, scale, origin = _cone(p)
    side = math.copysign(1.0, n)
    rho = F.sqrt(x * x + (origin - y) * (origin - y))
    psi = -F.log(rho / abs(scale)) / n
    return F.atan2(side * x, side * (origin - y)) / n, F.when(rho == 0, side * math.pi / 2).otherwise(_latitude_of_isometric(psi, p.e))


def _merc_scale(p: Projection) -> float:
    standard = p.lat_ts if p.lat_ts is not None else p.lat1
    return p.a * (p.k0 if standard is None else p.parallel(standard))


def _merc(lam, phi, p):
    return _merc_scale(p) * lam, _merc_scale(p) * _isometric(phi, p.e)


def _merc_back(x, y, p):
    return x / _merc_scale(p), _latitude_of_isometric(y / _merc_scale(p), p.e)


def _cass_parts(phi, p):
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    w = 1 - p.e2 * s * s
    return p.a / F.sqrt(w), p.a * (1 - p.e2) / (w * F.sqrt(w)), c, t


def _cass(lam, phi, p):
    nu, _, cos, tan = _cass_parts(phi, p)
    a, t, c = lam * cos, tan * tan, p.e2 / (1 - p.e2) * cos * cos
    quarter = _arc_of(math.pi / 2, p.e) * 2 / math.pi
    arc = p.a * quarter * _series(phi, _sines(_rectifying_of, p.e, False)) - p.a * _arc_of(math.radians(p.lat0), p.e)
    return (nu * (a - t * a * a * a / 6 - (8 - t + 8 * c) * t * a * a * a * a * a / 120),
            arc + nu * tan * (a * a / 2 + (5 - t + 6 * c) * a * a * a * a / 24))


def _cass_back(x, y, p):
    quarter = _arc_of(math.pi / 2, p.e) * 2 / math.pi
    foot = _series((y / p.a + _arc_of(math.radians(p.lat0), p.e)) / quarter, _sines(_rectifying_of, p.e))
    nu, rho, cos, tan = _cass_parts(foot, p)
    d, t = x / nu, tan * tan
    return ((d - t * d * d * d / 3 + (1 + 3 * t) * t * d * d * d * d * d / 15) / cos,
            foot - nu * tan / rho * (d * d / 2 - (1 + 3 * t) * d * d * d * d / 24))


def _equal_cone(p: Projection) -> tuple[float, float, float]:
    first = p.lat0 if p.lat1 is None else p.lat1
    second = first if p.lat2 is None else p.lat2
    q = lambda lat: authalic_q_of(math.radians(lat), p.e)
    m1, m2 = p.parallel(first), p.parallel(second)
    n = math.sin(math.radians(first)) if abs(first - second) < 1e-9 else (m1 * m1 - m2 * m2) / (q(second) - q(first))
    if abs(n) < 1e-10:
        raise ValueError("a conic needs standard parallels that aren't mirrored at the equator")
    c = m1 * m1 + n * q(first)
    return n, c, p.a * math.sqrt(c - n * q(p.lat0)) / n


def _aea(lam, phi, p):
    n, c, origin = _equal_cone(p)
    rho = p.a / n * _root(c - n * _authalic_q(phi, p.e))
    return rho * F.sin(n * lam), origin - rho * F.cos(n * lam)


def _aea_back(x, y, p):
    n, c, origin = _equal_cone(p)
    side = math.copysign(1.0, n)
    q = (c - (x * x + (origin - y) * (origin - y)) * (n / p.a) ** 2) / n
    beta = F.asin(_unit(q / authalic_q_of(math.pi / 2, p.e)))
    return F.atan2(side * x, side * (origin - y)) / n, _series(beta, _sines(_authalic_of, p.e))


def _laea(lam, phi, p):
    pole, q = authalic_q_of(math.pi / 2, p.e), _authalic_q(phi, p.e)
    if p.polar:
        rho = p.a * _root(pole - p.polar * q)
        return rho * F.sin(lam), -p.polar * rho * F.cos(lam)
    beta, beta0 = F.asin(_unit(q / pole)), _authalic_of(math.radians(p.lat0), p.e)
    radius = p.a * math.sqrt(pole / 2)
    d = p.a * p.parallel(p.lat0) / (radius * math.cos(beta0))
    b = radius * F.sqrt(2 / (1 + math.sin(beta0) * F.sin(beta) + math.cos(beta0) * F.cos(beta) * F.cos(lam)))
    return b * d * F.cos(beta) * F.sin(lam), b / d * (math.cos(beta0) * F.sin(beta) - math.sin(beta0) * F.cos(beta) * F.cos(lam))


def _laea_back(x, y, p):
    pole = authalic_q_of(math.pi / 2, p.e)
    if p.polar:
        beta = F.asin(_unit(p.polar * (1 - (x * x + y * y) / (p.a * p.a * pole))))
        return F.atan2(x, -p.polar * y), _series(beta, _sines(_authalic_of, p.e))
    beta0, radius = _authalic_of(math.radians(p.lat0), p.e), p.a * math.sqrt(pole / 2)
    d = p.a * p.parallel(p.lat0) / (radius * math.cos(beta0))
    u, v = x / d, y * d
    rho = F.sqrt(u * u + v * v)
    lam, beta = _around(u, v, rho, 2 * F.asin(_unit(rho / (2 * radius))), beta0)
    return lam, _series(beta, _sines(_authalic_of, p.e))


def _around(x: Column, y: Column, rho: Column, c: Column, lat0: float) -> tuple[Column, Column]:
    """On a sphere: (longitude difference, latitude) at the angle c from an origin, in the direction of (x, y)."""
    s0, c0 = math.sin(lat0), math.cos(lat0)
    lat = F.asin(_unit(F.cos(c) * s0 + y * F.sin(c) * c0 / F.when(rho == 0, 1.0).otherwise(rho)))
    return F.atan2(x * F.sin(c), rho * c0 * F.cos(c) - y * s0 * F.sin(c)), lat


def _stere_scale(p: Projection) -> float:
    """Radius for an isometric exponential of 1."""
    ends = math.sqrt((1 + p.e) ** (1 + p.e) * (1 - p.e) ** (1 - p.e))
    if p.lat_ts is None or abs(abs(p.lat_ts) - 90) < 1e-9:
        return 2 * p.a * p.k0 / ends
    return p.a * p.parallel(p.lat_ts) * math.exp(isometric_of(math.radians(abs(p.lat_ts)), p.e))


def _stere_side(p: Projection) -> int:
    return p.polar or int(math.copysign(1, p.lat_ts if p.lat_ts else p.lat0))


def _stere(lam, phi, p):
    side = _stere_side(p)
    rho = _stere_scale(p) * F.exp(-side * _isometric(phi, p.e))
    return rho * F.sin(lam), -side * rho * F.cos(lam)


def _stere_back(x, y, p):
    side = _stere_side(p)
    rho = F.sqrt(x * x + y * y)
    psi = -side * F.log(rho / _stere_scale(p))
    return F.atan2(x, -side * y), F.when(rho == 0, side * math.pi / 2).otherwise(_latitude_of_isometric(psi, p.e))


def _double(p: Projection) -> tuple[float, float, float, float]:
    """Conformal sphere at the origin: diameter at scale, exponent, shift of the isometric latitude, latitude of the origin."""
    phi = math.radians(p.lat0)
    s = math.sin(phi)
    w = 1 - p.e2 * s * s
    radius = p.a * math.sqrt(1 - p.e2) / w
    n = math.sqrt(1 + p.e2 * math.cos(phi) ** 4 / (1 - p.e2))
    near = math.tanh(n * isometric_of(phi, p.e))
    shift = math.log((n + s) * (1 - near) / ((n - s) * (1 + near))) / 2
    return 2 * radius * p.k0, n, shift, math.asin(math.tanh(n * isometric_of(phi, p.e) + shift))


def _sterea(lam, phi, p):
    size, n, shift, chi0 = _double(p)
    chi, dl = F.atan(F.sinh(n * _isometric(phi, p.e) + shift)), n * lam
    b = 1 + F.sin(chi) * math.sin(chi0) + F.cos(chi) * math.cos(chi0) * F.cos(dl)
    return size * F.cos(chi) * F.sin(dl) / b, size * (F.sin(chi) * math.cos(chi0) - F.cos(chi) * math.sin(chi0) * F.cos(dl)) / b


def _sterea_back(x, y, p):
    size, n, shift, chi0 = _double(p)
    rho = F.sqrt(x * x + y * y)
    dl, chi = _around(x, y, rho, 2 * F.atan(rho / size), chi0)
    return dl / n, _latitude_of_isometric((F.signum(chi) * F.asinh(F.tan(F.abs(chi))) - shift) / n, p.e)


METHODS = {
    "LCC": (_lcc, _lcc_back),
    "MERC": (_merc, _merc_back),
    "CASS": (_cass, _cass_back),
    "AEA": (_aea, _aea_back),
    "LAEA": (_laea, _laea_back),
    "STERE": (_stere, _stere_back),
    "STEREA": (_sterea, _sterea_back),
}


def project(lon: Column, lat: Column, p: Projection) -> tuple[Column, Column]:
    """(easting, northing) of degrees on the projection's own ellipsoid; an unknown method raises."""
    if p.method == "TM":
        return transverse_mercator(lon, lat, p.lon0, p.lat0, p.k0, p.fe, p.fn, p.a, p.f)
    x, y = METHODS[p.method][0](F.radians(_turn(lon - p.lon0)), F.radians(lat), p)
    return x + p.fe, y + p.fn


def unproject(east: Column, north: Column, p: Projection) -> tuple[Column, Column]:
    """(lon, lat) in degrees, the inverse of project."""
    if p.method == "TM":
        return inverse_transverse_mercator(east, north, p.lon0, p.lat0, p.k0, p.fe, p.fn, p.a, p.f)
    lam, phi = METHODS[p.method][1](east - p.fe, north - p.fn, p)
    return _turn(F.degrees(lam) + p.lon0), F.degrees(phi)


def geodetic(x: Column, y: Column, z: Column, a: float = WGS84_A, f: float = WGS84_F) -> tuple[Column, Column]:
    """(lon, lat) in degrees of geocentric metres, by the reduced latitude; exact near the surface."""
    e2, b = f * (2 - f), a * (1 - f)
    r = F.sqrt(x * x + y * y)
    u = F.atan2(z * a, r * b)
    su, cu = F.sin(u), F.cos(u)
    return F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z + e2 / (1 - e2) * b * su * su * su, r - e2 * a * cu * cu * cu))


def _free(df: DataFrame, *names: str) -> list[str]:
    taken = set(df.columns)
    return [next(n for k in range(len(taken) + 1) if (n := f"__{name}{k}") not in taken) for name in names]


def shift_datum(df: DataFrame, lon: str, lat: str, shift: tuple[float, ...], source: tuple[float, float], target: tuple[float, float]) -> DataFrame:
    """lon and lat, at height 0 on the source's (a, f), as degrees on the target's. Each step is a column of its own, so no step is computed twice."""
    names = _free(df, "x", "y", "z")
    df = df.withColumns(dict(zip(names, helmert(*geocentric(F.col(lon), F.col(lat), F.lit(0.0), *source), shift), strict=True)))
    return df.withColumns(dict(zip((lon, lat), geodetic(*map(F.col, names), *target), strict=True))).drop(*names)


def to_wgs84(df: DataFrame, lon: str, lat: str, shift: tuple[float, ...], a: float, f: float) -> DataFrame:
    return shift_datum(df, lon, lat, shift, (a, f), (WGS84_A, WGS84_F))


def from_wgs84(df: DataFrame, lon: str, lat: str, shift: tuple[float, ...], a: float, f: float) -> DataFrame:
    """The shift's parameters with the other sign."""
    return shift_datum(df, lon, lat, tuple(-v for v in shift), (WGS84_A, WGS84_F), (a, f))


def utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    east, north = transverse_mercator(lon, lat, zone * 6 - 183)
    return east, north + F.when(south, 1e7).otherwise(0.0)


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    return inverse_transverse_mercator(east, north - F.when(south, 1e7).otherwise(0.0), zone * 6 - 183)


# The Israeli grid (EPSG 2039), GRS 80.
ISRAEL = Projection("TM", lon0=35.2045169444444, lat0=31.7343936111111, k0=1.0000067, fe=219529.584, fn=626907.39, f=1 / 298.257222101)


@dataclass(frozen=True)
class Crs:
    """A projection (method GEO: degrees as they are) with its linear unit in metres, its prime meridian and its shift to WGS 84."""

    projection: Projection
    unit: float = 1.0
    meridian: float = 0.0
    shift: tuple[float, ...] | None = None

    def on_greenwich(self) -> Projection:
        return replace(self.projection, lon0=self.projection.lon0 + self.meridian)


def to_lonlat(df: DataFrame, east: str, north: str, crs: Crs, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds WGS 84 lon and lat of coordinates in any system; the false origin is metric, the coordinates are in the system's unit."""
    p, x, y = crs.projection, F.col(east), F.col(north)
    found = (x + crs.meridian, y) if p.method == "GEO" else unproject(x * crs.unit, y * crs.unit, crs.on_greenwich())
    df = df.withColumns(dict(zip((lon, lat), found, strict=True)))
    return to_wgs84(df, lon, lat, crs.shift, p.a, p.f) if crs.shift and any(crs.shift) else df


def from_lonlat(df: DataFrame, lon: str, lat: str, crs: Crs, east: str = "easting", north: str = "northing") -> DataFrame:
    """Adds coordinates of WGS 84 lon and lat, the inverse of to_lonlat; lon and lat stay as they are."""
    p = crs.projection
    own = _free(df, "lon", "lat")
    df = df.withColumns({own[0]: F.col(lon), own[1]: F.col(lat)})
    if crs.shift and any(crs.shift):
        df = from_wgs84(df, *own, crs.shift, p.a, p.f)
    x, y = F.col(own[0]), F.col(own[1])
    if p.method == "GEO":
        return df.withColumns({east: x - crs.meridian, north: y}).drop(*own)
    e, n = project(x, y, crs.on_greenwich())
    return df.withColumns({east: e / crs.unit, north: n / crs.unit}).drop(*own)


def reproject(df: DataFrame, east: str, north: str, source: Crs, target: Crs) -> DataFrame:
    """east and north of one system as those of another, in place."""
    own = _free(df, "glon", "glat")
    return from_lonlat(to_lonlat(df, east, north, source, *own), *own, target, east, north).drop(*own)
