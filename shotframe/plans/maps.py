"""Queries of the map projections, with their SQL: the forward formulas written out, the inverse held against its input."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from shotframe.operators.projections import ISRAEL, Crs, Projection, from_lonlat, from_utm, project, to_lonlat, unproject, utm

from .portfolio import query, table


def _n(v: float) -> str:
    """A double as SQL reads it."""
    return f"({v:.17e})"


def _points(spark, d, lon: int, lat: int):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", ((lon * 100 + k % 400 - 200) / 100.0).alias("lon"), ((lat * 100 + k % 700) / 100.0).alias("lat"))


def _sql(p: Projection, lon: int, lat: int, east: str, north: str, pre: str = "") -> str:
    """Rows of p: l is the longitude from the central meridian, f the latitude, both in radians."""
    return f"""WITH c AS (SELECT c_custkey, ({lon * 100} + c_custkey % 400 - 200) / 100.0::DOUBLE AS lon, ({lat * 100} + c_custkey % 700) / 100.0::DOUBLE AS lat FROM customer),
r AS (SELECT *, radians(lon - {_n(p.lon0)}) AS l, radians(lat) AS f FROM c){pre}
SELECT c_custkey, round({_n(p.fe)} + {east}, 3) AS easting, round({_n(p.fn)} + {north}, 3) AS northing, round(lon, 7) AS lon, round(lat, 7) AS lat FROM {'s' if pre else 'r'}"""


def _t(phi: str, p: Projection) -> str:
    """The conformal t: small at the north pole."""
    return f"(tan(pi() / 4 - ({phi}) / 2) / pow((1 - {_n(p.e)} * sin({phi})) / (1 + {_n(p.e)} * sin({phi})), {_n(p.e / 2)}))"


def _m(phi: str, p: Projection) -> str:
    return f"(cos({phi}) / sqrt(1 - {_n(p.e2)} * sin({phi}) ** 2))"


def _q(phi: str, p: Projection) -> str:
    return f"((1 - {_n(p.e2)}) * (sin({phi}) / (1 - {_n(p.e2)} * sin({phi}) ** 2) - ln((1 - {_n(p.e)} * sin({phi})) / (1 + {_n(p.e)} * sin({phi}))) / {_n(2 * p.e)}))"


def _rad(v: float) -> str:
    return _n(math.radians(v))


def _register(name: str, p: Projection, lon: int, lat: int, sql: str) -> None:
    def run(spark, d):
        rows = _points(spark, d, lon, lat)
        east, north = project(F.col("lon"), F.col("lat"), p)
        rows = rows.select("c_custkey", east.alias("e"), north.alias("n"))
        back_lon, back_lat = unproject(F.col("e"), F.col("n"), p)
        return rows.select("c_custkey", F.round("e", 3).alias("easting"), F.round("n", 3).alias("northing"), F.round(back_lon, 7).alias("lon"), F.round(back_lat, 7).alias("lat"))

    run.__name__ = name
    query(sql)(run)


A = Projection("MERC").a
LCC = Projection("LCC", lon0=-99, lat0=27.5, lat1=28.25, lat2=30.25, fe=600000.0, fn=1000.0)
_register("proj_lcc", LCC, -99, 26, _sql(LCC, -99, 26, "rho * sin(n * l)", "rho0 - rho * cos(n * l)", f""",
k AS (SELECT ln({_m(_rad(28.25), LCC)} / {_m(_rad(30.25), LCC)}) / ln({_t(_rad(28.25), LCC)} / {_t(_rad(30.25), LCC)}) AS n),
g AS (SELECT n, {_n(A)} * {_m(_rad(28.25), LCC)} / (n * pow({_t(_rad(28.25), LCC)}, n)) AS g FROM k),
s AS (SELECT r.*, n, g * pow({_t('f', LCC)}, n) AS rho, g * pow({_t(_rad(27.5), LCC)}, n) AS rho0 FROM r, g)"""))
LCC1 = Projection("LCC", lon0=-77, lat0=18, k0=0.9999, fe=250000.0, fn=150000.0)
_register("proj_lcc_one", LCC1, -77, 15, _sql(LCC1, -77, 15, "rho * sin(n * l)", "rho0 - rho * cos(n * l)", f""",
g AS (SELECT sin({_rad(18)}) AS n, 0.9999::DOUBLE * {_n(A)} * {_m(_rad(18), LCC1)} / (sin({_rad(18)}) * pow({_t(_rad(18), LCC1)}, sin({_rad(18)}))) AS g),
s AS (SELECT r.*, n, g * pow({_t('f', LCC1)}, n) AS rho, g * pow({_t(_rad(18), LCC1)}, n) AS rho0 FROM r, g)"""))
MERC = Projection("MERC", lon0=51, lat_ts=42)
_register("proj_mercator", MERC, 51, 38, _sql(MERC, 51, 38, f"{_n(A)} * {_m(_rad(42), MERC)} * l", f"-{_n(A)} * {_m(_rad(42), MERC)} * ln({_t('f', MERC)})"))
WEB = Projection("MERC", f=0.0)
_register("proj_web_mercator", WEB, 3, 40, _sql(WEB, 3, 40, f"{_n(A)} * l", f"{_n(A)} * ln(tan(pi() / 4 + f / 2))"))
CASS = Projection("CASS", lon0=-61, lat0=10.5, fe=86501.46, fn=65379.0)
# The arc from the origin as an integral, by Simpson's rule over 200 strips.
ARC = f"""list_sum(list_transform(generate_series(0, 200), lambda i: (CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * (1 - {_n(CASS.e2)})
  / pow(1 - {_n(CASS.e2)} * sin({_rad(10.5)} + (f - {_rad(10.5)}) * i / 200) ** 2, 1.5))) * (f - {_rad(10.5)}) / 600"""
_register("proj_cassini", CASS, -61, 8, _sql(CASS, -61, 8, "nu * (a - t * a ** 3 / 6 - (8 - t + 8 * k) * t * a ** 5 / 120)", f"{_n(A)} * arc + nu * tan(f) * (a ** 2 / 2 + (5 - t + 6 * k) * a ** 4 / 24)", f""",
s AS (SELECT *, {_n(A)} / sqrt(1 - {_n(CASS.e2)} * sin(f) ** 2) AS nu, l * cos(f) AS a, tan(f) ** 2 AS t, {_n(CASS.e2 / (1 - CASS.e2))} * cos(f) ** 2 AS k, {ARC} AS arc FROM r)"""))
AEA = Projection("AEA", lon0=-96, lat0=23, lat1=29.5, lat2=45.5)
_register("proj_albers", AEA, -96, 31, _sql(AEA, -96, 31, "rho * sin(n * l)", "rho0 - rho * cos(n * l)", f""",
k AS (SELECT ({_m(_rad(29.5), AEA)} ** 2 - {_m(_rad(45.5), AEA)} ** 2) / ({_q(_rad(45.5), AEA)} - {_q(_rad(29.5), AEA)}) AS n),
s AS (SELECT r.*, n, {_n(A)} * sqrt({_m(_rad(29.5), AEA)} ** 2 + n * {_q(_rad(29.5), AEA)} - n * {_q('f', AEA)}) / n AS rho,
  {_n(A)} * sqrt({_m(_rad(29.5), AEA)} ** 2 + n * {_q(_rad(29.5), AEA)} - n * {_q(_rad(23), AEA)}) / n AS rho0 FROM r, k)"""))
LAEA = Projection("LAEA", lon0=10, lat0=52, fe=4321000.0, fn=3210000.0)
_register("proj_laea", LAEA, 8, 47, _sql(LAEA, 8, 47, "b * dd * cos(beta) * sin(l)", "b / dd * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(l))", f""",
k AS (SELECT {_q(_n(math.pi / 2), LAEA)} AS qp, asin({_q(_rad(52), LAEA)} / {_q(_n(math.pi / 2), LAEA)}) AS b0),
j AS (SELECT r.*, b0, {_n(A)} * sqrt(qp / 2) AS rq, asin({_q('f', LAEA)} / qp) AS beta FROM r, k),
s AS (SELECT *, {_n(A)} * {_m(_rad(52), LAEA)} / (rq * cos(b0)) AS dd, rq * sqrt(2 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(l))) AS b FROM j)"""))
LAEA_S = Projection("LAEA", lon0=20, lat0=-90)
_register("proj_laea_polar", LAEA_S, 40, -80, _sql(LAEA_S, 40, -80, "rho * sin(l)", "rho * cos(l)", f""",
s AS (SELECT *, {_n(A)} * sqrt({_q(_n(math.pi / 2), LAEA_S)} + {_q('f', LAEA_S)}) AS rho FROM r)"""))
STERE = Projection("STERE", lon0=0, lat0=90, k0=0.994, fe=2e6, fn=2e6)
_ENDS = f"sqrt(pow({_n(1 + STERE.e)}, {_n(1 + STERE.e)}) * pow({_n(1 - STERE.e)}, {_n(1 - STERE.e)}))"
_register("proj_stereo_polar", STERE, 44, 73, _sql(STERE, 44, 73, "rho * sin(l)", "-rho * cos(l)", f""",
s AS (SELECT *, 2 * {_n(A)} * 0.994::DOUBLE * {_t('f', STERE)} / {_ENDS} AS rho FROM r)"""))
STERE_B = Projection("STERE", lon0=70, lat0=-90, lat_ts=-71, fe=6e6, fn=6e6)
_register("proj_stereo_parallel", STERE_B, 100, -78, _sql(STERE_B, 100, -78, "rho * sin(l)", "rho * cos(l)", f""",
s AS (SELECT *, {_n(A)} * {_m(_rad(71), STERE_B)} * {_t('-f', STERE_B)} / {_t(_rad(71), STERE_B)} AS rho FROM r)"""))
STEREA = Projection("STEREA", lon0=5.4, lat0=52.15, k0=0.9999079, fe=155000.0, fn=463000.0)
_SIN0 = f"sin({_rad(52.15)})"
_register("proj_stereo_oblique", STEREA, 5, 49, _sql(STEREA, 5, 49, "2 * rs * cos(chi) * sin(n * l) / b", "2 * rs * (sin(chi) * cos(chi0) - cos(chi) * sin(chi0) * cos(n * l)) / b", f""",
k AS (SELECT sqrt(1 + {_n(STEREA.e2)} * cos({_rad(52.15)}) ** 4 / (1 - {_n(STEREA.e2)})) AS n, 0.9999079::DOUBLE * {_n(A)} * sqrt(1 - {_n(STEREA.e2)}) / (1 - {_n(STEREA.e2)} * {_SIN0} ** 2) AS rs),
w AS (SELECT *, pow({_t(_rad(52.15), STEREA)}, -2 * n) AS w1 FROM k),
o AS (SELECT *, (n + {_SIN0}) * (1 - (w1 - 1) / (w1 + 1)) / ((n - {_SIN0}) * (1 + (w1 - 1) / (w1 + 1))) AS c FROM w),
h AS (SELECT r.*, n, rs, asin((c * w1 - 1) / (c * w1 + 1)) AS chi0, asin((c * pow({_t('f', STEREA)}, -2 * n) - 1) / (c * pow({_t('f', STEREA)}, -2 * n) + 1)) AS chi FROM r, o),
s AS (SELECT *, 1 + sin(chi) * sin(chi0) + cos(chi) * cos(chi0) * cos(n * l) AS b FROM h)"""))


_BACK = "SELECT c_custkey, round(({0} + c_custkey % 400 - 200) / 100.0::DOUBLE, 7) AS lon, round(({1} + c_custkey % 700) / 100.0::DOUBLE, 7) AS lat FROM customer"


def _there_and_back(spark, d, lon: int, lat: int, crs: Crs, places: int):
    rows = from_lonlat(_points(spark, d, lon, lat), "lon", "lat", crs).select("c_custkey", "easting", "northing")
    return to_lonlat(rows, "easting", "northing", crs).select("c_custkey", F.round("lon", places).alias("lon"), F.round("lat", places).alias("lat"))


@query(_BACK.format(-9900, 2600))
def crs_feet_round_trip(spark, d):
    """A conic in feet, from a prime meridian of its own."""
    crs = Crs(Projection("LCC", lon0=-101.337229, lat0=27.5, lat1=28.25, lat2=30.25, fe=600000.0), unit=0.3048006096012192, meridian=2.337229)
    return _there_and_back(spark, d, -99, 26, crs, 7)


@query(_BACK.format(3500, 3000))
def crs_grid_round_trip(spark, d):
    return _there_and_back(spark, d, 35, 30, Crs(ISRAEL), 7)


@query("SELECT c_custkey, round((500 + c_custkey % 400 - 200) / 100.0::DOUBLE, 5) AS lon, round((4800 + c_custkey % 700) / 100.0::DOUBLE, 5) AS lat FROM customer")
def crs_shifted_round_trip(spark, d):
    """To a local datum and back; the shift's inverse is linear, good to millimetres."""
    crs = Crs(Projection("STEREA", lon0=5.387638889, lat0=52.156160556, k0=0.9999079, fe=155000.0, fn=463000.0, a=6377397.155, f=1 / 299.1528128), shift=(565.2369, 50.0087, 465.658, -0.4069, 0.3507, -1.8703, 4.0812))
    return _there_and_back(spark, d, 5, 48, crs, 5)


@query("SELECT c_custkey, round((c_custkey % 400 - 200) / 100.0::DOUBLE, 6) AS lon, round((-300 + c_custkey % 700) / 100.0::DOUBLE, 6) AS lat FROM customer")
def utm_zones_round_trip(spark, d):
    """Zones 30 and 31 on both sides of the equator."""
    from shotframe.operators.geodesy import utm_zone

    points = _points(spark, d, 0, -3).withColumns({"zone": utm_zone(F.col("lon")), "south": F.col("lat") < 0})
    east, north = utm(F.col("lon"), F.col("lat"), F.col("zone"), F.col("south"))
    lon, lat = from_utm(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    return points.select("c_custkey", "zone", "south", east.alias("e"), north.alias("n")).select("c_custkey", (F.round(lon, 6) + 0.0).alias("lon"), (F.round(lat, 6) + 0.0).alias("lat"))
