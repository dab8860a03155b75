"""Map projections against published worked examples, and round trips."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from shotframe.operators.projections import ISRAEL, Crs, Projection, from_lonlat, project, reproject, to_lonlat, unproject
from shotframe.plans import maps, portfolio  # noqa: F401

SF = "/root/testdata/sf0.001"
CLARKE_66 = dict(a=6378206.4, f=1 - 6356583.8 / 6378206.4)


def dms(d, m=0.0, s=0.0):
    return (abs(d) + m / 60 + s / 3600) * (-1 if d < 0 else 1)


# Worked examples of the public guidance notes and of Snyder's manual: projection, (lon, lat), (easting, northing).
PUBLISHED = {
    "lcc one parallel": (Projection("LCC", lon0=-77, lat0=18, fe=250000, fn=150000, **CLARKE_66), (dms(-76, 56, 37.26), dms(17, 55, 55.8)), (255966.58, 142493.51)),
    "lcc two parallels, feet": (Projection("LCC", lon0=-99, lat0=dms(27, 50), lat1=dms(28, 23), lat2=dms(30, 17), fe=2000000, a=6378206.4 / 0.3048006096012192, f=CLARKE_66["f"]), (-96, 28.5), (2963503.91, 254759.80)),
    "mercator by scale": (Projection("MERC", lon0=110, k0=0.997, fe=3900000, fn=900000, a=6377397.155, f=1 / 299.15281), (120, -3), (5009726.58, 569150.82)),
    "mercator by parallel": (Projection("MERC", lon0=51, lat_ts=42, a=6378245, f=1 / 298.3), (53, 53), (165704.29, 5171848.07)),
    "mercator of a sphere": (Projection("MERC", f=0), (dms(-100, 20), dms(24, 22, 54.433)), (-11169055.58, 2800000.0)),
    "cassini, links": (Projection("CASS", lon0=dms(-61, 20), lat0=dms(10, 26, 30), fe=430000, fn=325000, a=31706587.88, f=1 / 294.2606764), (-62, 10), (66644.94, 82536.22)),
    "albers": (Projection("AEA", lon0=-96, lat0=23, lat1=29.5, lat2=45.5, **CLARKE_66), (-75, 35), (1885472.7, 1535925.0)),
    "laea": (Projection("LAEA", lon0=10, lat0=52, fe=4321000, fn=3210000, f=1 / 298.257222101), (5, 50), (3962799.45, 2999718.85)),
    "polar by scale": (Projection("STERE", lat0=90, k0=0.994, fe=2e6, fn=2e6), (44, 73), (3320416.75, 632668.43)),
    "polar by parallel": (Projection("STERE", lon0=70, lat0=-90, lat_ts=-71, fe=6e6, fn=6e6), (120, -75), (7255380.79, 7053389.56)),
    "double stereographic": (Projection("STEREA", lon0=dms(5, 23, 15.5), lat0=dms(52, 9, 22.178), k0=0.9999079, fe=155000, fn=463000, a=6377397.155, f=1 / 299.15281), (6, 53), (196105.283, 557057.739)),
}


@pytest.mark.parametrize("name", PUBLISHED)
def test_published(spark, name):
    p, (lon, lat), want = PUBLISHED[name]
    df = spark.createDataFrame([(float(lon), float(lat))], "lon double, lat double")
    df = df.select("*", *(c.alias(n) for c, n in zip(project(F.col("lon"), F.col("lat"), p), "en", strict=True)))
    row = df.select("*", *(c.alias(n) for c, n in zip(unproject(F.col("e"), F.col("n"), p), ("blon", "blat"), strict=True))).first()
    assert (row.e, row.n) == pytest.approx(want, abs=0.05 if name == "albers" else 0.011)
    assert (row.blon, row.blat) == pytest.approx((lon, lat), abs=1e-9)


@pytest.mark.parametrize("p", [
    Projection("LCC", lon0=134, lat0=-32, lat1=-28, lat2=-36), Projection("AEA", lon0=132, lat0=0, lat1=-18, lat2=-36), Projection("LAEA", lat0=90, lon0=10), Projection("LAEA", lat0=-90, lon0=10),
    Projection("MERC", lon0=179.5), Projection("STERE", lat0=-90), Projection("LAEA", f=0.0, lat0=-20, lon0=130)])
def test_round_trips_across_the_date_line(spark, p):
    near = 60.0 if p.polar == 1 else -60.0 if p.polar else -25.0
    rows = [(-179.9, near), (150.0, near - 3), (float(p.lon0), near + 2), (None, near), (140.0, None)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    df = df.select("*", *(c.alias(n) for c, n in zip(project(F.col("lon"), F.col("lat"), p), "en", strict=True)))
    for r in df.select("*", *(c.alias(n) for c, n in zip(unproject(F.col("e"), F.col("n"), p), ("blon", "blat"), strict=True))).collect():
        if r.lon is not None and r.lat is not None:
            assert (r.blon, r.blat) == pytest.approx((r.lon, r.lat), abs=1e-9)
        else:
            assert r.e is None or r.n is None


def test_poles_and_origins(spark):
    for p, point in ((Projection("STERE", lat0=90), (0.0, 90.0)), (Projection("LAEA", lat0=90), (0.0, 90.0)), (Projection("LAEA", lat0=52, lon0=10), (10.0, 52.0)), (Projection("STEREA", lat0=52, lon0=10), (10.0, 52.0))):
        df = spark.createDataFrame([point], "lon double, lat double")
        df = df.select(*(c.alias(n) for c, n in zip(project(F.col("lon"), F.col("lat"), p), "en", strict=True)))
        row = df.first()
        assert (row.e, row.n) == pytest.approx((0, 0), abs=1e-6)
        assert df.select(unproject(F.col("e"), F.col("n"), p)[1].alias("lat")).first().lat == pytest.approx(point[1], abs=1e-7)
    with pytest.raises(ValueError):
        project(F.col("lon"), F.col("lat"), Projection("LCC", lat1=-30, lat2=30))
    with pytest.raises(KeyError):
        project(F.col("lon"), F.col("lat"), Projection("none"))


def test_reprojection_keeps_the_rows_own_columns(spark):
    df = spark.createDataFrame([(200000.0, 600000.0, 7), (None, 1.0, 8)], "easting double, northing double, __x0 int")
    shifted = Crs(ISRAEL, shift=(23.772, 17.49, 17.859, -0.3132, -1.85274, 1.67299, -5.4262))
    there = reproject(df, "easting", "northing", shifted, Crs(Projection("GEO")))
    back = reproject(there, "easting", "northing", Crs(Projection("GEO")), shifted)
    assert there.columns == df.columns
    a, b = sorted(back.collect(), key=lambda r: r["__x0"])
    assert (a.easting, a.northing) == pytest.approx((200000.0, 600000.0), abs=0.01) and b.easting is None
    feet = Crs(Projection("TM", lon0=30.0, fe=500000.0), unit=0.3048, meridian=2.5)
    one = to_lonlat(from_lonlat(spark.createDataFrame([(33.0, 10.0)], "lon double, lat double"), "lon", "lat", feet), "easting", "northing", feet, "a", "b").first()
    assert (one.a, one.b) == pytest.approx((33, 10), abs=1e-8) and one.lon == 33


@pytest.mark.parametrize("name", [n for n in portfolio.queries() if n.startswith(("proj_", "crs_", "utm_zones"))])
def test_map_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{os.path.join(SF, 'customer.parquet')}')")
    got, want = portfolio.queries()[name](spark, SF).toPandas(), duck.execute(portfolio.oracle_sql()[name]).df()
    got, want = (x[sorted(x.columns)].sort_values("c_custkey").reset_index(drop=True) for x in (got, want))
    assert list(got.columns) == list(want.columns) and abs(got - want).max().max() < 1e-6
