"""Geometry check and load compute the traces once, and places find their stations over cells' edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shotframe.operators import geometry

KIND = "trace long, ffid long, source_point long, source_x long, source_y long, receiver_x long, receiver_y long, coordinate_scalar int"
STATIONS = [(1, p, p * 20.0, 100.0, 1.0) for p in range(1, 9)]


def counted(spark):
    """Traces of four shots (numbered right, wrongly, swapped, off), and how often their rows were computed."""
    shots = [(1, 1, 20, 100), (2, 99, 41, 100), (3, 98, 100, 60), (4, 97, 70, 300)]
    rows = [(f * 10 + k, f, p, x, y, 20 * k, 100, 1) for f, p, x, y in shots for k in (1, 2, 3)]
    n = spark.sparkContext.accumulator(0)

    def seen(v):
        n.add(1)
        return v

    return spark.createDataFrame(rows, KIND).withColumn("source_x", F.udf(seen, "long")("source_x")), n, len(rows)


def test_check_computes_traces_once(spark):
    traces, n, rows = counted(spark)
    stations = spark.createDataFrame(STATIONS, "line int, point long, x double, y double, elevation double")
    got = {r.category: r.n for r in geometry.check(traces, stations, stations).collect()}
    assert got == {"SourceSwap": 1, "SourcePos": 1, "SourceNumbering": 1, "MissingStation": 5}
    assert n.value == rows


def test_load_computes_traces_once(spark):
    traces, n, rows = counted(spark)
    stations = spark.createDataFrame(STATIONS, "line int, point long, x double, y double, elevation double")
    got = {r.trace: (r.source_x, r.receiver_x) for r in geometry.load(traces, stations, stations).collect()}
    assert got[11] == (2000, 2000) and got[22] == (4000, 4000) and got[33] == (100, 6000) and n.value == rows


@pytest.mark.parametrize("tolerance", [2.0, 0.3])
def test_places_against_all_pairs(spark, tolerance):
    r = random.Random(3)
    stations = [(i % 3, i, round(r.uniform(-20, 20), 1), round(r.uniform(-20, 20), 1)) for i in range(200)] + [(9, 900, 0.0, 0.0), (9, 901, 4_000_008.0, -16.0)]
    places = {(round(r.uniform(-22, 22), 1), round(r.uniform(-22, 22), 1)) for _ in range(400)} | {(4_000_008.0 - tolerance, -16.0), (4_000_008.0 + tolerance, -16.0), (8.0, 16.0), (-8.0, -16.0)}
    found = geometry.nearest(spark.createDataFrame(list(places), "x double, y double"), spark.createDataFrame(stations, "line int, point int, x double, y double"), tolerance)
    want = {}
    for x, y in places:
        near = min((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), line, point) for line, point, a, b in stations)
        if near[0] <= tolerance:
            want[x, y] = near
    assert {(f.x, f.y): (f.dist, f.line, f.point) for f in found.collect()} == want
