"""Nearest places by lists of cells: against all pairs, on places that crowd, coincide or lie on a circle."""

import math
import random

import pytest

from shotframe.operators import nearby, raster, survey


def crowded() -> list[tuple[int, float, float]]:
    """Two crowds far smaller than the distance, a circle, copies of a place, and places that aren't given."""
    r = random.Random(7)
    out = [(i, r.gauss(0, 0.01), r.gauss(0, 0.01)) for i in range(300)] + [(300 + i, 900 + r.random(), -500 + r.random()) for i in range(200)]
    out += [(500 + i, 2000 + 60 * math.cos(i), 2000 + 60 * math.sin(i)) for i in range(90)] + [(600 + i, -700.0, 40.0) for i in range(40)]
    return out + [(700, None, 1.0), (701, float("nan"), 1.0), (702, float("inf"), 1.0), (703, -750.0, 40.0), (704, 5000.0, 5000.0)]


def given(rows):
    return [(i, x, y) for i, x, y in rows if x is not None and math.isfinite(x)]


def test_nearest_against_all_pairs(spark):
    targets = crowded()
    r = random.Random(8)
    points = [(i, r.uniform(-1000, 2300), r.uniform(-700, 2300)) for i in range(300)] + [(1000, 2000.0, 2000.0), (1001, 0.0, 0.0), (1002, None, 0.0), (1003, float("inf"), 0.0), (1004, -700.0, 40.0), (1005, -725.0, 40.0)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, x double, y double")
    got = {row.p: (row.distance, row.t) for row in survey.nearest(frame(points, "p"), frame(targets, "t"), "p", "t", "x", "y", 400.0).collect()}
    want = {}
    for p, x, y in given(points):
        d, t = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), t) for t, a, b in given(targets))
        if d <= 400:
            want[p] = (d, t)
    assert got.keys() == want.keys() and {p: v[1] for p, v in got.items()} == {p: v[1] for p, v in want.items()}
    assert all(got[p][0] == pytest.approx(want[p][0], abs=1e-9) for p in want)


def test_spacing_against_all_pairs(spark):
    rows = [*crowded(), (705, 3000.0, 0.0), (705, 3001.0, 0.0), (706, 3010.0, 0.0), (None, 3002.0, 0.0)]  # an id at two places is no neighbour of its own
    got = {row.p: row.gap for row in raster.nearest_spacing(spark.createDataFrame(rows, "p long, x double, y double"), "p", "x", "y", 400.0).collect()}
    want = {}
    known = [row for row in given(rows) if row[0] is not None]
    for p, x, y in known:
        gaps = [g for q, a, b in known if q != p and (g := math.sqrt((x - a) ** 2 + (y - b) ** 2)) <= 400]
        if gaps:
            want[p] = min([*gaps, want.get(p, math.inf)])
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in want)


@pytest.mark.parametrize("apart", [False, True])
def test_pairs_don_t_grow_with_density(spark, apart):
    """Sixteen times the targets and points on the same ground, which one cell held: a point is held against no more targets than before."""
    pairs = []
    for n in (20, 80):
        rows = spark.range(n * n).selectExpr("id", f"id % {n} * {400 / n} AS tx", f"floor(id / {n}) * {400 / n} AS ty").selectExpr("tx", "ty", "id AS low", "id AS high")
        points = rows.selectExpr("low AS id", "tx + 0.5 AS px", "ty + 0.5 AS py")
        pairs.append(nearby._met(points, rows, 400.0, apart).selectExpr("sum(size(targets))").first()[0] / n**2)
    assert max(pairs) <= 2 * nearby.FULL


def test_no_targets(spark):
    none = spark.createDataFrame([], "t long, x double, y double")
    points = spark.createDataFrame([(1, 0.0, 0.0)], "p long, x double, y double")
    assert survey.nearest(points, none, "p", "t", "x", "y", 400.0).count() == 0 and raster.nearest_spacing(points, "p", "x", "y", 400.0).count() == 0
