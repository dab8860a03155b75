"""Nearest places in the plane, exactly, with work that follows the number of rows and not how densely they lie.

The plane is cut into square cells as wide as the distance looked within; a cell's list holds the targets of its own and the eight
around it. A long list of a cell with many points is cut: its cell's four quarters each keep the targets that can be the nearest of any
point inside, which are those no farther from the quarter's edge than the best one is from its farthest corner; quarters without points
are left out. A point, which lies in one cell whose list isn't cut, is held against that list only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotframe.shared import written

#: Targets of a list and points of a cell up to which it isn't cut, and how often cells are quartered at most; lists that stay longer are paged.
FULL, FEW, DEPTH = 24, 8, 16
#: Bits of an id's hash by which two targets are told apart while bounds are taken.
BITS = 4
#: Rounding, as a part of coordinates and distances, that bounds allow for.
SLACK = 1e-12


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, F.lit(2.0)) + F.pow(ay - by, F.lit(2.0)))


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        v = F.col(c).cast("double")
        out &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return out


def _bound(apart: bool) -> Column:
    """Of a cell's list: a distance within which every point of the cell has a target; apart: one with another id than the point's."""
    if not apart:
        return F.min("far")
    # Different ids differ in some bit of their hashes: the nearest of either side are two ids, one of which isn't the point's.
    side = lambda b, v: F.min(F.when(F.col("hash").bitwiseAND(1 << b) == v << b, F.col("far")))
    pairs = [F.when(side(b, 0).isNotNull() & side(b, 1).isNotNull(), F.greatest(side(b, 0), side(b, 1))) for b in range(BITS)]
    return F.least(*pairs, F.min(F.when(F.col("low") != F.col("high"), F.col("far"))))


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


def _listed(rows: DataFrame, points: DataFrame, size: float, within: float, apart: bool) -> DataFrame:
    """rows (cx, cy, tx, ty, low, high) of the cells of a size that have points, without targets too far to count; cut: whether the list was long and the points are many."""
    edge = lambda t, c: F.greatest(F.col(c) * size - F.col(t), F.col(t) - (F.col(c) + 1) * size, F.lit(0.0))
    corner = lambda t, c: F.greatest(F.abs(F.col(t) - F.col(c) * size), F.abs(F.col(t) - (F.col(c) + 1) * size))
    of = lambda m: F.sqrt(m("tx", "cx") * m("tx", "cx") + m("ty", "cy") * m("ty", "cy"))
    most = lambda v: v + (v + F.abs("tx") + F.abs("ty")) * SLACK
    rows = rows.withColumns({"near": of(edge), "far": of(corner), "hash": F.xxhash64("low")}).where(F.col("near") <= most(F.lit(within)))
    held = points.groupBy(_cell("px", size).alias("cx"), _cell("py", size).alias("cy")).agg(F.count(F.lit(1)).alias("points"))
    cells = rows.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.least(_bound(apart), F.lit(within)).alias("bound")).join(held, ["cx", "cy"])
    rows = rows.join(cells, ["cx", "cy"]).where(F.col("near") <= most(F.col("bound")))
    return rows.select("cx", "cy", "tx", "ty", "low", "high", "n", ((F.col("n") > FULL) & (F.col("points") > FEW)).alias("cut"))


def _lists(places: DataFrame, points: DataFrame, within: float, apart: bool) -> tuple[DataFrame, list[int]]:
    """(level, cx, cy, targets): the lists of the cells that aren't cut, and their levels; a level's cells are half as wide as those of the level before."""
    quarters = lambda rows, at: rows.withColumn("dx", F.explode(at)).withColumn("dy", F.explode(at))
    placed = lambda rows, k: rows.select((F.col("cx") * k + F.col("dx")).alias("cx"), (F.col("cy") * k + F.col("dy")).alias("cy"), "tx", "ty", "low", "high")
    near, half = F.array(*[F.lit(d) for d in (-1, 0, 1)]), F.array(F.lit(0), F.lit(1))
    rows = placed(quarters(places.withColumns({"cx": _cell("tx", within), "cy": _cell("ty", within)}), near), 1)
    whole, levels = None, []
    for level in range(DEPTH + 1):
        rows = written(_listed(rows, points, within / 2**level, within, apart), "cells")
        cut = F.col("cut") & F.lit(level < DEPTH)
        seen = rows.agg(F.count_if(~cut).alias("kept"), F.count_if(cut).alias("cut")).first()
        if seen["kept"] or whole is None:
            # The page by the length before the bound: pages of one cell are shorter than FULL, rather than longer.
            page = F.pmod(F.xxhash64("tx", "ty"), F.ceil(F.col("n") / FULL))
            part = rows.where(~cut).select(F.lit(level).alias("level"), "cx", "cy", page.alias("page"), F.struct("tx", "ty", "low", "high").alias("t"))
            whole = part if whole is None else whole.unionByName(part)
            levels.append(level)
        if not seen["cut"]:
            break
        rows = placed(quarters(rows.where(cut), half), 2)
    return whole.groupBy("level", "cx", "cy", "page").agg(F.collect_list("t").alias("targets")).drop("page"), levels


def _met(points: DataFrame, places: DataFrame, within: float, apart: bool) -> DataFrame:
    """points (id, px, py) with the targets of their cell's list, one row for each of its pages."""
    lists, levels = _lists(places, points, within, apart)
    p = points.withColumn("__l", F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.lit(within / 2**v).alias("size")) for v in levels])))
    cell = lambda c: F.floor(F.col(c) / F.col("__l.size")).cast("long")
    return p.withColumns({"level": F.col("__l.level"), "cx": cell("px"), "cy": cell("py")}).drop("__l").join(lists, ["level", "cx", "cy"])


def _points(points: DataFrame, point_id: str, x: str, y: str) -> DataFrame:
    return written(points.where(finite(x, y)).select(F.col(point_id).alias("id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")), "points")


def nearest(points: DataFrame, targets: DataFrame, point_id: str, target_id: str, x: str, y: str, within: float) -> DataFrame:
    """(point, target, distance): the nearest target within a distance, the smaller id of equals; places that aren't finite have none."""
    places = targets.where(finite(x, y)).groupBy(F.col(x).cast("double").alias("tx"), F.col(y).cast("double").alias("ty")).agg(F.min(F.struct(F.col(target_id).alias("id"))).alias("s"))
    met = _met(_points(points, point_id, x, y), places.select("tx", "ty", F.col("s.id").alias("low"), F.col("s.id").alias("high")), within, False)
    each = F.transform("targets", lambda t: F.struct(distance(F.col("px"), F.col("py"), t["tx"], t["ty"]).alias("distance"), t["low"].alias("target")))
    best = met.select("id", F.array_min(each).alias("b")).where(F.col("b.distance") <= within).groupBy("id").agg(F.min("b").alias("b"))
    return best.select(F.col("id").alias(point_id), F.col("b.target").alias(target_id), F.col("b.distance").alias("distance"))


def spacing(points: DataFrame, point_id: str, x: str, y: str, within: float) -> DataFrame:
    """(id, gap): each point's distance to its nearest point of another id within a distance."""
    points = _points(points.where(F.col(point_id).isNotNull()), point_id, x, y)
    places = points.groupBy(F.col("px").alias("tx"), F.col("py").alias("ty")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    other = F.filter("targets", lambda t: (t["low"] != F.col("id")) | (t["high"] != F.col("id")))
    gap = F.array_min(F.transform(other, lambda t: distance(F.col("px"), F.col("py"), t["tx"], t["ty"])))
    found = _met(points, places, within, True).select("id", gap.alias("gap")).where(F.col("gap") <= within).groupBy("id").agg(F.min("gap").alias("gap"))
    return found.withColumnRenamed("id", point_id)
