"""Grids over coordinates: counts, interpolation, spacing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import nearby


def counts(points: DataFrame, x: str, y: str, x0: float, y0: float, size: float, nx: int, ny: int) -> DataFrame:
    """(ix, iy, n) of every cell of the grid; 0 is a value. The dense side is made of ranges, not of data."""
    ix, iy = F.floor((F.col(x) - x0) / size).cast("long"), F.floor((F.col(y) - y0) / size).cast("long")
    seen = points.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("n"))
    return cells(points.sparkSession, nx, ny).join(seen, ["ix", "iy"], "left").select("ix", "iy", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cells(spark, nx: int, ny: int) -> DataFrame:
    return spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"))


def band_statistics(band: DataFrame, value: str) -> DataFrame:
    return band.agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count(value).alias("filled"))


def inverse_distance(points: DataFrame, point_id: str, x: str, y: str, value: str, spark_cells: DataFrame, x0: float, y0: float, size: float, radius: float, most: int = 12, power: float = 2.0) -> DataFrame:
    """(ix, iy, value): the weighted mean of the nearest points within the radius; a point at the centre is its value.

    Points and cell centres meet in squares as wide as the radius; of the candidates the nearest ``most`` count."""
    square = lambda c: F.floor(c / radius).cast("long")
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    centre = spark_cells.select("ix", "iy", (x0 + (F.col("ix") + 0.5) * size).alias("cx"), (y0 + (F.col("iy") + 0.5) * size).alias("cy"))
    centre = centre.withColumns({"sx": square(F.col("cx")), "sy": square(F.col("cy"))}).withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    centre = centre.select("ix", "iy", "cx", "cy", (F.col("sx") + F.col("dx")).alias("sx"), (F.col("sy") + F.col("dy")).alias("sy"))
    p = points.select(F.col(point_id).alias("pid"), F.col(x).alias("px"), F.col(y).alias("py"), F.col(value).alias("v"), square(F.col(x)).alias("sx"), square(F.col(y)).alias("sy"))
    d2 = F.pow(F.col("px") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("py") - F.col("cy"), F.lit(2.0))
    rows = centre.join(p, ["sx", "sy"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("ix", "iy").orderBy("d2", "pid"))).where(F.col("nth") <= most)
    w = F.pow(F.sqrt("d2"), F.lit(-power))
    out = rows.groupBy("ix", "iy").agg(F.min(F.when(F.col("d2") < 1e-12, F.struct("pid", "v"))).alias("hit"), (F.sum(F.when(F.col("d2") >= 1e-12, w * F.col("v"))) / F.sum(F.when(F.col("d2") >= 1e-12, w))).alias("mean"))
    return out.select("ix", "iy", F.coalesce("hit.v", "mean").alias("value"))


def nearest_spacing(points: DataFrame, point_id: str, x: str, y: str, within: float) -> DataFrame:
    """(id, gap): each point's distance to its nearest other point within a distance."""
    return nearby.spacing(points, point_id, x, y, within)
