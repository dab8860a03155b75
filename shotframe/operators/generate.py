"""Generators: preplot surveys and vibrator sweeps, as ranges that Spark expands."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def preplot(spark: SparkSession, lines: int, points: int, line_gap: float, point_gap: float, east: float = 500000.0, north: float = 4000000.0, bearing: float = 90.0) -> DataFrame:
    """(line, point, easting, northing) of a regular grid, lines across the bearing."""
    along, across = math.radians(bearing), math.radians(bearing + 90)
    i, j = F.floor(F.col("id") / points), F.col("id") % points
    x = east + j * (point_gap * math.sin(along)) + i * (line_gap * math.sin(across))
    y = north + j * (point_gap * math.cos(along)) + i * (line_gap * math.cos(across))
    return spark.range(lines * points).select((i + 1).alias("line"), (j + 1).alias("point"), x.alias("easting"), y.alias("northing"))


def sweep(spark: SparkSession, f0: float, f1: float, seconds: float, interval_us: int, taper_s: float = 0.25) -> DataFrame:
    """(i, t, frequency, amplitude) of a linear sweep with cosine tapers."""
    n = int(round(seconds * 1e6 / interval_us)) + 1
    t = F.col("id") * (interval_us * 1e-6)
    phase = 2 * math.pi * (f0 * t + (f1 - f0) / (2 * seconds) * t * t)
    edge = F.least(t, seconds - t)
    taper = F.when(edge < taper_s, 0.5 - 0.5 * F.cos(math.pi * edge / taper_s)).otherwise(1.0)
    return spark.range(n).select(F.col("id").alias("i"), t.alias("t"), (f0 + (f1 - f0) / seconds * t).alias("frequency"), (taper * F.sin(phase)).alias("amplitude"))
