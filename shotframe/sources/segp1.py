"""SEG-P1 positioning text: fixed columns, packed degrees, decimetre grids; native column expressions both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotframe.operators.text import fixed_width

# 0-based, end-exclusive columns of the public format.
COLUMNS = {"kind": (0, 1), "line": (1, 17), "point": (17, 25), "reshoot": (25, 26), "lat": (26, 35), "lon": (35, 45), "easting": (45, 53), "northing": (53, 61), "elevation": (61, 66)}


def packed_degrees(text: Column, degree_digits: int) -> Column:
    """``DDMMSSss`` with a hemisphere letter as degrees; south and west are negative; null if it doesn't fit."""
    pattern = rf"^([+-]?)(\d{{{degree_digits}}})(\d{{2}})(\d{{2}})\.?(\d*)([NSEWnsew]?)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    seconds = F.concat(part(4), F.lit("."), part(5), F.lit("0")).try_cast("double")
    size = part(2).try_cast("double") + part(3).try_cast("double") / 60 + seconds / 3600
    sign = F.when((part(1) == "-") | F.upper(part(6)).isin("S", "W"), -1.0).otherwise(1.0)
    return F.when(text.rlike(pattern) & (part(3).try_cast("double") < 60) & (seconds < 60), sign * size)


def grid_metres(text: Column) -> Column:
    """A field with a point is in metres, one without in decimetres."""
    return F.when(F.contains(text, F.lit(".")), text.try_cast("double")).otherwise(F.nullif(F.regexp_extract(text, r"^([+-]?\d+)", 1), F.lit("")).try_cast("double") / 10)


def parse(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds the fields of point records to lines; header records and blank lines are left out."""
    points = lines.where(~F.col(raw).rlike(r"^(H|\s*$)"))
    fields = {n: c for n, c in zip(COLUMNS, fixed_width(F.col(raw), COLUMNS), strict=True)}
    out = points.select("*", *fields.values())
    return out.withColumns({
        "point": F.regexp_extract("point", r"^([+-]?\d+)", 1).try_cast("double"), "lat": packed_degrees(F.col("lat"), 2), "lon": packed_degrees(F.col("lon"), 3),
        "easting": grid_metres(F.col("easting")), "northing": grid_metres(F.col("northing")), "elevation": grid_metres(F.col("elevation"))}).drop(raw)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "\r$", "").alias("raw")))


def pack(degrees: Column, degree_digits: int, positive: str, negative: str) -> Column:
    """Degrees as ``DDMMSSss`` and a letter; blanks for null."""
    hundredths = F.floor(F.abs(degrees) * 360000 + 0.5).cast("long")
    text = F.format_string(f"%0{degree_digits}d%02d%04d%s", F.floor(hundredths / 360000), F.floor(hundredths / 6000) % 60, hundredths % 6000, F.when(degrees < 0, negative).otherwise(positive))
    return F.when(degrees.isNotNull(), text).otherwise(" " * (degree_digits + 7))


def point_lines(rows: DataFrame) -> DataFrame:
    """(value): SEG-P1 text of points (kind, line, point, lat, lon, easting, northing, elevation), for ``write.text``."""
    grid = lambda n, w: F.lpad(F.coalesce(F.floor(F.col(n) * 10 + 0.5).cast("string"), F.lit("")), w, " ")
    return rows.select(F.concat(
        F.rpad(F.coalesce("kind", F.lit(" ")), 1, " "), F.rpad(F.coalesce(F.col("line"), F.lit("")), 16, " "), F.lpad(F.coalesce(F.col("point").cast("long").cast("string"), F.lit("")), 8, " "), F.lit(" "),
        pack(F.col("lat"), 2, "N", "S"), pack(F.col("lon"), 3, "E", "W"), grid("easting", 8), grid("northing", 8), grid("elevation", 5)).alias("value"))
