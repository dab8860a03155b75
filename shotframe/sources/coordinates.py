"""Coordinate tables as text: CSV with any of the usual headings, and plans; native parsing of Spark's own CSV reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotframe.operators.text import number

# Headings that mean the same.
SYNONYMS = {
    "line": {"line", "line_name", "linename", "ln"}, "point": {"point", "station", "stn", "sp", "shotpoint", "peg"}, "easting": {"easting", "east", "e", "x"}, "northing": {"northing", "north", "n", "y"},
    "elevation": {"elevation", "elev", "z", "height"}, "lat": {"lat", "latitude"}, "lon": {"lon", "long", "longitude"}}


def read_coordinates(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(line, point, easting, northing, elevation, lat, lon) of files with a heading; missing columns are null.

    Headings decide the columns, so that they may stand in any order; lines that begin with # are comments."""
    raw = spark.read.option("header", True).option("sep", delimiter).option("comment", "#").option("mode", "PERMISSIVE").csv(path)
    found = {}
    for c in raw.columns:
        name = next((k for k, v in SYNONYMS.items() if c.strip().lower() in v), None)
        if name and name not in found:
            found[name] = F.col(f"`{c}`")
    return raw.select(*[(found[k] if k == "line" else number(found[k])).alias(k) if k in found else F.lit(None).cast("string" if k == "line" else "double").alias(k) for k in SYNONYMS])


def write_coordinates(rows: DataFrame, path: str, delimiter: str = ",") -> None:
    rows.write.option("header", True).option("sep", delimiter).csv(path)
