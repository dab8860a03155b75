"""Which format a file has, by name and first bytes; and survey exports as text. Native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats by file ending.
ENDINGS = {"segy": ("sgy", "segy", "seg-y"), "su": ("su",), "segd": ("segd", "sgd"), "seg2": ("sg2", "dat"), "sps": ("sps", "s01", "r01", "x01", "s", "r", "x"), "csv": ("csv", "txt")}


def format_of(path: Column, content: Column) -> Column:
    """The ending decides, then the first bytes; an unknown file of a header's length is taken for SEG-Y."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    found = F.lit(None).cast("string")
    for name, ends in ENDINGS.items():
        found = F.coalesce(found, F.when(ending.isin(*ends), name))
    start = F.substring(content, 1, 4)
    magic = F.when(F.hex(F.substring(content, 1, 2)).isin("553A", "3A55"), "seg2").when(F.hex(F.substring(content, 1, 1)).isin("C3", "43") & (F.octet_length(content) >= 3600), "segy").when(F.decode(start, "ISO-8859-1").rlike(r"^[HSRX][0-9 ]"), "sps")
    return F.coalesce(found, magic, F.when(F.octet_length(content) >= 3600, "segy"))


def detect(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, format) of the files of a path; only columns that the answer needs are kept."""
    return spark.read.format("binaryFile").load(path).select("path", "length", format_of(F.col("path"), F.col("content")).alias("format"))


def geojson_lines(rows: DataFrame, lon: str, lat: str, *properties: str) -> DataFrame:
    """(value): a GeoJSON feature a line, for ``write.text``; points without coordinates have a null geometry."""
    point = F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(F.col(lon).cast("double"), F.col(lat).cast("double")).alias("coordinates")))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, properties) of point features, one a line."""
    kind = "type string, geometry struct<type: string, coordinates: array<double>>, properties map<string, string>"
    rows = spark.read.text(path).select(F.from_json("value", kind).alias("f")).where("f.geometry.type = 'Point'")
    return rows.select(F.try_element_at("f.geometry.coordinates", F.lit(1)).alias("lon"), F.try_element_at("f.geometry.coordinates", F.lit(2)).alias("lat"), F.col("f.properties").alias("properties"))


def kml_placemarks(rows: DataFrame, lon: str, lat: str, name: str) -> DataFrame:
    """(value): a KML placemark a line, with its name escaped."""
    safe = F.col(name).cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return rows.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.format_string("<Placemark><name>%s</name><Point><coordinates>%.8f,%.8f</coordinates></Point></Placemark>", F.coalesce(safe, F.lit("")), F.col(lon).cast("double"), F.col(lat).cast("double")).alias("value"))
