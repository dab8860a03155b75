"""Summaries and picks that reports need: boxes, lengths, leaders, samples, coverage, manifest records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounding_box(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.min(x).alias("x_low"), F.max(x).alias("x_high"), F.min(y).alias("y_low"), F.max(y).alias("y_high"), F.count(F.lit(1)).alias("n"))


def arc_length(points: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """(key, length): the sum of the steps from each point to the next of its line."""
    w = Window.partitionBy(key).orderBy(order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return points.select(key, F.sqrt(dx * dx + dy * dy).alias("step")).groupBy(key).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"))


def leaders(findings: DataFrame, group: str, name: str, k: int) -> DataFrame:
    """(group, name, n, place): the k most frequent names of each group; counted before they are ranked."""
    counts = findings.groupBy(group, name).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), name))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def stride_sample(rows: DataFrame, key: str, order: str, stride: int) -> DataFrame:
    """Every stride-th row of each key, from the first."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("place", place).where(F.col("place") % stride == 0)


def block_sample(rows: DataFrame, key: str, order: str, block: int, take: int) -> DataFrame:
    """The first ``take`` rows of every block of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("place", place).where(F.col("place") % block < take)


def coverage(rows: DataFrame, matched: Column, *keys: str) -> DataFrame:
    """(keys, n, matched, percent)"""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(matched).alias("matched"))
    return out.withColumn("percent", F.col("matched") * 100.0 / F.col("n"))


def value_inventory(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): how often each value occurs."""
    return rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))


def shared_names(stations: DataFrame, line: str, station: str) -> DataFrame:
    """(station, lines): stations that several lines use."""
    return stations.groupBy(station).agg(F.countDistinct(line).alias("lines")).where("lines > 1")


def first_seen(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The values of each key's first row; keys are reduced before the shuffle."""
    first = F.min_by(F.struct(*values), order)
    return rows.groupBy(key).agg(first.alias("f")).select(key, *[F.col(f"f.{v}").alias(v) for v in values])


def first_too_far(relations: DataFrame, sources: DataFrame, receivers: DataFrame, limit: float) -> DataFrame:
    """Of each relation the first of its receivers, by point from low to high, that is further from its source than the limit.

    relations (id, source_line, source_point, receiver_line, low, high, step), sources and receivers (line, point, x, y). Ranges are
    joined with the receivers of their line that they hold, by blocks of points, so that a range isn't written out point by point and
    a line's receivers aren't all compared with all of its ranges; steps of less than 1 count as 1."""
    step = F.greatest(F.coalesce(F.col("step"), F.lit(1)), F.lit(1))
    block = lambda c: F.floor(F.col(c) / RANGE_BLOCK)
    shots = relations.withColumn("step", step).join(sources.select(F.col("line").alias("source_line"), F.col("point").alias("source_point"), F.col("x").alias("sx"), F.col("y").alias("sy")), ["source_line", "source_point"])
    held = shots.where("high >= low").withColumn("block", F.explode(F.sequence(block("low"), block("high"))))
    stations = receivers.select(F.col("line").alias("receiver_line"), F.col("point").alias("receiver"), F.col("x").alias("rx"), F.col("y").alias("ry")).withColumn("block", block("receiver"))
    dx, dy = F.col("sx") - F.col("rx"), F.col("sy") - F.col("ry")
    pairs = held.join(stations, ["receiver_line", "block"]).where("receiver BETWEEN low AND high AND (receiver - low) % step = 0").withColumn("offset", F.sqrt(dx * dx + dy * dy))
    worst = pairs.where(F.col("offset") > limit).groupBy("id").agg(F.min(F.struct("receiver", "offset")).alias("w"))
    return worst.select("id", "w.receiver", "w.offset")


#: Points of a block when ranges are joined with stations.
RANGE_BLOCK = 64


def without_tombstone(tombstones: DataFrame, landed: DataFrame, path: str) -> DataFrame:
    """Tombstones but those of files that have landed again."""
    return tombstones.join(landed.select(path).distinct(), path, "left_anti")


def tombstone_records(tombstones: DataFrame, path: str, time: str) -> DataFrame:
    """Tombstones as manifest records: no bytes, deleted."""
    return tombstones.select(path, F.col(time).alias("mtime"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("deleted"))


def record_tombstones(records: DataFrame, path: str) -> DataFrame:
    return records.where("deleted").select(path, "mtime")


#: The longest field name of a dBASE table, and the most fields that it may have.
DBF_NAME, DBF_FIELDS = 10, 255


def dbf_base(name: Column) -> Column:
    """A name of capital letters, digits and underscores, at most ten, that doesn't begin with a digit."""
    plain = F.substring(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9_]", "_"), 1, DBF_NAME)
    named = F.when(plain == "", F.lit("FIELD")).otherwise(plain)
    return F.when(named.rlike("^[0-9]"), F.substring(F.concat(F.lit("F"), named), 1, DBF_NAME)).otherwise(named)


def dbf_names(columns: DataFrame, table: str, name: str, order: str) -> DataFrame:
    """columns with ``safe``, a name that no other field of its table has: later ones take the first free number from 2 on.

    A table's fields (dBASE knows DBF_FIELDS at most) are folded in one group."""

    def fold(names: Column) -> Column:
        def free(state: Column, base: Column) -> Column:
            numbered = F.transform(F.sequence(F.lit(2), F.lit(999)), lambda i: F.concat(F.left(base, F.lit(DBF_NAME) - F.length(i.cast("string"))), i.cast("string")))
            found = F.element_at(F.filter(F.concat(F.array(base), numbered), lambda x: ~F.array_contains(state, x)), 1)
            return F.concat(state, F.array(F.when(F.array_contains(state, base), found).otherwise(base)))

        return F.aggregate(names, F.array().cast("array<string>"), free)

    c = columns.withColumn("base", dbf_base(F.col(name)))
    tables = c.groupBy(table).agg(F.sort_array(F.collect_list(F.struct(order, "base"))).alias("fields"))
    placed = tables.select(table, F.explode(F.arrays_zip(F.col("fields"), fold(F.transform("fields", lambda f: f["base"])).alias("safe"))).alias("f"))
    return placed.select(table, F.col(f"f.fields.{order}").alias(order), F.col("f.fields.base").alias("base"), F.col("f.safe").alias("safe"))
