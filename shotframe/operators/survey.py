"""Survey quality control, joins and set operations over stations (line, point, ...) and shot-receiver relations.

Ties are always broken by an explicit order column; every operator is DataFrame(s) -> DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import nearby


def duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows after the first of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("nth", nth).where("nth > 1")


def steps(rows: DataFrame, line: str, order: list[str], value: str) -> DataFrame:
    """Adds ``step``: the value less that of the row before on the line."""
    return rows.withColumn("step", F.col(value) - F.lag(value).over(Window.partitionBy(line).orderBy(*order)))


def gaps(rows: DataFrame, line: str, order: list[str], value: str, most: float) -> DataFrame:
    return steps(rows, line, order, value).where(F.abs("step") > most)


def interval_findings(rows: DataFrame, line: str, order: list[str], value: str, interval: float, tolerance: float) -> DataFrame:
    return steps(rows, line, order, value).where(F.abs(F.abs("step") - interval) > tolerance)


def distance_steps(rows: DataFrame, line: str, order: list[str], x: str, y: str) -> DataFrame:
    """Adds ``distance`` to the row before on the line."""
    w = Window.partitionBy(line).orderBy(*order)
    return rows.withColumn("distance", F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), F.lit(2.0)) + F.pow(F.col(y) - F.lag(y).over(w), F.lit(2.0))))


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose key has no row in right."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def range_check(relations: DataFrame, stations: DataFrame, line: str, to_line: str, low: str, high: str, point: str) -> DataFrame:
    """Relations whose first point is below the least of its line, or whose last is above the greatest of to_line (null: line).

    stations carry ``line`` and ``point``; a line without stations gives no finding. Each end is held against its own line."""
    ends = stations.groupBy(line).agg(F.min(point).alias("line_low"), F.max(point).alias("line_high"))
    first, last = ends.select(line, "line_low"), ends.select(F.col(line).alias("__end"), "line_high")
    rows = relations.withColumn("__end", F.coalesce(to_line, line)).join(first, line, "left").join(last, "__end", "left").drop("__end")
    return rows.where((F.col(low) < F.col("line_low")) | (F.col(high) > F.col("line_high")))


def collapse(findings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Equal findings become the first, with their number."""
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first"))


def expand(relations: DataFrame, low: str, high: str, step: Column, out: str = "point") -> DataFrame:
    """A row for each receiver of a relation's range; a step under 1 counts as 1."""
    return relations.withColumn(out, F.explode(F.sequence(F.col(low), F.greatest(F.col(low), F.col(high)), F.greatest(step, F.lit(1)))))


def midpoints(relations: DataFrame, sources: DataFrame, receivers: DataFrame, source_key: list[str], receiver_key: list[str]) -> DataFrame:
    """relations joined with sources (sx, sy) and receivers (rx, ry): adds mx, my."""
    rows = relations.join(sources, source_key).join(receivers, receiver_key)
    return rows.withColumns({"mx": (F.col("sx") + F.col("rx")) / 2, "my": (F.col("sy") + F.col("ry")) / 2})


def fold(points: DataFrame, x: str, y: str, bin_x: float, bin_y: float) -> DataFrame:
    """(ix, iy, fold) on a grid that starts at the smallest coordinates; those are one row, broadcast."""
    origin = points.agg(F.min(x).alias("x0"), F.min(y).alias("y0"))
    placed = points.select(x, y).crossJoin(F.broadcast(origin))
    ix, iy = F.floor((F.col(x) - F.col("x0")) / bin_x), F.floor((F.col(y) - F.col("y0")) / bin_y)
    return placed.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("fold"))


def skid(laid: DataFrame, plan: DataFrame, keys: list[str], x: str, y: str, order: str, tolerance: float) -> DataFrame:
    """One row for each key of either side: status (matched, added, missing), distance, over.

    Of the plan's duplicates the first counts, of the laid ones the worst distance."""
    first = plan.groupBy(*keys).agg(F.min(F.struct(order, x, y)).alias("p")).select(*keys, F.col(f"p.{x}").alias("px"), F.col(f"p.{y}").alias("py"), F.lit(True).alias("planned"))
    both = laid.select(*keys, x, y, F.lit(True).alias("laid")).join(first, keys, "full_outer")
    distance = F.sqrt(F.pow(F.col(x) - F.col("px"), F.lit(2.0)) + F.pow(F.col(y) - F.col("py"), F.lit(2.0)))
    out = both.groupBy(*keys).agg(F.max(distance).alias("distance"), F.max("laid").alias("laid"), F.max("planned").alias("planned"))
    status = F.when(F.col("laid") & F.col("planned"), "matched").when(F.col("laid"), "added").otherwise("missing")
    return out.select(*keys, status.alias("status"), "distance", F.coalesce(F.col("distance") > tolerance, F.lit(False)).alias("over"))


def skid_summary(rows: DataFrame) -> DataFrame:
    """Counts by status, and of distances the number over, largest, mean and nearest-rank 95th percentile."""
    return rows.agg(
        F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "missing").alias("missing"),
        F.count_if("over").alias("over"), F.max("distance").alias("largest"), F.avg("distance").alias("mean"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY distance)").alias("p95"))


def nearest(points: DataFrame, targets: DataFrame, point_id: str, target_id: str, x: str, y: str, within: float) -> DataFrame:
    """(point, target, distance): the nearest target within a distance, the smaller id of equals."""
    return nearby.nearest(points, targets, point_id, target_id, x, y, within)


def merge_distinct(first: DataFrame, second: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The union, of each key the first side's first row."""
    both = first.withColumn("__side", F.lit(0)).unionByName(second.withColumn("__side", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("__side", order))
    return both.withColumn("__n", nth).where("__n = 1").drop("__n", "__side")


def renumber_lines(rows: DataFrame, line: str, start: int, step: int) -> DataFrame:
    """(line, new_line): the distinct lines in order, numbered from start. They are few; the numbers need one task."""
    return rows.select(line).distinct().withColumn("new_line", F.lit(start) + (F.dense_rank().over(Window.orderBy(line)) - 1) * step)


def renumber_points(rows: DataFrame, line: str, order: list[str], start: int, step: int) -> DataFrame:
    return rows.withColumn("new_point", F.lit(start) + (F.row_number().over(Window.partitionBy(line).orderBy(*order)) - 1) * step)


def nearest_channel(traces: DataFrame, gather: str, value: str, target: float, order: list[str]) -> DataFrame:
    """Of each gather the trace whose value is nearest to the target, the first of equals."""
    keys = F.struct(F.abs(F.col(value) - target).alias("d"), *[F.col(c) for c in order])
    return traces.groupBy(gather).agg(F.min(keys).alias("b")).select(gather, *[F.col(f"b.{c}").alias(c) for c in order], F.col("b.d").alias("off"))


def spacing(rows: DataFrame, line: str, value: str) -> DataFrame:
    """(line, value, gap): the distance of each distinct value to its nearest distinct neighbour."""
    w = Window.partitionBy(line).orderBy(value)
    each = rows.select(line, value).where(F.col(value).isNotNull()).distinct()
    return each.select(line, value, F.least(F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value)).alias("gap"))


def line_statistics(rows: DataFrame, line: str, order: list[str], value: str) -> DataFrame:
    """(line, points, length, smallest, median, largest step)"""
    s = steps(rows, line, order, value).withColumn("step", F.abs("step"))
    return s.groupBy(line).agg(F.count(F.lit(1)).alias("points"), F.sum("step").alias("length"), F.min("step").alias("smallest"), F.expr("percentile(step, 0.5)").alias("median"), F.max("step").alias("largest"))


def first_descents(rows: DataFrame, line: str, order: list[str], value: str) -> DataFrame:
    """Of each line the first row whose value is below the last known one before it."""
    w = Window.partitionBy(line).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    down = rows.withColumn("before", before).where(F.col(value) < F.col("before"))
    return down.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def local_median(rows: DataFrame, line: str, order: list[str], value: str, half: int) -> DataFrame:
    """Adds the median and the median deviation of the neighbours within half, without the row itself and nulls, and their number."""
    w = Window.partitionBy(line).orderBy(*order)
    near = F.collect_list(F.struct(F.col("__i"), F.col(value).alias("v"))).over(w.rowsBetween(-half, half))
    rows = rows.withColumn("__i", F.row_number().over(w)).withColumn("__near", near)
    rows = rows.withColumn("__near", F.sort_array(F.transform(F.filter("__near", lambda e: (e["__i"] != F.col("__i")) & e["v"].isNotNull()), lambda e: e["v"])))
    rows = rows.withColumns({"local_median": middle(F.col("__near")), "local_n": F.size("__near")})
    rows = rows.withColumn("local_mad", middle(F.sort_array(F.transform("__near", lambda v: F.abs(v - F.col("local_median"))))))
    return rows.drop("__i", "__near")


def middle(ranked: Column) -> Column:
    """The median of a sorted array: the mean of the middle two."""
    n = F.size(ranked)
    low, high = F.floor((n - 1) / 2).cast("int") + 1, F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.try_element_at(ranked, low) + F.try_element_at(ranked, high)) / 2)


def robust_z(rows: DataFrame, value: str, group: str, *groups: str) -> DataFrame:
    """Adds z = (x - median) / (1.4826 MAD), 0 where the MAD is 0. Two grouped passes, joined back; no global window.

    Exact medians are kept by group (a record, a line), never over all rows, where one task would hold every value."""
    groups = (group, *groups)
    centre = rows.groupBy(*groups).agg(F.expr(f"percentile(`{value}`, 0.5)").alias("centre"))
    at = rows.join(centre, list(groups))
    spread = at.withColumn("__d", F.abs(F.col(value) - F.col("centre"))).groupBy(*groups).agg(F.expr("percentile(__d, 0.5)").alias("mad"))
    at = at.join(spread, list(groups))
    return at.withColumn("z", F.when(F.col("mad") > 0, (F.col(value) - F.col("centre")) / (1.4826 * F.col("mad"))).otherwise(0.0))


# The kinds of plan findings by severity.
PLAN_FINDINGS = {"short-line": "error", "coincident": "error", "dup-station": "error", "no-station": "error", "outlier": "warn", "interval": "warn", "monotonic": "warn", "elevation": "warn", "dup-station-cross": "info"}


def check_plan(points: DataFrame, line: str, order: str, x: str, y: str, station: str, elevation: str, percent: float = 15.0, same: float = 0.5, factor: float = 10.0, preplot: bool = False) -> DataFrame:
    """(line, pos, category, severity, n) of a plan's points in their order: every finding at its point, those of a whole line at its first.

    Steps to the point before: within ``same`` coincident, over ``factor`` medians of the line outlier, off the median by over
    ``percent`` interval (one of the three). dup-station is a number seen earlier on the line, monotonic a line's first fall
    below the last known number, elevation outside -500 to 9000. Lines of one point are short; a preplot's points without a
    number are counted. The numbers that several lines share come as one row of info without a line. Null coordinates
    give no step; null numbers are skipped. A line must fit a task; ties of the order are broken by the coordinates."""
    w = Window.partitionBy(line).orderBy(order, x, y, station, elevation)
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(line)
    number, height, step = F.col(station).cast("double"), F.col(elevation), F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), F.lit(2.0)) + F.pow(F.col(y) - F.lag(y).over(w), F.lit(2.0)))
    number = F.when(~F.isnan(number), number)
    rows = points.select(
        F.col(line).alias("line"), F.col(order).alias("pos"), F.when(~F.isnan(step), step).alias("step"), number.alias("number"), height.alias("height"), F.row_number().over(w).alias("place"),
        F.last(number, ignorenulls=True).over(before).alias("known"), F.row_number().over(Window.partitionBy(line, station).orderBy(order, x, y, elevation)).alias("seen"), F.count(F.lit(1)).over(whole).alias("size"))
    rows = rows.withColumns({"falls": F.coalesce(F.col("number") < F.col("known"), F.lit(False)), "middle": F.percentile("step", F.lit(0.5)).over(Window.partitionBy("line"))})
    rows = rows.withColumns({
        "fallen": F.count_if("falls").over(Window.partitionBy("line").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "bare": F.count_if(F.col("number").isNull()).over(Window.partitionBy("line"))})
    off = F.when(F.col("step") <= same, "coincident").when(F.col("middle") > 0, F.when(F.col("step") > factor * F.col("middle"), "outlier").when(F.abs(F.col("step") - F.col("middle")) > percent / 100 * F.col("middle"), "interval"))
    one = lambda test, name, n=F.lit(1): F.when(test, F.struct(F.lit(name).alias("category"), n.cast("long").alias("n")))
    found = F.array_compact(F.array(
        F.when(off.isNotNull(), F.struct(off.alias("category"), F.lit(1).cast("long").alias("n"))), one(F.col("number").isNotNull() & (F.col("seen") > 1), "dup-station"),
        one(F.col("falls") & (F.col("fallen") == 1), "monotonic"), one((F.col("height") < -500) | (F.col("height") > 9000), "elevation"), one(F.col("size") < 2, "short-line"),
        one(F.lit(preplot) & (F.col("place") == 1) & (F.col("bare") > 0), "no-station", F.col("bare"))))
    each = rows.select("line", "pos", F.explode(found).alias("f")).select("line", "pos", "f.category", "f.n")
    shared = points.select(number.alias("number"), line).where("number IS NOT NULL").groupBy("number").agg((F.min(line) < F.max(line)).alias("several")).agg(F.count_if("several").alias("n")).where("n > 0")
    none = {f.name: f.dataType for f in each.schema.fields}
    shared = shared.select(F.lit(None).cast(none["line"]).alias("line"), F.lit(None).cast(none["pos"]).alias("pos"), F.lit("dup-station-cross").alias("category"), "n")
    severity = F.create_map(*[F.lit(v) for pair in PLAN_FINDINGS.items() for v in pair])
    return each.unionByName(shared).withColumn("severity", severity[F.col("category")])
