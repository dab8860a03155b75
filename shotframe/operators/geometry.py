"""Trace headers against a survey's stations: check and load, as a cascade of joins in which only unmatched rows go on.

Tables: ``traces`` (trace, ffid, source_point, source_x, source_y, receiver_x, receiver_y, coordinate_scalar), places as in the headers;
``stations`` (line, point, x, y, elevation), one frame of sources and one of receivers. Places are matched by cells of WIDTH tolerances,
a query in those that the tolerance reaches (mostly one), so that every join is by equality; equal places are looked up once, however
many traces share them. Traces are written once and read from there, as are shots and places, so that no step computes another's rows again. A place counts as given if it is finite and not (0, 0). Of stations at the same distance the one of smaller line and point is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotframe.functions import scalars
from shotframe.shared import written

TOLERANCE, COLLAPSED_WITHIN, COLLAPSED_SHARE = 2.0, 1.0, 0.9
#: Tolerances in a cell's width.
WIDTH = 4
#: Trace sorting codes of stacked data.
STACKED = (4, 8, 9)


def _given(x: Column, y: Column) -> Column:
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return number(x) & number(y) & ((x != 0) | (y != 0))


def placed(traces: DataFrame) -> DataFrame:
    """traces with sx, sy, rx, ry in metres, null where a place isn't given."""
    real = {n: scalars.apply_scalar(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.coalesce("coordinate_scalar", F.lit(0))) for n, c in (("sx", "source_x"), ("sy", "source_y"), ("rx", "receiver_x"), ("ry", "receiver_y"))}
    out = traces.withColumns(real)
    out = out.withColumns({"source_given": _given(F.col("sx"), F.col("sy")), "receiver_given": _given(F.col("rx"), F.col("ry"))})
    return out.withColumns({n: F.when(F.col("source_given" if n[0] == "s" else "receiver_given"), F.col(n)) for n in real})


def inventory(rows: DataFrame, sorting: int = 0) -> DataFrame:
    """Of placed rows one row: n, shares of traces with places, scalars, and whether the data looks stacked."""
    both = F.col("source_given") & F.col("receiver_given")
    same = both & (F.abs(F.col("sx") - F.col("rx")) <= COLLAPSED_WITHIN) & (F.abs(F.col("sy") - F.col("ry")) <= COLLAPSED_WITHIN)
    # A scalar is a two-byte word, so their set is bounded.
    out = rows.agg(
        F.count("*").alias("n"), F.count_if("source_given").alias("with_source"), F.count_if("receiver_given").alias("with_receiver"), F.count_if(both).alias("both"), F.count_if(same).alias("same"),
        F.sort_array(F.collect_set(F.col("coordinate_scalar").cast("int"))).alias("scalars"))
    share = lambda c: F.when(F.col("n") > 0, scalars.half_up(F.col(c) * 100.0 / F.col("n"), 2)).otherwise(0.0)
    collapsed = (F.col("both") > 0) & (F.col("same") >= COLLAPSED_SHARE * F.col("both"))
    state = F.when(F.lit(sorting in STACKED) | collapsed, "poststack").when(F.lit(sorting != 0) | (F.col("both") > 0), "prestack").otherwise("unknown")
    return out.select("n", share("with_source").alias("source_percent"), share("with_receiver").alias("receiver_percent"), "scalars", F.size(F.filter("scalars", lambda s: s != 0)).alias("n_scalars"), state.alias("state"))


def _distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def nearest(places: DataFrame, stations: DataFrame, tolerance: float) -> DataFrame:
    """(x, y, dist, line, point) of the distinct places that have a station within the tolerance: the nearest one."""
    cell = WIDTH * max(tolerance, 1e-6)
    of = lambda c: F.floor(c / cell).cast("long")
    reach = lambda c: tolerance + F.abs(c) * 1e-12
    reached = lambda c: F.explode(F.array_distinct(F.array(of(F.col(c) - reach(F.col(c))), of(F.col(c) + reach(F.col(c))))))
    queries = places.select("x", "y").distinct().withColumn("cx", reached("x")).withColumn("cy", reached("y"))
    known = stations.where(_given(F.col("x"), F.col("y")) | ((F.col("x") == 0) & (F.col("y") == 0))).select("line", "point", F.col("x").alias("px"), F.col("y").alias("py"), of(F.col("x")).alias("cx"), of(F.col("y")).alias("cy"))
    pairs = queries.join(known, ["cx", "cy"]).withColumn("dist", _distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))).where(F.col("dist") <= tolerance)
    best = pairs.groupBy("x", "y").agg(F.min(F.struct("dist", "line", "point")).alias("b"))
    return best.select("x", "y", "b.dist", "b.line", "b.point")


def _shots(rows: DataFrame) -> DataFrame:
    """(ffid, source_point, sx, sy): each shot's first trace that has a source place."""
    first = F.min_by(F.struct("source_point", "sx", "sy"), "trace")
    return rows.where("source_given").groupBy("ffid").agg(first.alias("s")).select("ffid", "s.source_point", "s.sx", "s.sy")


def match_sources(rows: DataFrame, sources: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(ffid, outcome, line, point, dist) of each shot of placed rows.

    A shot whose point the survey numbers is held against the nearest station of that number: matched, swapped (east and north
    exchanged) or off. Any other is looked up by place: numbering (found, so only its number differs), swapped or off."""
    shots = written(_shots(rows), "shots")
    known = sources.select(F.col("point").alias("source_point"), "line", "x", "y").where("source_point IS NOT NULL")
    pairs = shots.join(known, "source_point")
    straight, crossed = _distance(F.col("sx"), F.col("sy"), F.col("x"), F.col("y")), _distance(F.col("sx"), F.col("sy"), F.col("y"), F.col("x"))
    by_number = pairs.groupBy("ffid", "source_point").agg(F.min(F.struct(straight.alias("dist"), "line")).alias("b"), F.min(crossed).alias("crossed"))
    outcome = F.when(F.col("b.dist") <= tolerance, "matched").when(F.col("crossed") <= tolerance, "swapped").otherwise("off")
    numbered = by_number.select("ffid", outcome.alias("outcome"), "b.line", F.col("source_point").alias("point"), "b.dist")
    rest = written(shots.join(known.select("source_point").distinct(), "source_point", "left_anti"), "unnumbered")
    found = nearest(rest.select(F.col("sx").alias("x"), F.col("sy").alias("y")), sources, tolerance)
    placed_ = written(rest.join(found.withColumnsRenamed({"x": "sx", "y": "sy"}), ["sx", "sy"], "left"), "by-place")
    by_place = placed_.where("dist IS NOT NULL").select("ffid", F.lit("numbering").alias("outcome"), "line", "point", "dist")
    left = placed_.where("dist IS NULL").select("ffid", "sx", "sy")
    turned = nearest(left.select(F.col("sy").alias("x"), F.col("sx").alias("y")), sources, tolerance).select(F.col("y").alias("sx"), F.col("x").alias("sy"), F.lit(True).alias("turned"))
    last = left.join(turned, ["sx", "sy"], "left").select("ffid", F.when(F.col("turned"), "swapped").otherwise("off").alias("outcome"), F.lit(None).cast(dict(sources.dtypes)["line"]).alias("line"), F.lit(None).cast(dict(sources.dtypes)["point"]).alias("point"), F.lit(None).cast("double").alias("dist"))
    return numbered.unionByName(by_place).unionByName(last)


def match_receivers(rows: DataFrame, receivers: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(x, y, n, dist, line, point): the distinct receiver places of placed rows, how many traces have them, and their station if there is one."""
    places = written(rows.where("receiver_given").groupBy(F.col("rx").alias("x"), F.col("ry").alias("y")).agg(F.count("*").alias("n")), "receiver-places")
    return places.join(nearest(places, receivers, tolerance), ["x", "y"], "left")


def check(traces: DataFrame, sources: DataFrame, receivers: DataFrame, tolerance: float = TOLERANCE, sorting: int = 0) -> DataFrame:
    """(category, severity, n): the findings that occur. Sides with places on under 1 % of the traces are told of and not checked."""
    rows = written(placed(traces).select("trace", "ffid", "source_point", "coordinate_scalar", "sx", "sy", "rx", "ry", "source_given", "receiver_given"), "placed")
    seen = written(inventory(rows, sorting), "inventory")
    one = seen.first()  # one row of sums
    out = [
        ("Coverage", "info", seen.where("n = 0").select(F.lit(0).cast("long").alias("n"))),
        ("StackState", "warn", seen.where("state = 'poststack' AND n > 0").select(F.lit(1).cast("long").alias("n"))),
        ("Scalar", "warn", seen.where("n_scalars > 1").select(F.col("n_scalars").cast("long").alias("n")))]
    for side, percent, stations in (("source", one["source_percent"], sources), ("receiver", one["receiver_percent"], receivers)):
        if not one["n"]:
            continue
        if percent < 1:
            out.append((f"{side.capitalize()}Coverage", "info", rows.agg(F.count_if(f"{side}_given").alias("n"))))
        elif side == "source":
            count = written(match_sources(rows, stations, tolerance).groupBy("outcome").agg(F.count("*").alias("n")), "outcomes")
            out += [(name, severity, count.where(F.col("outcome") == o).select("n")) for o, name, severity in (("swapped", "SourceSwap", "error"), ("off", "SourcePos", "error"), ("numbering", "SourceNumbering", "info"))]
        else:
            found = written(match_receivers(rows, stations, tolerance), "receivers")
            out.append(("ReceiverPos", "error", found.where("dist IS NULL").agg(F.sum("n").alias("n"))))
            used = found.where("dist IS NOT NULL").select("line", "point").distinct()
            out.append(("MissingStation", "warn", stations.join(used, [stations["line"].eqNullSafe(used["line"]), stations["point"].eqNullSafe(used["point"])], "left_anti").agg(F.count("*").alias("n"))))
    whole = None
    for name, severity, n in out:
        part = n.select(F.lit(name).alias("category"), F.lit(severity).alias("severity"), F.col("n").cast("long").alias("n"))
        whole = part if whole is None else whole.unionByName(part)
    return whole.where("n > 0 OR category = 'Coverage' OR category LIKE '%Coverage'")


def load(traces: DataFrame, sources: DataFrame, receivers: DataFrame, tolerance: float = TOLERANCE, scalar: int = -100) -> DataFrame:
    """traces with header words of their stations: places, elevations, offset, midpoint and the scalars; unmatched sides keep what they had.

    A shot's source is that of its first trace: by its number if it has no place or the station of that number is within the
    tolerance, else by place. The scalar is weakened until the largest coordinate fits 32 bits."""
    rows = written(placed(traces), "placed")
    most = sources.select("x", "y", "elevation").unionByName(receivers.select("x", "y", "elevation")).agg(F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("elevation"))).alias("m")).first()["m"]
    fitted = sources.sparkSession.range(1).select(scalars.fit_scalar(F.lit(most).cast("double"), scalar).alias("s")).first()["s"]
    first = written(rows.groupBy("ffid").agg(F.min_by(F.struct("source_point", "sx", "sy"), "trace").alias("s")).select("ffid", "s.source_point", "s.sx", "s.sy"), "shots")
    station = F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.col("elevation").alias("z"))
    known = sources.where("point IS NOT NULL").select(F.col("point").alias("source_point"), "line", station.alias("at"))
    dist = F.when(F.col("sx").isNull(), F.lit(0.0)).otherwise(_distance(F.col("sx"), F.col("sy"), F.col("at.x"), F.col("at.y")))
    numbered = written(first.join(known, "source_point").withColumn("dist", dist).where(F.col("dist") <= tolerance).groupBy("ffid").agg(F.min(F.struct("dist", "line", "at")).alias("b")).select("ffid", F.col("b.at").alias("source")), "numbered")
    rest = written(first.where("sx IS NOT NULL").join(numbered, "ffid", "left_anti"), "unnumbered")
    at = lambda stations, name: stations.select("line", "point", station.alias(name)).dropDuplicates(["line", "point"])
    by_place = nearest(rest.select(F.col("sx").alias("x"), F.col("sy").alias("y")), sources, tolerance).join(at(sources, "source"), ["line", "point"]).select(F.col("x").alias("sx"), F.col("y").alias("sy"), "source")
    shots = numbered.unionByName(rest.join(by_place, ["sx", "sy"]).select("ffid", "source"))
    places = rows.where("receiver_given").select(F.col("rx").alias("x"), F.col("ry").alias("y"))
    stood = nearest(places, receivers, tolerance).join(at(receivers, "receiver"), ["line", "point"]).select(F.col("x").alias("rx"), F.col("y").alias("ry"), "receiver")
    out = rows.join(shots, "ffid", "left").join(stood, ["rx", "ry"], "left")
    code = lambda v: scalars.encode_scalar(v, F.lit(fitted))
    s, r = F.col("source"), F.col("receiver")
    both = s.isNotNull() & r.isNotNull()
    words = {
        "source_x": F.coalesce(code(s["x"]), F.col("source_x")), "source_y": F.coalesce(code(s["y"]), F.col("source_y")), "receiver_x": F.coalesce(code(r["x"]), F.col("receiver_x")), "receiver_y": F.coalesce(code(r["y"]), F.col("receiver_y")),
        "source_elevation": code(s["z"]), "receiver_elevation": code(r["z"]), "offset": F.when(both, scalars.encode_scalar(_distance(s["x"], s["y"], r["x"], r["y"]), F.lit(1))),
        "midpoint_x": F.when(both, code((s["x"] + r["x"]) / 2)), "midpoint_y": F.when(both, code((s["y"] + r["y"]) / 2)),
        "coordinate_scalar": F.when(s.isNotNull() | r.isNotNull(), F.lit(fitted)).otherwise(F.col("coordinate_scalar")), "elevation_scalar": F.when(s["z"].isNotNull() | r["z"].isNotNull(), F.lit(fitted))}
    return out.withColumns(words).drop("sx", "sy", "rx", "ry", "source_given", "receiver_given", "source", "receiver")
