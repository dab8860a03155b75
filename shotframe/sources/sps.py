"""SPS survey text: stations (S, R), relations (X) and headers (H), read and written by native column expressions.

``stations`` and ``relations`` read revision 2.1. ``any_stations`` and ``any_relations`` read files of unknown writers: a line is read
under five layouts at once and the first that gives a place wins; each file's layout is the one that most of its lines have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotframe.operators.text import fixed_width, number

# 0-based, end-exclusive columns of SPS 2.1.
STATION = {"line": (1, 11), "point": (11, 21), "idx": (23, 24), "easting": (46, 55), "northing": (55, 65), "elevation": (65, 71)}
RELATION = {
    "tape": (1, 7), "ffid": (7, 15), "source_line": (17, 27), "source_point": (27, 37), "source_idx": (37, 38), "from_channel": (38, 43), "to_channel": (43, 48), "channel_step": (48, 49),
    "receiver_line": (49, 59), "from_point": (59, 69), "to_point": (69, 79), "receiver_idx": (79, 80)}
# Layouts of places, by order of trial: easting, northing and elevation columns, and what either must exceed.
LAYOUTS = {"SPS2.1": ((46, 55), (55, 65), (65, 71), 1), "A": ((14, 24), (24, 34), None, 0), "B": ((14, 26), (26, 38), None, 0), "C": ((13, 23), (23, 33), None, 0)}
# Columns of relations before revision 2.1.
OLD_RELATION = {
    "source_line": (1, 7), "source_point": (7, 11), "source_idx": (11, 12), "ffid": (12, 16), "receiver_line": (22, 28), "from_point": (28, 32), "receiver_idx": (32, 33), "to_line": (33, 39), "to_point": (39, 43), "point_step": (47, 50)}
TEXTS = {"line", "to_line", "idx", "tape", "source_line", "source_idx", "receiver_line", "receiver_idx"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, kind, raw): the records of files; ord grows within a file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "\r$", "").alias("raw"))
    return rows.withColumn("kind", F.substring("raw", 1, 1))


def _fields(layout: dict[str, tuple[int, int]]) -> list[Column]:
    found = fixed_width(F.col("raw"), layout)
    return [c if n in TEXTS else c.try_cast("double").alias(n) for c, n in zip(found, layout, strict=True)]


def stations(lines: DataFrame) -> DataFrame:
    return lines.where("kind IN ('S', 'R')").select("file", "ord", "kind", *_fields(STATION))


def relations(lines: DataFrame) -> DataFrame:
    return lines.where("kind = 'X'").select("file", "ord", *_fields(RELATION))


def _wide(raw: Column) -> Column:
    return F.when(F.length(raw) < 80, F.rpad(raw, 80, " ")).otherwise(raw)


def _cut(raw: Column, a: int, b: int) -> Column:
    return F.trim(F.substring(raw, a + 1, b - a))


def _value(raw: Column, a: int, b: int) -> Column:
    """The number at the beginning of a field; null if there is none."""
    return number(_cut(raw, a, b))


def _either(*values: Column) -> Column:
    """The first that is neither null nor 0."""
    return F.coalesce(*[F.when(v != 0, v) for v in values])


def dead_code(raw: Column) -> Column:
    """The letters of a station that is recorded without a place: a 2.1 line whose place has no digits; else null."""
    code = _cut(raw, 24, 26)
    shaped = ~F.substring(raw, 47, 19).rlike("[0-9]") & _value(raw, 11, 21).isNotNull() & F.substring(raw, 24, 1).rlike("^[0-9 ]?$") & code.rlike("^[A-Za-z]{1,2}$")
    return F.when(shaped, code)


def _readings(raw: Column) -> Column:
    """One reading (layout, e, n, z) of each layout that gives a place, in the order of trial."""
    words = F.slice(F.split(F.trim(raw), r"\s+"), 2, 1000)
    fields = {f"{name}_{part}": _value(raw, *where) for name, (e, n, z, _) in LAYOUTS.items() for part, where in (("e", e), ("n", n), ("z", z)) if where}
    values = F.struct(*[v.alias(k) for k, v in fields.items()], F.filter(F.transform(words, number), lambda v: F.abs(v) > 10).alias("large"))

    def read(v: Column) -> Column:
        none, found = F.lit(None).cast("double"), []
        for name, (_, _, height, least) in LAYOUTS.items():
            e, n = v[f"{name}_e"], v[f"{name}_n"]
            good = e.isNotNull() & n.isNotNull() & ((F.abs(e) > least) | (F.abs(n) > least))
            found.append(F.when(good, F.struct(F.lit(name).alias("layout"), e.alias("e"), n.alias("n"), (v[f"{name}_z"] if height else none).alias("z"))))
        large = v["large"]
        found.append(F.when(F.size(large) >= 2, F.struct(F.lit("D").alias("layout"), F.get(large, F.lit(0)).alias("e"), F.get(large, F.lit(1)).alias("n"), none.alias("z"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    # An array of one element binds the fields to a name, so that each is read once.
    return F.transform(F.array(values), read)[0]


def any_stations(lines: DataFrame, by_vote: bool = False) -> DataFrame:
    """(file, ord, kind, line, point, idx, easting, northing, elevation, code, layout, file_layout, error) of the station lines of files.

    Dead stations stay, without place; a line without any place has an error. With by_vote a line that can be read under its file's
    layout is, whatever layout came first."""
    rows = lines.withColumns({"kind": F.upper("kind"), "raw": _wide(F.col("raw"))}).where("kind IN ('S', 'R')")
    rows = rows.withColumn("code", dead_code(F.col("raw"))).withColumn("readings", F.when(F.col("code").isNull(), _readings(F.col("raw"))))
    first = F.get("readings", F.lit(0))
    rows = rows.withColumn("first", F.when(F.col("code").isNotNull(), "SPS2.1").otherwise(first["layout"]))
    # The vote is a count by file and layout; of equals the layout that came first in the file.
    votes = rows.where("first IS NOT NULL").groupBy("file", "first").agg(F.count("*").alias("n"), F.min("ord").alias("at"))
    top = votes.groupBy("file").agg(F.max_by("first", F.struct(F.col("n"), -F.col("at"))).alias("file_layout"))
    rows = rows.join(top, "file", "left")
    chosen = F.coalesce(F.get(F.filter("readings", lambda x: x["layout"] == F.col("file_layout")), F.lit(0)), first) if by_vote else first
    rows = rows.withColumn("place", chosen).withColumn("layout", F.when(F.col("code").isNotNull(), "SPS2.1").otherwise(F.col("place.layout")))
    raw = F.col("raw")
    fields = {"new_line": _cut(raw, 1, 11), "old_line": _cut(raw, 1, 7), "new_point": _value(raw, 11, 21), "old_point": _value(raw, 7, 15), "short_point": _value(raw, 7, 11), "height": _value(raw, 34, 40), "far_height": _value(raw, 38, 44)}

    def read(v: Column) -> Column:
        new, place = v["layout"] == "SPS2.1", v["place"]
        point = F.coalesce(F.when(new, _either(v["new_point"])).otherwise(_either(v["old_point"], v["short_point"])), F.lit(0.0))
        height = F.coalesce(place["z"], F.when(v["code"].isNull(), F.coalesce(_either(v["height"]), v["far_height"])))
        return F.struct(F.when(new, v["new_line"]).otherwise(v["old_line"]).alias("line"), point.alias("point"), height.alias("elevation"))

    # Bound as above.
    own = F.transform(F.array(F.struct("layout", "place", "code", *[v.alias(k) for k, v in fields.items()])), read)[0]
    idx = F.nullif(F.trim(F.when(F.col("layout") == "SPS2.1", F.substring(raw, 24, 1)).otherwise(F.substring(raw, 16, 1))), F.lit(""))
    found = rows.select("file", "ord", "kind", idx.alias("idx"), F.col("place.e").alias("easting"), F.col("place.n").alias("northing"), "code", "layout", "file_layout", F.when(F.col("layout").isNull(), "no place").alias("error"), F.explode(F.array(own)).alias("own"))
    return found.select("file", "ord", "kind", "own.line", "own.point", "idx", "easting", "northing", "own.elevation", "code", "layout", "file_layout", "error")


def any_relations(lines: DataFrame) -> DataFrame:
    """Relations of either kind: a line with a source point where revision 2.1 has it is read as that, any other by the older columns."""
    rows = lines.withColumns({"kind": F.upper("kind"), "raw": _wide(F.col("raw"))}).where("kind = 'X'")
    raw = F.col("raw")
    new = F.coalesce(_value(raw, 27, 37) != 0, F.lit(False))
    field = lambda layout, n: F.lit(None).cast("string" if n in TEXTS else "double") if n not in layout else F.nullif(_cut(raw, *layout[n]), F.lit("")) if n in TEXTS else _value(raw, *layout[n])
    names = [*RELATION, *(n for n in OLD_RELATION if n not in RELATION)]
    out = rows.select("file", "ord", new.alias("is_new"), *[F.when(new, field(RELATION, n)).otherwise(field(OLD_RELATION, n)).alias(n) for n in names])
    steps = {"channel_step": F.coalesce(_either(F.col("channel_step")), F.when(F.col("is_new"), 1.0)), "point_step": F.coalesce(_either(F.col("point_step")), F.lit(1.0)), "to_line": F.coalesce("to_line", F.when(F.col("is_new"), F.col("receiver_line")))}
    return out.withColumns(steps).withColumn("layout", F.when(F.col("is_new"), "SPS2.1").otherwise("legacy")).drop("is_new")


def kind_of_file(lines: DataFrame) -> DataFrame:
    """(file, kind): by the ending, else the kind that most of the first thirty lines have; 'mixed' if none is."""
    ending = F.lower(F.regexp_extract("file", r"\.([^./\\]*)$", 1))
    known = F.coalesce(*[F.when(ending.rlike(f"^{k}(0?[12])?$"), k.upper()) for k in "srx"])
    nth = F.row_number().over(Window.partitionBy("file").orderBy("ord"))
    head = lines.select("file", "ord", F.upper("kind").alias("kind"), known.alias("known"), nth.alias("nth")).where("nth <= 30")
    count = lambda k: F.count_if(F.col("kind") == k)
    best = F.greatest(count("S"), count("R"), count("X"))
    by_lines = F.when(best == 0, "mixed").when(count("S") == best, "S").when(count("R") == best, "R").otherwise("X")
    return head.groupBy("file").agg(F.coalesce(F.first("known"), by_lines).alias("kind"))


def headers(lines: DataFrame) -> DataFrame:
    return lines.where("kind = 'H'").select("file", "ord", F.trim(F.substring("raw", 2, 3)).alias("code"), F.trim(F.substring("raw", 5, 28)).alias("name"), F.trim(F.expr("substring(raw, 33)")).alias("value"))


def _right(c: Column, width: int, decimals: int | None = None) -> Column:
    text = c.cast("string") if decimals is None else F.when(c.isNotNull(), F.format_string(f"%.{decimals}f", c))
    return F.lpad(F.coalesce(text, F.lit("")), width, " ")


def _left(c: Column, width: int) -> Column:
    return F.rpad(F.coalesce(c.cast("string"), F.lit("")), width, " ")


def station_lines(rows: DataFrame) -> DataFrame:
    """(value): SPS text of stations, for ``write.text``."""
    return rows.select(F.concat(
        F.col("kind"), _left(F.col("line"), 10), _right(F.col("point"), 10, 2), F.lit("  "), _left(F.col("idx"), 1), F.lit(" " * 22), _right(F.col("easting"), 9, 1), _right(F.col("northing"), 10, 1), _right(F.col("elevation"), 6, 1)).alias("value"))


def relation_lines(rows: DataFrame) -> DataFrame:
    whole = lambda n, w: _right(F.col(n).cast("long"), w)
    return rows.select(F.concat(
        F.lit("X"), _left(F.col("tape"), 6), whole("ffid", 8), F.lit("  "), _left(F.col("source_line"), 10), _right(F.col("source_point"), 10, 2), _left(F.col("source_idx"), 1), whole("from_channel", 5), whole("to_channel", 5), whole("channel_step", 1),
        _left(F.col("receiver_line"), 10), _right(F.col("from_point"), 10, 2), _right(F.col("to_point"), 10, 2), _left(F.col("receiver_idx"), 1)).alias("value"))
