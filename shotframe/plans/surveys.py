"""Queries that hold traces against surveys, with their SQL: customers' and suppliers' numbers stand for stations, line items for traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotframe.operators import firstbreak, geometry, sweeps
from shotframe.sources import sps

from .portfolio import query, table


def _survey(spark, d):
    """Stations on a grid of 20 m: parts are receivers, customers sources."""
    r = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("line"), F.col("p_partkey").alias("point"), ((F.col("p_partkey") % 50) * 20.0 + 500_000).alias("x"), (F.floor(F.col("p_partkey") / 50) * 20.0 + 4_000_000).alias("y"), (F.col("p_size") * 1.5).alias("elevation"))
    s = table(spark, d, "customer").select((F.col("c_custkey") % 30).alias("line"), F.col("c_custkey").alias("point"), ((F.col("c_custkey") % 30) * 40.0 + 500_010).alias("x"), (F.floor(F.col("c_custkey") / 30) * 40.0 + 4_000_010).alias("y"), (F.col("c_nationkey") * 1.0).alias("elevation"))
    return s, r


def _traces(spark, d):
    """Line items as traces: an order is a shot at its customer; some shots are off, swapped, wrongly numbered or without place, some receivers off."""
    sources, receivers = _survey(spark, d)
    o = table(spark, d, "orders").join(sources.select(F.col("point").alias("o_custkey"), F.col("x").alias("ex"), F.col("y").alias("ny")), "o_custkey")
    k = F.col("o_orderkey") % 20
    e, n = F.col("ex") + F.when(k == 0, 7.0).when(k == 1, 1.5).otherwise(0.0), F.col("ny")
    shots = o.select(
        F.col("o_orderkey").alias("ffid"), F.when(k.isin(3, 4, 5), F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")).alias("source_point"),
        F.when(k.isin(2, 4), n).when(k == 6, 0.0).when(k == 5, e + 11).otherwise(e).alias("e"), F.when(k.isin(2, 4), e).when(k == 6, 0.0).otherwise(n).alias("n"))
    lines = table(spark, d, "lineitem").join(receivers.select(F.col("point").alias("l_partkey"), F.col("x").alias("rx"), F.col("y").alias("ry")), "l_partkey").withColumnRenamed("l_orderkey", "ffid")
    moved = F.when(F.col("l_linenumber") == 5, F.when(F.col("ffid") % 3 == 0, 9.0).otherwise(0.25)).otherwise(0.0)
    scaled = lambda v: F.floor(v * 100 + 0.5).cast("long")
    return lines.join(shots, "ffid").select(
        (F.col("ffid") * 10 + F.col("l_linenumber")).alias("trace"), "ffid", "source_point", scaled(F.col("e")).alias("source_x"), scaled(F.col("n")).alias("source_y"), scaled(F.col("rx") + moved).alias("receiver_x"),
        scaled(F.col("ry")).alias("receiver_y"), F.when(F.col("ffid") % 500 == 0, 0).otherwise(-100).alias("coordinate_scalar"))


_SURVEY = """r AS (SELECT p_partkey % 50 AS line, p_partkey AS point, p_partkey % 50 * 20.0::DOUBLE + 500000 AS x, p_partkey // 50 * 20.0::DOUBLE + 4000000 AS y, p_size * 1.5::DOUBLE AS z FROM part),
s AS (SELECT c_custkey % 30 AS line, c_custkey AS point, c_custkey % 30 * 40.0::DOUBLE + 500010 AS x, c_custkey // 30 * 40.0::DOUBLE + 4000010 AS y, c_nationkey * 1.0::DOUBLE AS z FROM customer),
o AS (SELECT o_orderkey AS ffid, o_orderkey % 20 AS k, o_custkey, x + CASE o_orderkey % 20 WHEN 0 THEN 7 WHEN 1 THEN 1.5::DOUBLE ELSE 0 END AS e, y AS n FROM orders JOIN s ON o_custkey = point),
h AS (SELECT ffid, CASE WHEN k IN (3, 4, 5) THEN o_custkey + 10000000 ELSE o_custkey END AS sp, CASE WHEN k IN (2, 4) THEN n WHEN k = 6 THEN 0 WHEN k = 5 THEN e + 11 ELSE e END AS e, CASE WHEN k IN (2, 4) THEN e WHEN k = 6 THEN 0 ELSE n END AS n FROM o),
t AS (SELECT ffid * 10 + l_linenumber AS trace, ffid, sp, CAST(floor(h.e * 100 + 0.5) AS BIGINT) AS sx0, CAST(floor(h.n * 100 + 0.5) AS BIGINT) AS sy0,
  CAST(floor((r.x + CASE WHEN l_linenumber = 5 THEN CASE WHEN ffid % 3 = 0 THEN 9 ELSE 0.25::DOUBLE END ELSE 0 END) * 100 + 0.5) AS BIGINT) AS rx0, CAST(floor(r.y * 100 + 0.5) AS BIGINT) AS ry0, CASE WHEN ffid % 500 = 0 THEN 0 ELSE -100 END AS sc
  FROM lineitem JOIN h ON l_orderkey = ffid JOIN r ON l_partkey = r.point),
p AS (SELECT *, sx0 / CASE sc WHEN 0 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS sx, sy0 / CASE sc WHEN 0 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS sy, rx0 / CASE sc WHEN 0 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS rx, ry0 / CASE sc WHEN 0 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS ry FROM t),
f AS (SELECT ffid, any_value(sp) AS sp, any_value(sx) AS sx, any_value(sy) AS sy FROM p GROUP BY ffid),
m AS (SELECT f.*, (SELECT count(*) FROM s WHERE s.point = f.sp) AS named,
  (SELECT min({'d': sqrt((f.sx - s.x) ** 2 + (f.sy - s.y) ** 2), 'line': s.line, 'point': s.point}) FROM s WHERE s.point = f.sp) AS own,
  (SELECT min(sqrt((f.sx - s.y) ** 2 + (f.sy - s.x) ** 2)) FROM s WHERE s.point = f.sp) AS own_turned,
  (SELECT min({'d': sqrt((f.sx - s.x) ** 2 + (f.sy - s.y) ** 2), 'line': s.line, 'point': s.point}) FROM s WHERE s.x BETWEEN f.sx - 2 AND f.sx + 2 AND s.y BETWEEN f.sy - 2 AND f.sy + 2) AS near,
  (SELECT min(sqrt((f.sx - s.y) ** 2 + (f.sy - s.x) ** 2)) FROM s WHERE s.x BETWEEN f.sy - 2 AND f.sy + 2 AND s.y BETWEEN f.sx - 2 AND f.sx + 2) AS turned FROM f),
q AS (SELECT ffid, CASE WHEN named > 0 THEN CASE WHEN own.d <= 2 THEN 'matched' WHEN own_turned <= 2 THEN 'swapped' ELSE 'off' END WHEN near.d <= 2 THEN 'numbering' WHEN turned <= 2 THEN 'swapped' ELSE 'off' END AS outcome,
  CASE WHEN named > 0 THEN own.line WHEN near.d <= 2 THEN near.line END AS line, CASE WHEN named > 0 THEN own.point WHEN near.d <= 2 THEN near.point END AS point, CASE WHEN named > 0 THEN own.d WHEN near.d <= 2 THEN near.d END AS dist FROM m WHERE sx <> 0 OR sy <> 0),
u AS (SELECT DISTINCT rx, ry FROM p), v AS (SELECT u.*, (SELECT min({'d': sqrt((u.rx - r.x) ** 2 + (u.ry - r.y) ** 2), 'line': r.line, 'point': r.point}) FROM r WHERE r.x BETWEEN u.rx - 2 AND u.rx + 2 AND r.y BETWEEN u.ry - 2 AND u.ry + 2) AS near FROM u)"""


@query(f"""WITH {_SURVEY} SELECT ffid, outcome, line, point, round(dist, 4) AS dist FROM q""")
def geometry_sources(spark, d):
    out = geometry.match_sources(geometry.placed(_traces(spark, d)), _survey(spark, d)[0])
    return out.withColumn("dist", F.round("dist", 4))


@query(f"""WITH {_SURVEY}, c AS (SELECT outcome, count(*) AS n FROM q GROUP BY outcome), g AS (SELECT p.*, v.near.d <= 2 AS ok, v.near.line AS line, v.near.point AS point FROM p JOIN v USING (rx, ry))
SELECT * FROM (SELECT 'Scalar' AS category, 'warn' AS severity, count(DISTINCT sc) AS n FROM p WHERE sc <> 0 HAVING count(DISTINCT sc) > 1
UNION ALL SELECT CASE outcome WHEN 'swapped' THEN 'SourceSwap' WHEN 'off' THEN 'SourcePos' ELSE 'SourceNumbering' END, CASE outcome WHEN 'numbering' THEN 'info' ELSE 'error' END, n FROM c WHERE outcome <> 'matched'
UNION ALL SELECT 'ReceiverPos', 'error', count(*) FROM g WHERE ok IS NOT TRUE
UNION ALL SELECT 'MissingStation', 'warn', count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM g WHERE ok AND g.line = r.line AND g.point = r.point)) WHERE n > 0""")
def geometry_check(spark, d):
    return geometry.check(_traces(spark, d), *_survey(spark, d))


@query(f"""WITH {_SURVEY}, w AS (SELECT *, CASE WHEN named > 0 AND ((sx = 0 AND sy = 0) OR own.d <= 2) THEN {{'line': own.line, 'point': own.point}} WHEN (sx <> 0 OR sy <> 0) AND near.d <= 2 THEN {{'line': near.line, 'point': near.point}} END AS st FROM m),
a AS (SELECT ffid, s.x, s.y, s.z FROM w JOIN s ON s.line = st.line AND s.point = st.point), b AS (SELECT rx, ry, r.x, r.y, r.z FROM v JOIN r ON v.near.d <= 2 AND r.line = v.near.line AND r.point = v.near.point),
e AS (SELECT p.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS bby, b.z AS bz FROM p LEFT JOIN a ON p.ffid = a.ffid LEFT JOIN b ON p.rx = b.rx AND p.ry = b.ry)
SELECT trace, coalesce(CAST(floor(ax * 100 + 0.5) AS BIGINT), sx0) AS source_x, coalesce(CAST(floor(ay * 100 + 0.5) AS BIGINT), sy0) AS source_y, coalesce(CAST(floor(bx * 100 + 0.5) AS BIGINT), rx0) AS receiver_x, coalesce(CAST(floor(bby * 100 + 0.5) AS BIGINT), ry0) AS receiver_y,
  CAST(floor(az * 100 + 0.5) AS BIGINT) AS source_elevation, CAST(floor(bz * 100 + 0.5) AS BIGINT) AS receiver_elevation, CAST(floor(sqrt((ax - bx) ** 2 + (ay - bby) ** 2) + 0.5) AS BIGINT) AS "offset", CAST(floor((ax + bx) / 2 * 100 + 0.5) AS BIGINT) AS midpoint_x,
  CASE WHEN ax IS NOT NULL OR bx IS NOT NULL THEN -100 ELSE sc END AS coordinate_scalar FROM e""")
def geometry_load(spark, d):
    out = geometry.load(_traces(spark, d), *_survey(spark, d))
    return out.select("trace", "source_x", "source_y", "receiver_x", "receiver_y", "source_elevation", "receiver_elevation", "offset", "midpoint_x", "coordinate_scalar")


#: Traces of a gather, and microseconds between samples.
GATHER, INTERVAL = 100, 2000


def _gathers(spark, d):
    """The tables' traces in gathers with an onset that moves out, and every thirtieth trace seeded at it; some traces are dead, some gathers have one seed."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / GATHER).alias("gather"), F.col("vec_id").alias("trace"), "embedding")
    k = F.col("trace") % GATHER
    onset = (F.lit(24) + F.floor(k / 5)).cast("int")
    x = F.transform("embedding", lambda v, i: F.when(k % 41 == 7, 0.0).when(i < onset, v.cast("double") * 0.01).otherwise(v.cast("double")))
    rows = e.select("gather", "trace", F.when(F.col("gather") % 3 > 0, (k * 25.0 + 10) * F.when(k % 2 == 0, -1).otherwise(1)).alias("offset"), x.alias("samples"), onset.alias("onset"))
    seeds = rows.where((k % 30 == 0) & ((F.col("gather") % 4 > 0) | (k == 0))).select("gather", "trace", (F.col("onset") * INTERVAL / 1000.0).alias("ms"))
    return rows, seeds


@query(f"""WITH t AS (SELECT vec_id // {GATHER} AS gather, vec_id AS trace, vec_id % {GATHER} AS k, 24 + vec_id % {GATHER} // 5 AS onset, embedding FROM embeddings),
l AS (SELECT gather, trace, k, onset, i, CASE WHEN k % 41 = 7 THEN 0 WHEN i - 1 < onset THEN CAST(embedding[i] AS DOUBLE) * 0.01::DOUBLE ELSE CAST(embedding[i] AS DOUBLE) END AS x FROM t, generate_series(1, 64) g(i)),
r AS (SELECT gather, trace, any_value(k) AS k, any_value(onset) AS onset, sqrt(sum(x * x) / count(*)) AS rms FROM l GROUP BY gather, trace),
m AS (SELECT *, median(CASE WHEN rms > 0 THEN rms END) OVER (PARTITION BY gather) AS level, CASE WHEN gather % 3 > 0 THEN k * 25.0::DOUBLE + 10 ELSE CAST(trace AS DOUBLE) END AS key FROM r),
s AS (SELECT gather, key, onset * 2.0::DOUBLE AS ms, lead(key) OVER w AS key2, lead(onset * 2.0::DOUBLE) OVER w AS ms2, row_number() OVER w AS nth, count(*) OVER (PARTITION BY gather) AS n FROM m WHERE k % 30 = 0 AND (gather % 4 > 0 OR k = 0) WINDOW w AS (PARTITION BY gather ORDER BY key)),
p AS (SELECT *, nth = 1 AS head, nth = n - 1 AS tail FROM s WHERE key2 IS NOT NULL)
SELECT m.gather, trace, round(rms, 6) AS rms, rms <= 0 OR coalesce(rms < 0.02 * level, false) AS dead, m.key, round(p.ms + (p.ms2 - p.ms) / (p.key2 - p.key) * (m.key - p.key), 6) AS guide
FROM m LEFT JOIN p ON m.gather = p.gather AND (m.key > p.key OR head) AND (m.key <= p.key2 OR tail)""")
def first_break_guide(spark, d):
    rows, seeds = _gathers(spark, d)
    out = firstbreak.guided(rows.drop("onset"), seeds, firstbreak.Options(sta_ms=6, lta_ms=40), INTERVAL)
    return out.select("gather", "trace", F.round("rms", 6).alias("rms"), "dead", "key", F.round("guide", 6).alias("guide"))


@query()
def first_breaks(spark, d):
    """Tests hold the picks against a plain reading of the rules."""
    rows, seeds = _gathers(spark, d)
    out = firstbreak.assist(rows.drop("onset"), seeds, INTERVAL, firstbreak.Options(sta_ms=6, lta_ms=40, wavelet_ms=12, gain_ms=60))
    return out.withColumns({c: F.round(c, 6) for c in ("ms", "confidence", "deviation", "guide")})


def _station_lines(spark, d):
    """(file, ord, kind, raw): customers as station lines, in the layout of their file or, some, in another; some dead, some without place."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    e, n = (k % 90_000) * 7 + 400_000.5, (k % 70_000) * 9 + 4_000_000.2
    pad = lambda v, w, places: F.lpad(F.format_string(f"%.{places}f", v), w, " ")
    line, point = F.lpad((k % 40).cast("string"), 6, " "), F.lpad((k % 9999 + 1).cast("string"), 4, " ")
    code = F.when(k % 31 == 0, "KL").otherwise(F.when(k % 2 == 0, "G1").otherwise("  "))
    new = F.concat(F.lit("S"), F.rpad((k % 40).cast("string"), 10, " "), F.lpad(F.format_string("%.2f", (k % 9999 + 1).cast("double")), 10, " "), F.lit("  "), F.lit("1"), code, F.lit(" " * 20), F.when(k % 31 == 0, F.lit(" " * 19)).otherwise(F.concat(pad(e, 9, 1), pad(n, 10, 1))), F.when(k % 31 == 0, F.lit("")).otherwise(pad(k % 300 / 2, 6, 1)))
    a = F.concat(F.lit("R"), line, point, F.lit("   "), pad(e, 10, 1), pad(n, 10, 1), pad(k % 300 / 2, 6, 1))
    b = F.concat(F.lit("R"), line, point, F.lit("   "), pad(e, 12, 3), pad(n, 12, 3), pad(k % 300 / 2, 6, 1))
    cc = F.concat(F.lit("r"), line, point, F.lit("  "), pad(e, 10, 1), pad(n, 10, 1))
    free = F.concat(F.lit("S "), (k % 9).cast("string"), F.lit("\t"), (k % 7).cast("string"), F.lit("  "), F.format_string("%.2f", e), F.lit(" "), F.format_string("%.2f", n))
    shapes = F.array(new, a, b, cc, free, F.lit("S  x"))
    kind = F.when(k % 17 == 0, k % 6).otherwise(k % 5)
    raw = F.element_at(shapes, (F.when(F.col("c_custkey") % 17 == 0, kind).otherwise(F.floor(k / 50) % 5) + 1).cast("int"))
    # Exploded, so that a line is a column like one that was read, not an expression that every field repeats.
    lines = c.select(F.floor(k / 50).cast("string").alias("file"), k.alias("ord"), F.explode(F.array(raw)).alias("raw"))
    return lines.select("file", "ord", F.substring("raw", 1, 1).alias("kind"), "raw")


def _num(a: int, b: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract(trim(substr(raw, {a + 1}, {b - a})), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'), '') AS DOUBLE)"


def _place(name: str, a: int, b: int, c: int, d: int, least: int, z: str = "NULL") -> str:
    return f"WHEN abs({_num(a, b)}) > {least} AND {_num(c, d)} IS NOT NULL OR abs({_num(c, d)}) > {least} AND {_num(a, b)} IS NOT NULL THEN {{'layout': '{name}', 'e': {_num(a, b)}, 'n': {_num(c, d)}, 'z': CAST({z} AS DOUBLE)}}"


_FORMAT = "lpad(printf('%.{p}f', CAST({v} AS DOUBLE)), {w}, ' ')"
_E, _N = "(c_custkey % 90000 * 7 + 400000.5)", "(c_custkey % 70000 * 9 + 4000000.2)"
_PAD = lambda v, w, p: _FORMAT.format(v=v, w=w, p=p)
_LINES = f"""k AS (SELECT c_custkey, CAST(c_custkey // 50 AS VARCHAR) AS file, CASE WHEN c_custkey % 17 = 0 THEN c_custkey % 6 ELSE c_custkey // 50 % 5 END AS shape FROM customer),
l AS (SELECT file, c_custkey AS ord, CASE shape
  WHEN 0 THEN 'S' || rpad(CAST(c_custkey % 40 AS VARCHAR), 10, ' ') || {_PAD('c_custkey % 9999 + 1', 10, 2)} || '  1' || CASE WHEN c_custkey % 31 = 0 THEN 'KL' WHEN c_custkey % 2 = 0 THEN 'G1' ELSE '  ' END || repeat(' ', 20)
    || CASE WHEN c_custkey % 31 = 0 THEN repeat(' ', 19) ELSE {_PAD(_E, 9, 1)} || {_PAD(_N, 10, 1)} || {_PAD('c_custkey % 300 / 2', 6, 1)} END
  WHEN 1 THEN 'R' || lpad(CAST(c_custkey % 40 AS VARCHAR), 6, ' ') || lpad(CAST(c_custkey % 9999 + 1 AS VARCHAR), 4, ' ') || '   ' || {_PAD(_E, 10, 1)} || {_PAD(_N, 10, 1)} || {_PAD('c_custkey % 300 / 2', 6, 1)}
  WHEN 2 THEN 'R' || lpad(CAST(c_custkey % 40 AS VARCHAR), 6, ' ') || lpad(CAST(c_custkey % 9999 + 1 AS VARCHAR), 4, ' ') || '   ' || {_PAD(_E, 12, 3)} || {_PAD(_N, 12, 3)} || {_PAD('c_custkey % 300 / 2', 6, 1)}
  WHEN 3 THEN 'r' || lpad(CAST(c_custkey % 40 AS VARCHAR), 6, ' ') || lpad(CAST(c_custkey % 9999 + 1 AS VARCHAR), 4, ' ') || '  ' || {_PAD(_E, 10, 1)} || {_PAD(_N, 10, 1)}
  WHEN 4 THEN 'S ' || c_custkey % 9 || chr(9) || c_custkey % 7 || '  ' || printf('%.2f', {_E}::DOUBLE) || ' ' || printf('%.2f', {_N}::DOUBLE) ELSE 'S  x' END AS line0 FROM k),
w AS (SELECT file, ord, upper(line0[1]) AS kind, CASE WHEN length(line0) < 80 THEN rpad(line0, 80, ' ') ELSE line0 END AS raw FROM l),
c AS (SELECT *, CASE WHEN NOT regexp_matches(substr(raw, 47, 19), '[0-9]') AND {_num(11, 21)} IS NOT NULL AND regexp_matches(substr(raw, 24, 1), '^[0-9 ]?$') AND regexp_matches(trim(substr(raw, 25, 2)), '^[A-Za-z]{{1,2}}$') THEN trim(substr(raw, 25, 2)) END AS code,
  list_filter(list_transform(list_slice(regexp_split_to_array(trim(raw), '\\s+'), 2, 1000), lambda x: TRY_CAST(nullif(regexp_extract(x, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'), '') AS DOUBLE)), lambda x: abs(x) > 10) AS big FROM w),
p AS (SELECT *, CASE WHEN code IS NOT NULL THEN NULL {_place('SPS2.1', 46, 55, 55, 65, 1, _num(65, 71))} {_place('A', 14, 24, 24, 34, 0)} {_place('B', 14, 26, 26, 38, 0)} {_place('C', 13, 23, 23, 33, 0)}
  WHEN len(big) >= 2 THEN {{'layout': 'D', 'e': big[1], 'n': big[2], 'z': CAST(NULL AS DOUBLE)}} END AS pl FROM c),
y AS (SELECT *, CASE WHEN code IS NOT NULL THEN 'SPS2.1' ELSE pl.layout END AS layout FROM p),
v AS (SELECT file, arg_max(layout, (n, -first)) AS file_layout FROM (SELECT file, layout, count(*) AS n, min(ord) AS first FROM y WHERE layout IS NOT NULL GROUP BY file, layout) GROUP BY file)"""


@query(f"""WITH {_LINES} SELECT y.file, ord, kind, CASE WHEN layout = 'SPS2.1' THEN trim(substr(raw, 2, 10)) ELSE trim(substr(raw, 2, 6)) END AS line,
  coalesce(CASE WHEN layout = 'SPS2.1' THEN {_num(11, 21)} ELSE coalesce(nullif({_num(7, 15)}, 0), nullif({_num(7, 11)}, 0)) END, 0) AS point, nullif(trim(CASE WHEN layout = 'SPS2.1' THEN substr(raw, 24, 1) ELSE substr(raw, 16, 1) END), '') AS idx,
  pl.e AS easting, pl.n AS northing, coalesce(pl.z, CASE WHEN code IS NULL THEN coalesce(nullif({_num(34, 40)}, 0), {_num(38, 44)}) END) AS elevation, code, layout, file_layout, CASE WHEN layout IS NULL THEN 'no place' END AS error FROM y LEFT JOIN v ON y.file = v.file""")
def sps_layouts(spark, d):
    return sps.any_stations(_station_lines(spark, d))


def _designs(spark, d):
    """Suppliers as sweep designs of every kind, some with faults, at 1000 samples a second."""
    k = F.col("s_suppkey")
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("linear", "dbhz", "dboct", "tpower", "sine")]), (k % 21 % 5 + 1).cast("int"))
    return table(spark, d, "supplier").select(
        k.alias("sweep"), kinds.alias("kind"), (k % 7 + 5.0).alias("f0"), (k % 90 + 20.0).alias("f1"), F.lit(300.0).alias("ms"), F.when(k % 2 == 0, (k % 5 + 0.5) / 10).alias("slope"), (k % 4 * 30.0).alias("taper_in_ms"),
        (k % 3 * 40.0).alias("taper_out_ms"), F.when(k % 3 == 0, "blackman").otherwise("cosine").alias("taper"), (k % 4 * 90.0).alias("phase_deg"), F.when(k % 19 == 0, 1.5).otherwise(0.5).alias("amplitude"))


_SWEEPS = """k AS (SELECT s_suppkey AS sweep, s_suppkey AS k, ['linear', 'dbhz', 'dboct', 'tpower', 'sine'][s_suppkey % 21 % 5 + 1] AS kind, s_suppkey % 7 + 5.0::DOUBLE AS f0, s_suppkey % 90 + 20.0::DOUBLE AS f1, s_suppkey % 4 * 30.0::DOUBLE AS ti,
  s_suppkey % 3 * 40.0::DOUBLE AS tx, s_suppkey % 3 = 0 AS bm, s_suppkey % 4 * 90.0::DOUBLE AS ph, CASE WHEN s_suppkey % 19 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS am FROM supplier),
g AS (SELECT *, CASE WHEN k % 2 = 0 THEN (k % 5 + 0.5::DOUBLE) / 10 ELSE CASE kind WHEN 'dbhz' THEN 0.1::DOUBLE WHEN 'dboct' THEN 3 WHEN 'tpower' THEN 2 ELSE 0 END END AS sl FROM k WHERE kind <> 'sine' AND am <= 1),
s AS (SELECT g.*, i, i * 1.0::DOUBLE AS t, i / 300.0::DOUBLE AS x FROM g, range(0, 301) r(i)),
f AS (SELECT *, CASE kind WHEN 'dbhz' THEN f0 + ln(1 + x * (exp(sl * ln(10::DOUBLE) / 10 * (f1 - f0)) - 1)) / (sl * ln(10::DOUBLE) / 10)
  WHEN 'dboct' THEN (f0 ** (sl * log2(10::DOUBLE) / 10 + 1) + x * (f1 ** (sl * log2(10::DOUBLE) / 10 + 1) - f0 ** (sl * log2(10::DOUBLE) / 10 + 1))) ** (1 / (sl * log2(10::DOUBLE) / 10 + 1))
  WHEN 'tpower' THEN f0 + (f1 - f0) * x ** (sl + 1) ELSE f0 + (f1 - f0) * x END AS f, CASE WHEN ti > 0 AND t < ti THEN t / ti ELSE 1 END AS a, CASE WHEN tx > 0 AND t > 300 - tx THEN (300 - t) / tx ELSE 1 END AS b FROM s),
e AS (SELECT *, am * (CASE WHEN bm THEN 0.42::DOUBLE - 0.5::DOUBLE * cos(pi() * a) + 0.08::DOUBLE * cos(2 * pi() * a) ELSE 0.5::DOUBLE - 0.5::DOUBLE * cos(pi() * a) END) * (CASE WHEN bm THEN 0.42::DOUBLE - 0.5::DOUBLE * cos(pi() * b) + 0.08::DOUBLE * cos(2 * pi() * b) ELSE 0.5::DOUBLE - 0.5::DOUBLE * cos(pi() * b) END) AS env,
  radians(ph) + coalesce(sum(pi() * (f + before) / 1000) OVER (PARTITION BY sweep ORDER BY i), 0) AS phase FROM (SELECT *, lag(f) OVER (PARTITION BY sweep ORDER BY i) AS before FROM f) q),
y AS (SELECT *, env * cos(phase) AS v FROM e)"""


@query(f"""WITH {_SWEEPS} SELECT sweep, CAST(i AS INTEGER) AS i, round(f, 6) AS frequency, round(greatest(env, 0), 6) AS envelope, round(phase, 6) AS phase, round(v, 6) AS sample FROM y""")
def sweep_designs(spark, d):
    made = sweeps.designs(_designs(spark, d), 1000.0).where(F.size("faults") == 0)
    long = made.select("sweep", F.posexplode(F.arrays_zip("frequency", "envelope", "designed_phase", "samples")).alias("i", "s"))
    return long.select("sweep", "i", (F.round("s.frequency", 6) + 0.0).alias("frequency"), (F.round("s.envelope", 6) + 0.0).alias("envelope"), (F.round(F.radians("s.designed_phase"), 6) + 0.0).alias("phase"), (F.round("s.samples", 6) + 0.0).alias("sample"))


@query(f"""WITH {_SWEEPS}, w AS (SELECT a.sweep, b.i - a.i AS lag, sum(a.v * b.v) AS r FROM y a JOIN y b ON a.sweep = b.sweep AND b.i BETWEEN a.i AND a.i + 100 GROUP BY a.sweep, b.i - a.i),
n AS (SELECT sweep, lag, r / max(CASE WHEN lag = 0 THEN r END) OVER (PARTITION BY sweep) AS r FROM w), c AS (SELECT *, lag(r) OVER (PARTITION BY sweep ORDER BY lag) AS before FROM n),
z AS (SELECT sweep, min(lag) AS turn FROM c WHERE (r > 0) <> (before > 0) GROUP BY sweep)
SELECT n.sweep, round(min(120, -20 * log10(max(abs(r)))), 4) AS sidelobe_db, 2.0::DOUBLE * any_value(turn) AS main_lobe_ms FROM n JOIN z ON n.sweep = z.sweep AND lag >= turn GROUP BY n.sweep""".replace("min(120, -20 * log10(max(abs(r))))", "least(120, -20 * log10(max(abs(r))))"))
def sweep_klauder(spark, d):
    made = sweeps.designs(_designs(spark, d), 1000.0).where(F.size("faults") == 0)
    found = made.select("sweep", sweeps.klauder(F.col("samples"), 1000.0, 100.0).alias("k"))
    return found.select("sweep", F.round("k.sidelobe_db", 4).alias("sidelobe_db"), F.col("k.main_lobe_ms").alias("main_lobe_ms")).where("main_lobe_ms > 0")
