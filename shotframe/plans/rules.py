"""Queries of the scalar rules and report operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotframe.functions import scalars
from shotframe.operators import reports, survey

from .portfolio import query, table

_FIX = lambda v, k: f"CASE WHEN {v} < 0 THEN '-' ELSE '' END || CAST(CAST(floor(abs({v}) * {10.0**k} + 0.5) / {10.0**k} AS DECIMAL(38,{k})) AS VARCHAR)"


@query(f"""SELECT c_custkey, lpad(CASE WHEN length({_FIX('c_acctbal', 2)}) <= 6 THEN {_FIX('c_acctbal', 2)} WHEN length({_FIX('c_acctbal', 1)}) <= 6 THEN {_FIX('c_acctbal', 1)} ELSE {_FIX('c_acctbal', 0)} END, 6, ' ') AS fitted,
  lower(regexp_replace(c_mktsegment || '-' || c_name, '[^A-Za-z0-9]', '', 'g')) AS token,
  CASE WHEN c_custkey < 26 THEN chr(65 + CAST(c_custkey AS INTEGER)) WHEN c_custkey < 702 THEN chr(65 + CAST(c_custkey // 26 - 1 AS INTEGER)) || chr(65 + CAST(c_custkey % 26 AS INTEGER))
    ELSE chr(65 + CAST(((c_custkey - 26) // 676 - 1) % 26 AS INTEGER)) || chr(65 + CAST((c_custkey - 26) // 26 % 26 AS INTEGER)) || chr(65 + CAST(c_custkey % 26 AS INTEGER)) END AS letters FROM customer""")
def field_text(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", scalars.fit_number(F.col("c_acctbal"), 6).alias("fitted"), scalars.normal_token(F.concat_ws("-", "c_mktsegment", "c_name")).alias("token"),
                    scalars.column_letter(F.col("c_custkey")).alias("letters"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS cell,
  replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped,
  CASE WHEN length(text) <= 512 THEN nullif(regexp_replace(regexp_replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g'), '^[\\s\\x{A0}\\x{FEFF}]+|[\\s\\x{A0}\\x{FEFF}]+$', '', 'g'), '') END AS message FROM documents""")
def field_quoting(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", scalars.csv_cell(t).alias("cell"), scalars.xml_escape(t).alias("escaped"), scalars.clean_message(t).alias("message"))


@query("""SELECT event_id, event_type || '@' || CAST(user_id AS VARCHAR) AS log_key, strftime(make_timestamp(CAST(CASE WHEN v >= 1e11 THEN v ELSE v * 1000 END AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso,
  event_type LIKE 'c%' AS is_c, strftime(ts, ' %y%j') AS tape_date FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 1700000000 + event_id ELSE 1700000000000 + event_id END AS v FROM events)""")
def field_times(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 2 == 0, 1700000000 + F.col("event_id")).otherwise(1700000000000 + F.col("event_id")))
    named = F.when(F.col("event_type").startswith("c"), F.when(F.col("event_id") % 2 == 0, F.lit("D:\\\\scs\\\\tMP1.seg")).otherwise(F.lit("run/Tmp1"))).otherwise(F.when(F.col("event_id") % 2 == 0, F.lit("tmp/STAT.1")).otherwise(F.lit("x" * 270)))
    return e.select("event_id", scalars.log_key(F.col("event_type"), F.col("user_id").cast("string")).alias("log_key"), scalars.epoch_iso(F.col("v")).alias("iso"),
                    scalars.touches(named).alias("is_c"), scalars.tape_date(F.col("ts").cast("timestamp")).alias("tape_date"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN s < 0 THEN q / -s WHEN s > 0 THEN q * s ELSE q END, 6) AS applied,
  CAST(greatest(least(floor(CASE WHEN s < 0 THEN p * -s WHEN s > 0 THEN p / s ELSE p END + 0.5), 2147483647), -2147483648) AS BIGINT) AS encoded,
  CAST(CASE WHEN p * 1000.0 * 10000.0 <= 2147483647 THEN -10000 WHEN p * 1000.0 * 1000.0 <= 2147483647 THEN -1000 WHEN p * 1000.0 * 100.0 <= 2147483647 THEN -100 WHEN p * 1000.0 * 10.0 <= 2147483647 THEN -10 ELSE 1 END AS INTEGER) AS fitted,
  CASE WHEN floor(p + 0.5) BETWEEN -32768 AND 32767 AND floor(p + 0.5) <> 0 THEN CAST(floor(p + 0.5) AS BIGINT) END AS word, CASE WHEN q < 0.1 THEN 's' WHEN q <= 20 THEN 'ms' ELSE 'us' END AS unit, round(l_linenumber * q / 1000.0, 6) AS ms,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, q - 10)) AS clamped, round(CASE WHEN (p % 360 + 360) % 360 > 180 THEN (p % 360 + 360) % 360 - 360 ELSE (p % 360 + 360) % 360 END, 4) AS wrapped
  FROM (SELECT *, l_extendedprice AS p, l_quantity AS q, CAST([-100, 0, 10, -10][1 + l_linenumber % 4] AS INTEGER) AS s FROM lineitem)""")
def header_scalars(spark, d):
    scalar = F.element_at(F.array(*[F.lit(s) for s in (-100, 0, 10, -10)]), F.col("l_linenumber") % 4 + 1)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), scalar.alias("s"))
    p, q, s = F.col("p"), F.col("q"), F.col("s")
    return rows.select(
        "l_orderkey", "l_linenumber", F.round(scalars.apply_scalar(q, s), 6).alias("applied"), scalars.encode_scalar(p, s).alias("encoded"), scalars.fit_scalar(p * 1000.0, -10000).alias("fitted"),
        scalars.word_or_null(p, 16).alias("word"), F.when(q < 0.1, "s").otherwise(scalars.interval_unit(q * 10)).alias("unit"), F.round(scalars.sample_ms(F.col("l_linenumber"), q), 6).alias("ms"),
        scalars.clamp01(q - 10).alias("clamped"), (F.round(scalars.wrap180(p), 4) + 0.0).alias("wrapped"))


_WHOLE = lambda k: f"bool_and(abs(v * {10.0**k} - floor(v * {10.0**k} + 0.5)) < 1e-6)"


# Balances of some nations are made large or finer, so that every scalar is chosen somewhere.
@query(f"""SELECT c_nationkey, CAST(CASE {' '.join(f"WHEN most * {10.0**k} <= 2147483647 AND w{k} THEN {-(10**k) if k else 1}" for k in range(5))}
  {' '.join(f"WHEN most * {10.0**k} <= 2147483647 THEN {-(10**k) if k else 1}" for k in (4, 3, 2, 1, 0))} ELSE 1 END AS INTEGER) AS scalar
  FROM (SELECT c_nationkey, max(abs(v)) AS most, {', '.join(f"{_WHOLE(k)} AS w{k}" for k in range(5))}
  FROM (SELECT c_nationkey, CASE c_nationkey % 5 WHEN 0 THEN floor(c_acctbal) WHEN 1 THEN c_acctbal * 1000.0 WHEN 2 THEN c_acctbal / 7.0 WHEN 3 THEN c_acctbal * 1e7 ELSE c_acctbal END AS v FROM customer) GROUP BY c_nationkey)""")
def chosen_scalars(spark, d):
    k, v = F.col("c_nationkey") % 5, F.col("c_acctbal")
    values = F.when(k == 0, F.floor(v).cast("double")).when(k == 1, v * 1000.0).when(k == 2, v / 7.0).when(k == 3, v * 1e7).otherwise(v)
    return table(spark, d, "customer").select("c_nationkey", values.alias("v")).groupBy("c_nationkey").agg(scalars.choose_scalar(F.col("v")).alias("scalar"))


@query("""SELECT event_type, min(value) AS x_low, max(value) AS x_high, min(user_id) AS y_low, max(user_id) AS y_high, count(*) AS n FROM events GROUP BY event_type""")
def point_boxes(spark, d):
    return reports.bounding_box(table(spark, d, "events"), "value", "user_id", "event_type")


@query("""WITH s AS (SELECT user_id, value - lag(value) OVER w AS dx, event_id - lag(event_id) OVER w AS dy FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(coalesce(sum(sqrt(dx * dx + dy * dy)), 0), 4) AS length FROM s GROUP BY user_id""")
def line_lengths(spark, d):
    out = reports.arc_length(table(spark, d, "events"), "user_id", "event_id", "value", "event_id")
    return out.withColumn("length", F.round("length", 4) + 0.0)


@query("""SELECT event_type, user_id, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS place
  FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id)) WHERE place <= 6""")
def worst_offenders(spark, d):
    return reports.leaders(table(spark, d, "events"), "event_type", "user_id", 6)


@query("""SELECT event_id, user_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events) WHERE place % 7 = 0""")
def stride_sample(spark, d):
    return reports.stride_sample(table(spark, d, "events"), "user_id", "event_id", 7).select("event_id", "user_id", "place")


@query("""SELECT event_id, user_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events) WHERE place % 10 < 3""")
def block_sample(spark, d):
    return reports.block_sample(table(spark, d, "events"), "user_id", "event_id", 10, 3).select("event_id", "user_id", "place")


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS matched, round(count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*), 6) AS percent FROM orders GROUP BY o_orderpriority""")
def shot_coverage(spark, d):
    out = reports.coverage(table(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_orderpriority")
    return out.withColumn("percent", F.round("percent", 6))


@query("""SELECT l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_linestatus, l_linenumber""")
def scalar_inventory(spark, d):
    return reports.value_inventory(table(spark, d, "lineitem"), "l_linestatus", "l_linenumber")


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS lines FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1""")
def reused_stations(spark, d):
    return reports.shared_names(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("""SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def first_shots(spark, d):
    return reports.first_seen(table(spark, d, "events"), "user_id", "event_id", "event_id", "event_type")


# Stations are parts along 20 lines, sources orders; a relation holds a range of parts of a line, in steps of one to three.
@query("""WITH rcv AS (SELECT p_partkey % 20 AS line, p_partkey AS point, p_retailprice * 10 AS x, p_partkey * 1.0 AS y FROM part),
rel AS (SELECT o_orderkey AS id, o_totalprice / 20 AS sx, CAST(o_custkey AS DOUBLE) AS sy, o_orderkey % 20 AS line, o_custkey % 1000 AS low, o_custkey % 1000 + 300 AS high, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 4 END AS step FROM orders),
p AS (SELECT id, point, sqrt((sx - x) ** 2 + (sy - y) ** 2) AS o FROM rel JOIN rcv ON rel.line = rcv.line AND point BETWEEN low AND high AND (point - low) % step = 0)
SELECT id, point AS receiver, round(o, 4) AS "offset" FROM p WHERE o > 6000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY point) = 1""")
def max_offset_check(spark, d):
    o = table(spark, d, "orders")
    receivers = table(spark, d, "part").select((F.col("p_partkey") % 20).alias("line"), F.col("p_partkey").alias("point"), (F.col("p_retailprice") * 10).alias("x"), (F.col("p_partkey") * 1.0).alias("y"))
    sources = o.select((F.col("o_orderkey") % 20).alias("line"), F.col("o_orderkey").alias("point"), (F.col("o_totalprice") / 20).alias("x"), F.col("o_custkey").cast("double").alias("y"))
    low = F.col("o_custkey") % 1000
    relations = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 20).alias("source_line"), F.col("o_orderkey").alias("source_point"), (F.col("o_orderkey") % 20).alias("receiver_line"), low.alias("low"), (low + 300).alias("high"), (F.col("o_orderkey") % 4).alias("step"))
    return reports.first_too_far(relations, sources, receivers, 6000.0).withColumn("offset", F.round("offset", 4))


@query("""SELECT o_orderkey, o_totalprice AS mtime, CAST(0 AS BIGINT) AS size, true AS deleted FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def tombstone_records(spark, d):
    dead = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    landed = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    records = reports.tombstone_records(reports.without_tombstone(dead, landed, "o_orderkey"), "o_orderkey", "o_totalprice")
    return reports.record_tombstones(records, "o_orderkey").join(records.select("o_orderkey", "size", "deleted"), "o_orderkey")


# Tables of 40 fields; names are parts' names, some without letters or with digits first.
@query("""WITH RECURSIVE c AS (SELECT p_partkey, p_partkey // 40 AS tab, CASE p_partkey % 13 WHEN 0 THEN '' WHEN 1 THEN '9-' || p_name ELSE p_name END AS name FROM part),
b AS (SELECT *, substr(regexp_replace(upper(name), '[^A-Z0-9_]', '_', 'g'), 1, 10) AS s FROM c),
f AS (SELECT p_partkey, tab, CASE WHEN s = '' THEN 'FIELD' WHEN regexp_matches(s, '^[0-9]') THEN substr('F' || s, 1, 10) ELSE s END AS base, row_number() OVER (PARTITION BY tab ORDER BY p_partkey) AS i FROM b),
r(tab, i, seen) AS (SELECT DISTINCT tab, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM f
  UNION ALL SELECT r.tab, r.i + 1, list_append(seen, list_filter(list_concat([base], list_transform(range(2, 1000), lambda n: substr(base, 1, CAST(10 - length(CAST(n AS VARCHAR)) AS INTEGER)) || CAST(n AS VARCHAR))), lambda x: NOT list_contains(seen, x))[1])
  FROM r JOIN f ON f.tab = r.tab AND f.i = r.i + 1)
SELECT p_partkey, f.base, seen[f.i] AS safe FROM f JOIN r ON r.tab = f.tab AND r.i = f.i""")
def dbf_names(spark, d):
    k = F.col("p_partkey") % 13
    c = table(spark, d, "part").select("p_partkey", F.floor(F.col("p_partkey") / 40).alias("tab"), F.when(k == 0, "").when(k == 1, F.concat(F.lit("9-"), "p_name")).otherwise(F.col("p_name")).alias("name"))
    return reports.dbf_names(c, "tab", "name", "p_partkey").select("p_partkey", "base", "safe")


@query("""WITH p AS (SELECT user_id AS line, event_id AS pos, value * CASE WHEN event_id % 97 = 0 THEN 60 ELSE 1 END AS x, event_id / 100.0::DOUBLE AS y, CASE WHEN event_id % 13 > 0 THEN event_id // 3 % 3000 END AS st, value * 30 - 600 AS h
  FROM events WHERE event_id % 500 > 0 OR user_id % 2 = 0 UNION ALL SELECT -1, -1, 0.0, 0.0, 1, 0.0),
s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d, last_value(st IGNORE NULLS) OVER (PARTITION BY line ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known,
  row_number() OVER w AS place, row_number() OVER (PARTITION BY line, st ORDER BY pos) AS seen, count(*) OVER (PARTITION BY line) AS size, count(*) FILTER (st IS NULL) OVER (PARTITION BY line) AS bare FROM p WINDOW w AS (PARTITION BY line ORDER BY pos)),
m AS (SELECT *, median(d) OVER (PARTITION BY line) AS mid FROM s), falls AS (SELECT line, min(pos) AS pos FROM s WHERE st < known GROUP BY line),
f AS (SELECT line, pos, CASE WHEN d <= 2 THEN 'coincident' WHEN d > 10 * mid THEN 'outlier' ELSE 'interval' END AS category, 1 AS n FROM m WHERE d <= 2 OR (mid > 0 AND (d > 10 * mid OR abs(d - mid) > 0.5::DOUBLE * mid))
  UNION ALL SELECT line, pos, 'dup-station', 1 FROM s WHERE st IS NOT NULL AND seen > 1 UNION ALL SELECT line, pos, 'monotonic', 1 FROM falls UNION ALL SELECT line, pos, 'elevation', 1 FROM s WHERE h < -500 OR h > 9000
  UNION ALL SELECT line, pos, 'short-line', 1 FROM s WHERE size < 2 UNION ALL SELECT line, pos, 'no-station', bare FROM s WHERE place = 1 AND bare > 0
  UNION ALL SELECT NULL, NULL, 'dup-station-cross', n FROM (SELECT count(*) AS n FROM (SELECT st FROM p WHERE st IS NOT NULL GROUP BY st HAVING count(DISTINCT line) > 1)) WHERE n > 0)
SELECT CAST(line AS BIGINT) AS line, CAST(pos AS BIGINT) AS pos, category, CAST(n AS BIGINT) AS n, CASE WHEN category IN ('short-line', 'coincident', 'dup-station', 'no-station') THEN 'error' WHEN category = 'dup-station-cross' THEN 'info' ELSE 'warn' END AS severity FROM f""")
def plan_check(spark, d):
    e = table(spark, d, "events").where("event_id % 500 > 0 OR user_id % 2 = 0")
    x = F.col("value") * F.when(F.col("event_id") % 97 == 0, 60).otherwise(1)
    points = e.select(F.col("user_id").cast("long").alias("line"), F.col("event_id").cast("long").alias("pos"), x.alias("x"), (F.col("event_id") / 100.0).alias("y"), F.when(F.col("event_id") % 13 > 0, F.floor(F.col("event_id") / 3) % 3000).cast("long").alias("st"),
                      (F.col("value") * 30 - 600).alias("h"))
    lone = spark.range(1).selectExpr("-1L AS line", "-1L AS pos", "0D AS x", "0D AS y", "1L AS st", "0D AS h")
    return survey.check_plan(points.unionByName(lone), "line", "pos", "x", "y", "st", "h", percent=50.0, same=2.0, preplot=True)
