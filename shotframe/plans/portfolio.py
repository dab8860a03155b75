"""The registered queries: each binds an operator to the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotframe.operators import geodesy, kernels, raster, survey, sync, text, traces, triggers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            # A rounded value of 0 has no sign in either engine.
            names = dict.fromkeys(re.findall(r", [46]\) AS (\w+)", sql))
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'{n} + 0.0::DOUBLE AS {n}' for n in names)}) FROM ({sql})" if names else sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in columns})


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# Fixed SQL parts: samples in long form, one row each.
LONG = "s AS (SELECT vec_id, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, generate_series(1, 64) g(i))"


@query(f"""WITH {LONG}, m AS (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS mu, max(abs(x)) OVER (PARTITION BY vec_id) AS pk,
  lag(sign(x)) OVER (PARTITION BY vec_id ORDER BY i) AS before FROM s),
r AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, abs(x) >= pk * 0.985 ORDER BY i) AS run, abs(x) >= pk * 0.985 AS high FROM m),
runs AS (SELECT vec_id, max(n) AS rail_run FROM (SELECT vec_id, run, count(*) AS n FROM r WHERE high GROUP BY vec_id, run) GROUP BY vec_id)
SELECT vec_id, count(*) AS n_samples, round(sqrt(sum(x * x) / count(*)), 6) AS rms, round(max(abs(x)), 6) AS peak, round(sqrt(sum((x - mu) * (x - mu)) / count(*)), 6) AS std,
  count(*) FILTER (before IS NOT NULL AND before <> sign(x)) AS crossings, round(count(*) FILTER (before IS NOT NULL AND before <> sign(x)) / 63.0, 6) AS crossing_rate,
  round(list_sort(list(abs(x)))[60], 6) AS norm_p95, any_value(rail_run) AS rail_run FROM m JOIN runs USING (vec_id) GROUP BY vec_id""")
def trace_evidence(spark, d):
    out = traces.evidence(table(spark, d, "embeddings"), "vec_id", "embedding").drop("mean")
    return rounded(out, "rms", "peak", "std", "crossing_rate", "norm_p95")


@query(f"""WITH {LONG}, e AS (SELECT vec_id, any_value(label) AS label, max(abs(x)) AS peak FROM s GROUP BY vec_id),
c AS (SELECT label, median(peak) AS centre FROM e GROUP BY label), m AS (SELECT label, median(abs(peak - centre)) AS mad FROM e JOIN c USING (label) GROUP BY label)
SELECT vec_id, label, round(peak, 6) AS peak, round(CASE WHEN mad > 0 THEN (peak - centre) / (1.4826::DOUBLE * mad) ELSE 0 END, 6) AS z, round(peak / centre, 6) AS ratio FROM e JOIN c USING (label) JOIN m USING (label)""")
def trace_health_scores(spark, d):
    # The tables' traces have unit energy, so their peaks are scored.
    e = table(spark, d, "embeddings").select("vec_id", "label", traces.peak(traces.as_doubles(F.col("embedding"))).alias("peak"))
    out = survey.robust_z(e, "peak", "label").withColumn("ratio", F.col("peak") / F.col("centre"))
    return rounded(out.select("vec_id", "label", "peak", "z", "ratio"), "peak", "z", "ratio")


def _records(spark, d):
    """The tables' traces as records of 240, some of them stilled, faint, loud or held at a rail."""
    k = F.col("vec_id") % 40
    gain = F.when(k == 0, 0.001).when(k == 1, 0.2).when(k == 2, 8.0).otherwise(1 + F.col("vec_id") % 7 / 20)
    x = F.transform(traces.as_doubles(F.col("embedding")), lambda v: F.when((k == 3) & (F.abs(v) > 0.05), F.signum(v) * 0.05).otherwise(v * F.when(k == 3, 1.0).otherwise(gain)))
    return table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 240).alias("record"), x.alias("samples"))


@query("""WITH s AS (SELECT vec_id, vec_id // 240 AS record, i, CASE vec_id % 40 WHEN 0 THEN v * 0.001::DOUBLE WHEN 1 THEN v * 0.2::DOUBLE WHEN 2 THEN v * 8.0::DOUBLE
  WHEN 3 THEN greatest(least(v, 0.05::DOUBLE), -0.05::DOUBLE) ELSE v * (1 + vec_id % 7 / 20.0::DOUBLE) END AS x FROM (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, generate_series(1, 64) g(i))),
m AS (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS mu, max(abs(x)) OVER (PARTITION BY vec_id) AS pk, lag(sign(x)) OVER (PARTITION BY vec_id ORDER BY i) AS before FROM s),
r AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id, abs(x) >= pk * 0.985::DOUBLE ORDER BY i) AS run, abs(x) >= pk * 0.985::DOUBLE AS high FROM m),
runs AS (SELECT vec_id, max(n) AS rail FROM (SELECT vec_id, run, count(*) AS n FROM r WHERE high GROUP BY vec_id, run) GROUP BY vec_id),
e AS (SELECT vec_id, any_value(record) AS record, sqrt(avg(x * x)) AS rms, sqrt(avg((x - mu) * (x - mu))) / max(pk) AS flat, count(*) FILTER (before IS NOT NULL AND before <> sign(x)) / 63.0::DOUBLE AS zcr, any_value(rail) / 64.0::DOUBLE AS railed
  FROM m JOIN runs USING (vec_id) GROUP BY vec_id),
w AS (SELECT *, median(rms) OVER (PARTITION BY record) AS whole, list(rms) OVER (PARTITION BY record ORDER BY vec_id ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING EXCLUDE CURRENT ROW) AS near FROM e),
l AS (SELECT *, coalesce(list_aggregate(near, 'median'), whole) AS mid FROM w),
z AS (SELECT *, rms / mid AS q, (rms - mid) / greatest(1.4826::DOUBLE * coalesce(list_aggregate(list_transform(near, lambda v: abs(v - mid)), 'median'), 0), 0.05::DOUBLE * whole) AS z FROM l),
f AS (SELECT *, flat <= 0.01 OR (len(near) >= 3 AND q < 0.08) AS dead, greatest(1 - flat / 0.01::DOUBLE, CASE WHEN len(near) >= 3 THEN 1 - q / 0.08::DOUBLE END, 0) AS dead_by, railed >= 0.03 AS clipped, least(railed / 0.06::DOUBLE, 1) AS clipped_by,
  z >= 8 AND zcr >= 0.34 AS noisy, least(z / 8 - 1, 1) AS noisy_by, (z >= 6 AND q >= 2.5) OR (z <= -6 AND q <= 0.4) AS amp, least(abs(z) / 6 - 1, 1) AS amp_by FROM z),
t AS (SELECT vec_id, z, q, CASE WHEN dead THEN 'dead' ELSE concat_ws(',', CASE WHEN clipped THEN 'clipped' END, CASE WHEN noisy THEN 'noisy' END, CASE WHEN amp THEN 'amp' END) END AS detectors,
  dead, dead_by, CASE WHEN clipped THEN clipped_by ELSE -1 END AS c, CASE WHEN noisy THEN noisy_by ELSE -1 END AS n, CASE WHEN amp THEN amp_by ELSE -1 END AS a FROM f)
SELECT vec_id, detectors, CASE WHEN dead THEN 'dead' WHEN greatest(c, n, a) < 0 THEN 'good' WHEN c >= greatest(n, a) - 1e-9 THEN 'clipped' WHEN n >= a - 1e-9 THEN 'noisy' ELSE 'amp' END AS class,
  round(CASE WHEN dead THEN dead_by ELSE greatest(c, n, a, 0) END, 6) AS severity, round(z, 6) AS z, round(q, 6) AS ratio FROM t""")
def trace_classes(spark, d):
    scored = traces.neighbour_scores(traces.evidence(_records(spark, d), "vec_id", "samples", "record"), "record", "vec_id")
    out = traces.classify(scored).select("vec_id", F.array_join("detectors", ",").alias("detectors"), "class", "severity", F.col("rms_z").alias("z"), "ratio")
    return rounded(out, "severity", "z", "ratio")


@query(f"""WITH {LONG} SELECT vec_id, round(list_sort(list(abs(x)))[60], 6) AS norm FROM s GROUP BY vec_id""")
def trace_norm_p95(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.round(traces.norm_percentile(traces.as_doubles(F.col("embedding"))), 6) + 0.0).alias("norm"))


@query(f"""WITH {LONG}, n AS (SELECT vec_id, any_value(label) AS label, list_sort(list(abs(x)))[60] AS norm FROM s GROUP BY vec_id),
l AS (SELECT label, list_sort(list(norm)) AS xs FROM n WHERE norm > 0 GROUP BY label) SELECT label, round(xs[CAST(floor(0.95 * (len(xs) - 1) + 0.5) AS BIGINT) + 1], 6) AS norm FROM l""")
def norm_across_traces(spark, d):
    norms = table(spark, d, "embeddings").select("label", traces.norm_percentile(traces.as_doubles(F.col("embedding"))).alias("norm")).where("norm > 0")
    ranked = norms.groupBy("label").agg(F.sort_array(F.collect_list("norm")).alias("xs"))
    return ranked.select("label", F.round(F.element_at("xs", traces.js_round(0.95 * (F.size("xs") - 1)).cast("int") + 1), 6).alias("norm"))


def _agc(kind: str):
    level = {"rms": "sqrt(avg(x * x) OVER w)", "mean": "avg(abs(x)) OVER w", "median": "list_sort(list(abs(x)) OVER w)[CAST(floor(len(list(abs(x)) OVER w) / 2) AS BIGINT) + 1]"}[kind]

    def run(spark, d):
        out = traces.automatic_gain(table(spark, d, "embeddings"), "vec_id", "embedding", 5, kind)
        return rounded(out.select("vec_id", "i", "gained"), "gained")

    run.__name__ = f"agc_{kind}"
    query(f"""WITH {LONG}, l AS (SELECT vec_id, i, x, {level} AS level FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT vec_id, CAST(i AS INTEGER) AS i, round(CASE WHEN level > 1e-10 THEN x / level ELSE 0 END, 6) AS gained FROM l""")(run)


for _kind in ("rms", "mean", "median"):
    _agc(_kind)


@query(f"""WITH {LONG}, e AS (SELECT vec_id, i, avg(x * x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS st,
  avg(x * x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 14 PRECEDING AND 3 PRECEDING) AS lt, greatest(1e-4 * avg(x * x) OVER (PARTITION BY vec_id), 1e-12) AS fl FROM s)
SELECT vec_id, min(i) FILTER (i >= 7 AND st / greatest(lt, fl) >= 2.5) AS pick FROM e GROUP BY vec_id""")
def sta_lta_pick(spark, d):
    return traces.sta_lta(table(spark, d, "embeddings"), "vec_id", "embedding", 3, 12, 2.5)


@query(f"""WITH {LONG} SELECT vec_id, CAST(floor(i / 8) AS INTEGER) AS bucket, round(min(x), 6) AS low, round(max(x), 6) AS high FROM s GROUP BY vec_id, floor(i / 8)""")
def decimate_minmax(spark, d):
    pairs = traces.decimate(traces.as_doubles(F.col("embedding")), 16)
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(pairs).alias("bucket", "p"))
    return rounded(rows.select("vec_id", "bucket", "p.low", "p.high"), "low", "high")


def _gain(name: str, expression, sql: str):
    def run(spark, d):
        rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(expression(traces.as_doubles(F.col("embedding")))).alias("i", "y"))
        return rounded(rows, "y")

    run.__name__ = name
    query(f"WITH {LONG} SELECT vec_id, CAST(i AS INTEGER) AS i, round({sql}, 6) AS y FROM s")(run)


_gain("gain_tpow", lambda x: traces.gain_tpow(x, 0.002, 0.0, 1.5), "CASE WHEN i > 0 THEN x * pow(i * 0.002, 1.5) ELSE 0 END")
_gain("gain_epow", lambda x: traces.gain_epow(x, 0.002, 0.0, 3.0), "CASE WHEN i > 0 THEN x * exp(3.0 * (i * 0.002)) ELSE x END")
_gain("gain_gpow", lambda x: traces.gain_gpow(x, 0.5), "sign(x) * pow(abs(x), 0.5)")
_gain("gain_fixed", lambda x: traces.gain_fixed(x, 2.5), "x * 2.5")
_gain("gain_pbal", traces.gain_balance, "x / sqrt(avg(x * x) OVER (PARTITION BY vec_id))")


@query(f"""WITH {LONG}, t AS (SELECT vec_id, list(x ORDER BY i) AS xs FROM s GROUP BY vec_id), p AS (SELECT vec_id, i, xs, i + ((vec_id % 40) * 25.0) / 2000.0 / 0.01 AS place FROM t, generate_series(0, 63) g(i))
SELECT vec_id, CAST(i AS INTEGER) AS i, round(CASE WHEN floor(place) >= 64 THEN 0 ELSE coalesce(xs[CAST(floor(place) AS BIGINT) + 1], 0) + (coalesce(xs[CAST(floor(place) AS BIGINT) + 2], 0) - coalesce(xs[CAST(floor(place) AS BIGINT) + 1], 0)) * (place - floor(place)) END, 6) AS y FROM p""")
def reduced_time(spark, d):
    y = traces.reduced_time(traces.as_doubles(F.col("embedding")), (F.col("vec_id") % 40) * 25.0, 2.0, 0.01)
    return rounded(table(spark, d, "embeddings").select("vec_id", F.posexplode(y).alias("i", "y")), "y")


@query(f"""WITH {LONG}, t AS (SELECT vec_id, list(x ORDER BY i) AS xs FROM s GROUP BY vec_id), p AS (SELECT vec_id, i, xs, i * (63 / 99.0) AS place FROM t, generate_series(0, 99) g(i)),
q AS (SELECT vec_id, i, xs, place, least(CAST(floor(place) AS BIGINT), 63) AS lo FROM p)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(xs[lo + 1] + (xs[least(lo + 1, 63) + 1] - xs[lo + 1]) * (place - lo), 6) AS y FROM q""")
def resample_linear(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", F.posexplode(traces.resample(traces.as_doubles(F.col("embedding")), 100)).alias("i", "y")), "y")


def _pairs(spark, d):
    """Each trace with the next one of its label."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").withColumns({"b": F.lead("vec_id").over(w), "eb": F.lead("embedding").over(w)}).where("b IS NOT NULL")


NEXT = "n AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), j AS (SELECT n.vec_id, n.b, p.i, p.x AS xa, q.x AS xb FROM n JOIN s p ON p.vec_id = n.vec_id JOIN s q ON q.vec_id = n.b AND q.i = p.i)"


@query(f"""WITH {LONG}, {NEXT} SELECT vec_id, b, round(sqrt(avg(xa * xa)), 6) AS rms_a, round(sqrt(avg(xb * xb)), 6) AS rms_b, round(sqrt(avg((xa - xb) * (xa - xb))), 6) AS rms_diff, round(CASE WHEN avg(xa * xa) > 0 THEN sqrt(avg(xb * xb)) / sqrt(avg(xa * xa)) ELSE 0 END, 6) AS gain_ratio FROM j GROUP BY vec_id, b""")
def trace_difference(spark, d):
    p = _pairs(spark, d)
    out = traces.difference(p.select("vec_id", "b", "embedding"), p.select("vec_id", "b", F.col("eb").alias("embedding")), ["vec_id", "b"], "embedding")
    return rounded(out, "rms_a", "rms_b", "rms_diff", "gain_ratio")


@query(f"""WITH {LONG}, n AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
c AS (SELECT n.vec_id, n.b, p.i - q.i AS lag, sum(p.x * q.x) AS v FROM n JOIN s p ON p.vec_id = n.vec_id JOIN s q ON q.vec_id = n.b GROUP BY n.vec_id, n.b, p.i - q.i),
e AS (SELECT vec_id, sum(x * x) AS e FROM s GROUP BY vec_id), k AS (SELECT c.vec_id, c.b, lag, v / sqrt(a.e * z.e) AS v FROM c JOIN e a ON a.vec_id = c.vec_id JOIN e z ON z.vec_id = c.b)
SELECT vec_id, b, CAST(arg_max(lag, (round(abs(v), 9), -lag)) AS INTEGER) AS lag, round(arg_max(v, (round(abs(v), 9), -lag)), 6) AS coefficient FROM k GROUP BY vec_id, b""")
def trace_xcorr_best_lag(spark, d):
    out = _pairs(spark, d).select("vec_id", "b", kernels.cross_correlation(F.col("embedding"), F.col("eb")).alias("c"))
    return rounded(out.select("vec_id", "b", "c.lag", "c.coefficient"), "coefficient")


DFT = f"""{LONG}, w AS (SELECT vec_id, label, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 63)) AS y FROM s),
f AS (SELECT vec_id, any_value(label) AS label, k, sum(y * cos(2 * pi() * k * i / 64)) AS re, sum(y * sin(2 * pi() * k * i / 64)) AS im FROM w, generate_series(0, 31) g(k) GROUP BY vec_id, k),
a AS (SELECT vec_id, label, k, sqrt(re * re + im * im) / 31.5 * CASE WHEN k = 0 THEN 1 ELSE 2 END AS v FROM f)"""


@query(f"WITH {DFT} SELECT vec_id, CAST(k AS INTEGER) AS bin, round(v, 6) AS amplitude FROM a")
def amplitude_spectrum(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", F.posexplode(kernels.amplitude_spectrum(F.col("embedding"))).alias("bin", "amplitude")), "amplitude")


@query(f"WITH {DFT} SELECT label, CAST(k AS INTEGER) AS bin, round(avg(v), 6) AS amplitude FROM a GROUP BY label, k")
def avg_spectrum(spark, d):
    return rounded(kernels.average_spectrum(table(spark, d, "embeddings"), "embedding", "label"), "amplitude")


@query(f"""WITH {LONG}, v AS (SELECT unnest([1500.0, 2000.0, 2500.0, 3000.0]) AS velocity), t AS (SELECT vec_id, label, list(x ORDER BY i) AS xs, abs((vec_id % 24) * 25.0) AS o FROM s GROUP BY vec_id, label),
k AS (SELECT label, velocity, i, xs[CAST(floor(sqrt((i * 0.004::DOUBLE) * (i * 0.004::DOUBLE) + pow(o::DOUBLE / velocity::DOUBLE, 2)) / 0.004::DOUBLE + 0.5) AS BIGINT) + 1] AS a FROM t, v, generate_series(0, 63) g(i))
SELECT label, velocity, CAST(i AS INTEGER) AS i, round(CASE WHEN sum(a * a) > 1e-10 THEN sum(a) * sum(a) / (count(a) * sum(a * a)) ELSE 0 END, 6) AS value FROM k WHERE a IS NOT NULL GROUP BY label, velocity, i""")
def semblance(spark, d):
    gathers = table(spark, d, "embeddings").withColumn("offset", (F.col("vec_id") % 24) * 25.0)
    return rounded(traces.semblance(gathers, "label", "offset", "embedding", 0.004, [1500.0, 2000.0, 2500.0, 3000.0]), "value")


@query(f"""WITH {LONG}, t AS (SELECT vec_id, any_value(label) AS label, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, -sum(x * sin(2 * pi() * k * i / 64)) AS im FROM s, generate_series(0, 31) g(k) GROUP BY vec_id, k),
n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS j, CAST(pow(2, ceil(log2(count(*) OVER (PARTITION BY label)))) AS BIGINT) AS nx FROM embeddings),
w AS (SELECT label, nx, unnest(generate_series(-(nx // 2), nx - nx // 2 - 1)) AS kx FROM (SELECT DISTINCT label, nx FROM n)),
z AS (SELECT n.label, w.kx, t.k, sum(re * cos(2 * pi() * kx * j / n.nx) + im * sin(2 * pi() * kx * j / n.nx)) AS a, sum(im * cos(2 * pi() * kx * j / n.nx) - re * sin(2 * pi() * kx * j / n.nx)) AS b FROM n JOIN t ON t.vec_id = n.vec_id JOIN w ON w.label = n.label GROUP BY n.label, w.kx, t.k)
SELECT label, CAST(kx AS INTEGER) AS kx, CAST(k AS INTEGER) AS f, round(sqrt(a * a + b * b), 6) AS amplitude FROM z""")
def fk_spectrum(spark, d):
    return rounded(kernels.fk_spectrum(table(spark, d, "embeddings"), "label", "vec_id", "embedding", "int"), "amplitude")


ANALYTIC = f"""{LONG}, f AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, -sum(x * sin(2 * pi() * k * i / 64)) AS im, CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS m FROM s, generate_series(0, 32) g(k) GROUP BY vec_id, k),
z AS (SELECT vec_id, i, sum(m * (re * cos(2 * pi() * k * i / 64) - im * sin(2 * pi() * k * i / 64))) / 64 AS a, sum(m * (re * sin(2 * pi() * k * i / 64) + im * cos(2 * pi() * k * i / 64))) / 64 AS b FROM f, generate_series(0, 63) h(i) GROUP BY vec_id, i)"""


@query(f"WITH {ANALYTIC} SELECT vec_id, CAST(i AS INTEGER) AS i, round(sqrt(a * a + b * b), 6) AS y FROM z")
def trace_envelope(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", F.posexplode(kernels.envelope(F.col("embedding"))).alias("i", "y")), "y")


@query(f"""WITH {ANALYTIC}, p AS (SELECT vec_id, i, atan2(b, a) AS p, atan2(b, a) - lag(atan2(b, a)) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM z)
SELECT vec_id, CAST(i AS INTEGER) AS i, round(p + sum(CASE WHEN d > pi() THEN -2 * pi() WHEN d < -pi() THEN 2 * pi() ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i), 6) AS y FROM p""")
def trace_phase(spark, d):
    return rounded(table(spark, d, "embeddings").select("vec_id", F.posexplode(kernels.instantaneous_phase(F.col("embedding"))).alias("i", "y")), "y")


@query(f"""WITH {LONG}, y AS (SELECT vec_id, frame, i - frame * 16 AS j, x * (0.5 - 0.5 * cos(2 * pi() * (i - frame * 16) / 31)) AS v FROM s, generate_series(0, 2) f(frame) WHERE i >= frame * 16 AND i < frame * 16 + 32),
t AS (SELECT vec_id, frame, k, sum(v * cos(2 * pi() * k * j / 32)) AS re, sum(v * sin(2 * pi() * k * j / 32)) AS im FROM y, generate_series(0, 15) g(k) GROUP BY vec_id, frame, k)
SELECT vec_id, CAST(frame AS INTEGER) AS frame, CAST(k AS INTEGER) AS bin, round(sqrt(re * re + im * im), 6) AS magnitude FROM t""")
def spectrogram(spark, d):
    frames = table(spark, d, "embeddings").select("vec_id", F.posexplode(kernels.spectrogram(F.col("embedding"), 32, 16)).alias("frame", "m"))
    return rounded(frames.select("vec_id", "frame", F.posexplode("m").alias("bin", "magnitude")), "magnitude")


@query("""WITH w AS (SELECT event_id, user_id, value, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING EXCLUDE CURRENT ROW) AS near FROM events)
SELECT event_id, round(list_median(near), 6) AS local_median, round(list_median(list_transform(near, lambda v: abs(v - list_median(near)))), 6) AS local_mad FROM w""")
def local_median_mad(spark, d):
    out = survey.local_median(events(spark, d), "user_id", ["ts", "event_id"], "value", 6)
    return rounded(out.select("event_id", "local_median", "local_mad"), "local_median", "local_mad")


@query("""WITH c AS (SELECT event_type, median(value) AS centre FROM events GROUP BY event_type), m AS (SELECT event_type, median(abs(value - centre)) AS mad FROM events JOIN c USING (event_type) GROUP BY event_type)
SELECT event_id, event_type, round(CASE WHEN mad > 0 THEN (value - centre) / (1.4826 * mad) ELSE 0 END, 6) AS z FROM events JOIN c USING (event_type) JOIN m USING (event_type)""")
def robust_zscore(spark, d):
    return rounded(survey.robust_z(events(spark, d), "value", "event_type").select("event_id", "event_type", "z"), "z")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, nth FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber) AS nth FROM lineitem) WHERE nth > 1""")
def qc_duplicates(spark, d):
    rows = survey.duplicates(table(spark, d, "lineitem"), ["l_suppkey", "l_shipdate"], ["l_orderkey", "l_linenumber"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("nth").cast("long").alias("nth"))


STEP = "s AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)"


@query(f"WITH {STEP} SELECT event_id, user_id, round(step, 6) AS step FROM s WHERE abs(step) > 60")
def qc_gaps(spark, d):
    return rounded(survey.gaps(events(spark, d), "user_id", ["ts", "event_id"], "value", 60.0).select("event_id", "user_id", "step"), "step")


@query(f"WITH {STEP} SELECT event_id, user_id, round(step, 6) AS step FROM s WHERE abs(abs(step) - 25) > 20")
def qc_interval(spark, d):
    return rounded(survey.interval_findings(events(spark, d), "user_id", ["ts", "event_id"], "value", 25.0, 20.0).select("event_id", "user_id", "step"), "step")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'O')")
def qc_missing_source(spark, d):
    sources = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return survey.missing(table(spark, d, "lineitem"), sources, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("""WITH e AS (SELECT o_custkey % 100 AS line, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY o_custkey % 100),
x AS (SELECT l_orderkey, l_linenumber, l_partkey % 120 AS line, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 120 END AS other, l_orderkey - l_linenumber * 500 AS a, l_orderkey + l_linenumber * 500 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, x.line FROM x LEFT JOIN e f ON f.line = x.line LEFT JOIN e t ON t.line = coalesce(x.other, x.line) WHERE a < f.lo OR b > t.hi""")
def qc_range_check(spark, d):
    other = F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey") % 120)
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 120).alias("line"), other.alias("other"), (F.col("l_orderkey") - F.col("l_linenumber") * 500).alias("a"), (F.col("l_orderkey") + F.col("l_linenumber") * 500).alias("b"))
    return survey.range_check(x, table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("line"), "o_orderkey"), "line", "other", "a", "b", "o_orderkey").select("l_orderkey", "l_linenumber", "line")


@query("SELECT user_id, event_type, count(*) AS times, min(event_id) AS first FROM events GROUP BY user_id, event_type")
def qc_collapse(spark, d):
    return survey.collapse(table(spark, d, "events"), ["user_id", "event_type"], "event_id")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -500 OR c_acctbal > 8849")
def qc_elevation(spark, d):
    return table(spark, d, "customer").where("c_acctbal < -500 OR c_acctbal > 8849").select("c_custkey", "c_acctbal")


def _relations(spark, d):
    """orders as relations: a shot and a range of receivers."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", (F.col("o_custkey") % 1000).alias("src"), (F.col("o_orderkey") % 80).alias("a"), (F.col("o_orderkey") % 80 + 7).alias("b"))


X_SQL = """x AS (SELECT o_orderkey, o_custkey % 1000 AS src, unnest(generate_series(o_orderkey % 80, o_orderkey % 80 + 7)) AS point FROM orders),
m AS (SELECT o_orderkey, point, (c_custkey * 37 % 5000 + s_suppkey * 53 % 5000) / 2.0 AS mx, (c_custkey * 91 % 3000 + s_suppkey * 17 % 3000) / 2.0 AS my FROM x JOIN customer ON c_custkey = src JOIN supplier ON s_suppkey = point)"""


def _midpoints(spark, d):
    x = survey.expand(_relations(spark, d), "a", "b", F.lit(1))
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") * 37 % 5000).cast("double").alias("sx"), (F.col("c_custkey") * 91 % 3000).cast("double").alias("sy"))
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("point"), (F.col("s_suppkey") * 53 % 5000).cast("double").alias("rx"), (F.col("s_suppkey") * 17 % 3000).cast("double").alias("ry"))
    return survey.midpoints(x, s, r, ["src"], ["point"])


@query(f"WITH {X_SQL}, o AS (SELECT min(mx) AS x0, min(my) AS y0 FROM m) SELECT CAST(floor((mx - x0) / 50) AS BIGINT) AS ix, CAST(floor((my - y0) / 50) AS BIGINT) AS iy, count(*) AS fold FROM m, o GROUP BY 1, 2")
def fold_map(spark, d):
    return survey.fold(_midpoints(spark, d), "mx", "my", 50.0, 50.0)


@query(f"WITH {X_SQL} SELECT o_orderkey, point, mx, my FROM m")
def xref_spider(spark, d):
    return _midpoints(spark, d).select("o_orderkey", "point", "mx", "my")


def _plan_and_laid(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("line"), F.floor(F.col("o_orderkey") / 3).alias("point"), F.col("o_orderkey").alias("ord"), (F.col("o_totalprice") % 997).alias("x"), (F.col("o_custkey") % 991).cast("double").alias("y"))
    return o.where("ord % 7 <> 0"), o.where("ord % 5 <> 0").withColumn("x", F.col("x") + F.col("ord") % 4)


SKID = """p AS (SELECT o_custkey % 50 AS line, CAST(floor(o_orderkey / 3) AS BIGINT) AS point, o_orderkey AS ord, o_totalprice % 997 AS x, CAST(o_custkey % 991 AS DOUBLE) AS y FROM orders),
f AS (SELECT line, point, arg_min(x, ord) AS px, arg_min(y, ord) AS py FROM p WHERE ord % 7 <> 0 GROUP BY line, point),
k AS (SELECT coalesce(l.line, f.line) AS line, coalesce(l.point, f.point) AS point, max(sqrt((l.x - px) ** 2 + (l.y - py) ** 2)) AS distance, bool_or(l.line IS NOT NULL) AS laid, bool_or(f.line IS NOT NULL) AS planned
  FROM (SELECT line, point, x + ord % 4 AS x, y FROM p WHERE ord % 5 <> 0) l FULL JOIN f ON l.line = f.line AND l.point = f.point GROUP BY 1, 2)"""


@query(f"WITH {SKID} SELECT line, point, CASE WHEN laid AND planned THEN 'matched' WHEN laid THEN 'added' ELSE 'missing' END AS status, round(distance, 6) AS distance, coalesce(distance > 1, false) AS over FROM k")
def skid_report(spark, d):
    plan, laid = _plan_and_laid(spark, d)
    return rounded(survey.skid(laid, plan, ["line", "point"], "x", "y", "ord", 1.0), "distance")


@query(f"""WITH {SKID} SELECT count(*) FILTER (laid AND planned) AS matched, count(*) FILTER (laid AND NOT planned) AS added, count(*) FILTER (NOT laid) AS missing, count(*) FILTER (distance > 1) AS over,
round(max(distance), 6) AS largest, round(avg(distance), 6) AS mean, round(quantile_disc(distance, 0.95), 6) AS p95 FROM k""")
def skid_summary(spark, d):
    plan, laid = _plan_and_laid(spark, d)
    return rounded(survey.skid_summary(survey.skid(laid, plan, ["line", "point"], "x", "y", "ord", 1.0)), "largest", "mean", "p95")


def _manifests(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("rel_path"), F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 100).cast("double").alias("mtime"))
    return o.where("k % 3 <> 0").select("rel_path", "mtime", (F.col("k") % 11 == 0).alias("deleted")), o.where("k % 4 <> 0").select("rel_path", (F.col("mtime") + F.col("k") % 6).alias("mtime"), (F.col("k") % 13 == 0).alias("deleted"))


MANIFESTS = """b AS (SELECT CAST(o_orderkey AS VARCHAR) AS rel_path, o_orderkey AS k, CAST(o_custkey % 100 AS DOUBLE) AS mtime FROM orders),
l AS (SELECT rel_path, mtime, k % 11 = 0 AS del FROM b WHERE k % 3 <> 0), r AS (SELECT rel_path, mtime + k % 6 AS mtime, k % 13 = 0 AS del FROM b WHERE k % 4 <> 0),
j AS (SELECT coalesce(l.rel_path, r.rel_path) AS rel_path, l.mtime AS lm, r.mtime AS rm, l.rel_path IS NOT NULL AS hl, r.rel_path IS NOT NULL AS hr, l.rel_path IS NOT NULL AND NOT l.del AS ll, r.rel_path IS NOT NULL AND NOT r.del AS lr FROM l FULL JOIN r ON l.rel_path = r.rel_path)"""


@query(f"""WITH {MANIFESTS}, a AS (SELECT rel_path, CASE WHEN NOT hr THEN NULL WHEN NOT hl THEN CASE WHEN lr THEN 'pull' END WHEN rm - lm > 2 THEN CASE WHEN NOT lr THEN CASE WHEN ll THEN 'delete' END ELSE 'pull' END WHEN NOT ll AND lr AND rm > lm THEN 'pull' END AS action FROM j)
SELECT rel_path, action FROM a WHERE action IS NOT NULL""")
def manifest_diff_both(spark, d):
    local, remote = _manifests(spark, d)
    return sync.guard(sync.diff(local, remote, "both"), remote)


@query(f"""WITH {MANIFESTS}, a AS (SELECT rel_path, CASE WHEN NOT lr AND ll THEN 'delete' WHEN lr AND (NOT ll OR abs(rm - lm) > 2) THEN 'pull' END AS action FROM j) SELECT rel_path, action FROM a WHERE action IS NOT NULL""")
def manifest_diff_slave(spark, d):
    local, remote = _manifests(spark, d)
    return sync.guard(sync.diff(local, remote, "slave"), remote)


@query(f"""WITH {MANIFESTS} SELECT rel_path, mtime, del AS deleted FROM r UNION ALL SELECT rel_path, mtime, del FROM l WHERE rel_path NOT IN (SELECT rel_path FROM r)""")
def manifest_overlay(spark, d):
    local, remote = _manifests(spark, d)
    return sync.overlay(local, remote)


def _placed(spark, d, name, key):
    return table(spark, d, name).select(F.col(key), (F.col(key) * 7919 % 10007).cast("double").alias("x"), (F.col(key) * 104729 % 10009).cast("double").alias("y"))


@query("""WITH c AS (SELECT c_custkey, CAST(c_custkey * 7919 % 10007 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 10009 AS DOUBLE) AS y FROM customer), s AS (SELECT s_suppkey, CAST(s_suppkey * 7919 % 10007 AS DOUBLE) AS x, CAST(s_suppkey * 104729 % 10009 AS DOUBLE) AS y FROM supplier),
j AS (SELECT c_custkey, s_suppkey, sqrt((c.x - s.x) ** 2 + (c.y - s.y) ** 2) AS distance FROM c JOIN s ON abs(c.x - s.x) <= 400 AND abs(c.y - s.y) <= 400)
SELECT c_custkey, arg_min(s_suppkey, (distance, s_suppkey)) AS s_suppkey, round(min(distance), 6) AS distance FROM j WHERE distance <= 400 GROUP BY c_custkey""")
def spatial_nearest(spark, d):
    return rounded(survey.nearest(_placed(spark, d, "customer", "c_custkey"), _placed(spark, d, "supplier", "s_suppkey"), "c_custkey", "s_suppkey", "x", "y", 400.0), "distance")


@query("""WITH s AS (SELECT s_suppkey, s_acctbal AS v, CAST(s_suppkey * 7919 % 10007 AS DOUBLE) AS x, CAST(s_suppkey * 104729 % 10009 AS DOUBLE) AS y FROM supplier), g AS (SELECT ix, iy, (ix + 0.5) * 500 AS cx, (iy + 0.5) * 500 AS cy FROM generate_series(0, 19) a(ix), generate_series(0, 19) b(iy)),
j AS (SELECT ix, iy, v, (cx - x) ** 2 + (cy - y) ** 2 AS d2, row_number() OVER (PARTITION BY ix, iy ORDER BY (cx - x) ** 2 + (cy - y) ** 2, s_suppkey) AS nth FROM g JOIN s ON (cx - x) ** 2 + (cy - y) ** 2 <= 1500.0 * 1500.0)
SELECT ix, iy, round(sum(v / d2) / sum(1 / d2), 6) AS value FROM j WHERE nth <= 12 GROUP BY ix, iy""")
def idw_surface(spark, d):
    points = _placed(spark, d, "supplier", "s_suppkey").join(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey")
    return rounded(raster.inverse_distance(points, "s_suppkey", "x", "y", "s_acctbal", raster.cells(spark, 20, 20), 0.0, 0.0, 500.0, 1500.0), "value")


@query("""WITH n AS (SELECT CAST(floor(user_id / 10) AS BIGINT) AS ix, CAST(floor(value / 10) AS BIGINT) AS iy, count(*) AS n FROM events GROUP BY 1, 2) SELECT ix, iy, coalesce(n, 0) AS n FROM (SELECT ix, iy FROM generate_series(0, 19) a(ix), generate_series(0, 19) b(iy)) g LEFT JOIN n USING (ix, iy)""")
def raster_counts(spark, d):
    points = table(spark, d, "events").select(F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
    return raster.counts(points, "x", "y", 0.0, 0.0, 10.0, 20, 20)


@query("""WITH s AS (SELECT s_suppkey, CAST(s_suppkey * 7919 % 10007 AS DOUBLE) AS x, CAST(s_suppkey * 104729 % 10009 AS DOUBLE) AS y FROM supplier) SELECT a.s_suppkey, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS gap FROM s a JOIN s b ON a.s_suppkey <> b.s_suppkey
WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2000 GROUP BY a.s_suppkey""")
def station_spacing(spark, d):
    return rounded(raster.nearest_spacing(_placed(spark, d, "supplier", "s_suppkey"), "s_suppkey", "x", "y", 2000.0), "gap")


@query("""WITH u AS (SELECT 0 AS side, o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey, o_custkey, o_orderstatus FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY side, o_orderkey) = 1""")
def merge_distinct(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return survey.merge_distinct(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("SELECT role, CAST(100 + (dense_rank() OVER (ORDER BY role) - 1) * 10 AS INTEGER) AS new_line FROM (SELECT DISTINCT role FROM conversations)")
def renumber_lines(spark, d):
    return survey.renumber_lines(table(spark, d, "conversations"), "role", 100, 10).withColumn("new_line", F.col("new_line").cast("int"))


@query("SELECT conv_id, turn, CAST(1000 + (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) * 5 AS INTEGER) AS new_point FROM conversations")
def renumber_points(spark, d):
    return survey.renumber_points(table(spark, d, "conversations"), "conv_id", ["turn", "role", "text"], 1000, 5).select("conv_id", "turn", F.col("new_point").cast("int").alias("new_point"))


@query("""WITH s AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events)
SELECT user_id, count(*) AS points, round(sum(step), 6) AS length, round(min(step), 6) AS smallest, round(median(step), 6) AS median, round(max(step), 6) AS largest FROM s GROUP BY user_id""")
def plan_line_statistics(spark, d):
    return rounded(survey.line_statistics(events(spark, d), "user_id", ["ts", "event_id"], "value"), "length", "smallest", "median", "largest")


@query("""WITH b AS (SELECT event_id, user_id, value, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events)
SELECT user_id, event_id, round(value, 6) AS value, round(before, 6) AS before FROM b WHERE value < before QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def plan_first_descent(spark, d):
    return rounded(survey.first_descents(events(spark, d), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "value", "before"), "value", "before")


@query("""WITH v AS (SELECT DISTINCT user_id, value FROM events WHERE value IS NOT NULL) SELECT user_id, value, round(least(value - lag(value) OVER w, lead(value) OVER w - value), 6) AS gap FROM v WINDOW w AS (PARTITION BY user_id ORDER BY value)""")
def trace_spacing(spark, d):
    return rounded(survey.spacing(table(spark, d, "events"), "user_id", "value"), "gap")


@query("""SELECT l_orderkey, arg_min(l_linenumber, (abs(l_quantity - 25), l_linenumber)) AS l_linenumber, round(min(abs(l_quantity - 25)), 6) AS off FROM lineitem GROUP BY l_orderkey""")
def near_gather_offset(spark, d):
    return rounded(survey.nearest_channel(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", 25.0, ["l_linenumber"]), "off")


@query("""SELECT l_orderkey, min(l_linenumber) FILTER (l_linenumber = 3) AS channel, count(*) FILTER (l_linenumber = 3) > 1 AS ambiguous FROM lineitem GROUP BY l_orderkey""")
def near_gather_channel(spark, d):
    hit = F.col("l_linenumber") == 3
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(F.when(hit, F.col("l_linenumber"))).alias("channel"), (F.count_if(hit) > 1).alias("ambiguous"))


# One message of each kind the grammar tells apart; {i} and {u} stand for a number and a station.
LINES = ("[SHOT] #{i} LA7:SP{u}", "[ shot ]  # {i} ts=12:30:05", "TRIGGER {i}", "trig l B.2 : sp -{u}.5", "boot ok #{i}", "TRIG #1234567890", "TRIGGER - {i}", "[SHOT] TRIG 77")
OBJECTS = ('{"trig": {i}, "sp": {u}.5, "line": "A1"}', '{"trig": null, "id": "12", "line": "A1"}', '{"shot": -4, "ts": " x\\u0001 "}', '{"id": {u}.9, "line": 7}', '{"time": 1700000000}', '{"ts": 1700000000123, "sp": 2e9}', '["sp", 1]', "TRIG {i}")


def _messages(spark, d, forms):
    e = table(spark, d, "events").withColumns({"i": F.col("event_id") % 100000, "u": F.col("user_id") % 50})
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % len(forms)).cast("int") + 1)
    return e.select("event_id", F.replace(F.replace(form, F.lit("{i}"), F.col("i").cast("string")), F.lit("{u}"), F.col("u").cast("string")).alias("said"))


_SAID = "(SELECT event_id, event_id % 8 AS k, CAST(event_id % 100000 AS BIGINT) AS i, CAST(user_id % 50 AS BIGINT) AS u FROM events)"


@query(f"""SELECT event_id, CASE WHEN k IN (0, 1, 7) THEN 'shot' ELSE 'trig' END AS kind, CASE WHEN k <= 2 THEN i WHEN k = 3 THEN 2 END AS id, CASE k WHEN 0 THEN 'A7' WHEN 3 THEN 'B.2' END AS line,
  CASE k WHEN 0 THEN CAST(u AS DOUBLE) WHEN 3 THEN -(u + 0.5::DOUBLE) END AS sp, CASE k WHEN 1 THEN '12:30:05' END AS ts FROM {_SAID} WHERE k <> 4""")
def trigger_parse_line(spark, d):
    # A generator, so that a message is parsed once and not again for a filter.
    return _messages(spark, d, LINES).select("event_id", F.inline(F.array_compact(F.array(triggers.parse_line(F.col("said"))))))


@query(f"""SELECT event_id, CASE WHEN k IN (0, 3) THEN 'shot' ELSE 'trig' END AS kind, CASE k WHEN 0 THEN i WHEN 3 THEN u WHEN 7 THEN i END AS id, CASE k WHEN 0 THEN 'A1' END AS line,
  CASE k WHEN 0 THEN u + 0.5::DOUBLE END AS sp, CASE k WHEN 2 THEN 'x' WHEN 4 THEN '2023-11-14T22:13:20.000Z' WHEN 5 THEN '2023-11-14T22:13:20.123Z' END AS ts FROM {_SAID} WHERE k NOT IN (1, 6)""")
def trigger_parse_json(spark, d):
    return _messages(spark, d, OBJECTS).select("event_id", F.inline(F.array_compact(F.array(triggers.parse_packet(F.col("said"))))))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def trigger_dedup(spark, d):
    return triggers.first_of_key(events(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("""WITH RECURSIVE o AS (SELECT user_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
r AS (SELECT user_id, k, t AS last, 1 AS n FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, CASE WHEN o.t - r.last >= 86400000 THEN o.t ELSE r.last END, CASE WHEN o.t - r.last >= 86400000 THEN r.n + 1 ELSE r.n END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, CAST(max(k) AS BIGINT) AS touches, CAST(max(n) AS BIGINT) AS events FROM r GROUP BY user_id""")
def trigger_collapse(spark, d):
    return triggers.collapse_bursts(events(spark, d).select("user_id", F.unix_millis("ts").alias("ms")), "user_id", "ms", 86_400_000)


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return triggers.tumbling(events(spark, d), "ts", "1 hour", "event_type").withColumn("start", F.unix_seconds("start"))


@query("""SELECT epoch(time_bucket(INTERVAL 1 DAY, ts) - k * INTERVAL 1 DAY)::BIGINT AS start, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1""")
def events_sliding(spark, d):
    return triggers.sliding(events(spark, d), "ts", "2 days", "1 day").withColumn("start", F.unix_seconds("start"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, d):
    return triggers.sessions(events(spark, d), "ts", "6 hours", "user_id").withColumn("start", F.unix_micros("start"))


@query("""WITH r AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts) SELECT l.event_id, r.event_id AS latest FROM (SELECT * FROM events WHERE event_type <> 'click') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def events_as_of(spark, d):
    e = events(spark, d)
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("latest"))
    return triggers.as_of(e.where("event_type <> 'click'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "latest").select("event_id", "latest")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (text IS NULL OR trim(text) = '') AS empty, count(DISTINCT text) AS different, min(length(text)) AS shortest, max(length(text)) AS longest,
count(*) FILTER (regexp_matches(text, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)')) AS numeric FROM documents GROUP BY lang""")
def column_profile(spark, d):
    return text.profile(table(spark, d, "documents"), "text", "lang")


@query("""WITH c AS (SELECT doc_id, unnest([{'n': length(text) - length(replace(text, ',', '')), 'o': 0, 'name': 'comma'}, {'n': length(text) - length(replace(text, ';', '')), 'o': -1, 'name': 'semicolon'}, {'n': length(text) - length(replace(text, chr(9), '')), 'o': -2, 'name': 'tab'}, {'n': length(text) - length(replace(text, '|', '')), 'o': -3, 'name': 'pipe'}, {'n': length(text) - length(replace(text, ' ', '')), 'o': -4, 'name': 'space'}]) AS z FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, CASE WHEN max(z.n) > 0 THEN arg_max(z.name, (z.n, z.o)) END AS delimiter, max(z.n) AS n FROM c GROUP BY doc_id""")
def delimiter_sniff(spark, d):
    return text.sniff_delimiter(table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT item_id, nullif(trim(substr(text, 2, 10)), '') AS line, nullif(trim(substr(text, 12, 10)), '') AS point, nullif(trim(substr(text, 24, 1)), '') AS idx FROM benchmark""")
def fixed_width_parse(spark, d):
    return table(spark, d, "benchmark").select("item_id", *text.fixed_width(F.col("text"), {"line": (1, 11), "point": (11, 21), "idx": (23, 24)}))


# Whole texts, quotes and all, after a quoted cell with delimiters and quotes of its own; tests hold the rule against a walk over characters.
@query("""WITH l AS (SELECT doc_id, '"a,""' || doc_id || '"" b",' || coalesce(text, '') AS line FROM documents),
t AS (SELECT doc_id, string_split(line, '"') AS parts FROM l),
m AS (SELECT doc_id, list_transform(parts, lambda x, i: CASE WHEN i % 2 = 0 THEN x WHEN x = '' AND i > 1 AND i < len(parts) THEN '"' ELSE replace(x, ',', chr(1) || chr(2)) END) AS parts FROM t),
c AS (SELECT doc_id, string_split(array_to_string(parts, ''), chr(1) || chr(2)) AS cells FROM m)
SELECT doc_id, CAST(unnest(range(0, len(cells))) AS INTEGER) AS n, unnest(cells) AS cell FROM c""")
def csv_split(spark, d):
    line = F.concat(F.lit('"a,""'), F.col("doc_id").cast("string"), F.lit('"" b",'), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.split_quoted(line)).alias("n", "cell"))


@query("""SELECT p_partkey, p_name, score FROM (SELECT p_partkey, p_name, CAST(CASE WHEN lower(p_name) = 'blue bolt' THEN 1000 WHEN starts_with(lower(p_name), 'blue bolt') THEN 200 WHEN contains(lower(p_name), 'blue bolt') THEN 100
WHEN contains(lower(p_name), 'blue') AND contains(lower(p_name), 'bolt') THEN 50 ELSE 0 END AS BIGINT) AS score FROM part) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 60""")
def epsg_style_search(spark, d):
    return text.search(table(spark, d, "part"), "p_partkey", "p_name", "blue bolt")


@query("""SELECT a.p_partkey, b.p_partkey AS r_p_partkey FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND abs(a.p_retailprice - b.p_retailprice) <= 5 WHERE a.p_partkey < b.p_partkey""")
def param_match(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return text.tolerance_join(p, p, ["p_brand", "p_size"], {"p_retailprice": 5.0}).where("p_partkey < r_p_partkey").select("p_partkey", "r_p_partkey")


@query("SELECT user_id, arg_max(event_type, (n, event_type)) AS layout FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def mode_layout(spark, d):
    votes = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("user_id").agg(F.max(F.struct("n", "event_type"))["event_type"].alias("layout"))


def _lonlat(spark, d):
    return table(spark, d, "customer").select("c_custkey", (33.0 + (F.col("c_custkey") % 600) / 100.0 - 3.0).alias("lon"), (10.0 + (F.col("c_custkey") % 5000) / 100.0).alias("lat"))


TM = """c AS (SELECT c_custkey, 30.0 + (c_custkey % 600) / 100.0 AS lon, 10.0 + (c_custkey % 5000) / 100.0 AS lat FROM customer), k AS (SELECT 1 / 298.257223563 * (2 - 1 / 298.257223563) AS e2),
a AS (SELECT c_custkey, radians(lat) AS p, radians(lon - 33) * cos(radians(lat)) AS a, 6378137.0 / sqrt(1 - e2 * sin(radians(lat)) ** 2) AS n, tan(radians(lat)) ** 2 AS t, e2 / (1 - e2) * cos(radians(lat)) ** 2 AS c, e2, e2 / (1 - e2) AS ep FROM c, k)"""


@query(f"""WITH {TM} SELECT c_custkey, round(500000 + 0.9996 * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a ** 5 / 120), 4) AS easting,
round(0.9996 * (6378137.0 * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * p - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * p) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * p) - (35 * e2 ** 3 / 3072) * sin(6 * p))
 + n * tan(p) * (a ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a ** 6 / 720)), 4) AS northing FROM a""")
def utm_forward(spark, d):
    east, north = geodesy.transverse_mercator(F.col("lon"), F.col("lat"), 33.0)
    return _lonlat(spark, d).select("c_custkey", F.round(east, 4).alias("easting"), F.round(north, 4).alias("northing"))


@query("SELECT c_custkey, round(30.0 + (c_custkey % 600) / 100.0, 6) AS lon, round(10.0 + (c_custkey % 5000) / 100.0, 6) AS lat FROM customer")
def utm_round_trip(spark, d):
    east, north = geodesy.transverse_mercator(F.col("lon"), F.col("lat"), 33.0)
    rows = _lonlat(spark, d).select("c_custkey", east.alias("e"), north.alias("n"))
    lon, lat = geodesy.inverse_transverse_mercator(F.col("e"), F.col("n"), 33.0)
    return rows.select("c_custkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("""WITH c AS (SELECT c_custkey, radians(30.0 + (c_custkey % 600) / 100.0) AS l, radians(10.0 + (c_custkey % 5000) / 100.0) AS p FROM customer), k AS (SELECT 1 / 298.257223563 * (2 - 1 / 298.257223563) AS e2),
g AS (SELECT c_custkey, (n + 100) * cos(p) * cos(l) AS x, (n + 100) * cos(p) * sin(l) AS y, (n * (1 - e2) + 100) * sin(p) AS z FROM (SELECT c_custkey, l, p, e2, 6378137.0 / sqrt(1 - e2 * sin(p) ** 2) AS n FROM c, k)), q AS (SELECT pi() / 648000 AS q)
SELECT c_custkey, round(-87 + (1 + 2.5e-6) * (x - 0.554 * q * y + 0.2 * q * z), 4) AS x, round(-96 + (1 + 2.5e-6) * (0.554 * q * x + y - 0.1 * q * z), 4) AS y, round(-120 + (1 + 2.5e-6) * (-0.2 * q * x + 0.1 * q * y + z), 4) AS z FROM g, q""")
def helmert(spark, d):
    x, y, z = geodesy.helmert(*geodesy.geocentric(F.col("lon"), F.col("lat"), F.lit(100.0)), (-87.0, -96.0, -120.0, 0.1, 0.2, 0.554, 2.5))
    return _lonlat(spark, d).select("c_custkey", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 4).alias("z"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every trace, with its scores against the traces around it and the detectors that fire."""
    return traces.classify(traces.neighbour_scores(traces.evidence(_records(spark, sf_dir), "vec_id", "samples", "record"), "record", "vec_id"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
