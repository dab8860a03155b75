"""The library's own operators: SQL parity on the smallest tables, round trips, streams."""

import os

import duckdb
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotframe.operators import generate, geodesy, kernels, survey, traces, triggers
from shotframe.plans import portfolio, rules  # noqa: F401
from shotframe.sources import coordinates, segy, sps
from shotframe.streaming import triggers as live

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def plain(df: pd.DataFrame) -> list:
    out = []
    for row in df[sorted(df.columns)].itertuples(index=False):
        out.append(tuple("null" if v is None or v is pd.NA or (np.isscalar(v) and pd.isna(v)) else f"{float(v):.5f}" if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else str(v) for v in row))
    return sorted(out)


@pytest.mark.parametrize("name", ["trace_evidence", "agc_median", "sta_lta_pick", "trace_xcorr_best_lag", "local_median_mad", "fold_map", "skid_report", "manifest_diff_both", "spatial_nearest", "idw_surface", "trigger_collapse", "events_as_of", "utm_forward", "param_match", "csv_split", "plan_check", "trace_classes", "trigger_parse_line", "trigger_parse_json", "qc_range_check", "field_text", "field_quoting", "field_times", "header_scalars", "chosen_scalars", "worst_offenders", "max_offset_check", "tombstone_records", "dbf_names", "line_lengths"])
def test_parity(spark, duck, name):
    got, want = portfolio.queries()[name](spark, SF).toPandas(), duck.execute(portfolio.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    off = [(a, b) for a, b in zip(plain(got), plain(want), strict=True) if a != b]
    assert not off


def test_flagship_has_a_class_for_every_trace(spark):
    out = portfolio.flagship(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count() and out.where("class IS NULL").isEmpty()


def test_samples_that_are_not_finite(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan"), None, -1.0]), (2, []), (3, None), (4, [0.0, 0.0])], "id int, xs array<double>")
    got = {r.id: r for r in traces.evidence(df, "id", "xs").collect()}
    assert got[1].rms == pytest.approx(np.sqrt(0.5)) and got[1].crossings == 1 and got[2].rms == 0 and got[4].norm_p95 == 1


def test_partitions_do_not_matter(spark):
    e = portfolio.events(spark, SF)
    a, b = (survey.local_median(x, "user_id", ["ts", "event_id"], "value", 6).select("event_id", "local_median") for x in (e, e.repartition(7)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("code", [1, 5, 3])
def test_segy_round_trip(spark, tmp_path, code):
    r = np.random.default_rng(1)
    scale = 1 if code != 3 else 1000
    rows = [(f"rec{f}", i, 100 + f, i + 1, -25 * i, [float(np.float32(round(v * scale) if code == 3 else v)) for v in r.normal(size=50)]) for f in range(2) for i in range(6)]
    df = spark.createDataFrame(rows, "path string, trace_idx int, field_record int, channel int, offset int, samples array<double>")
    for x in segy.encode(df, code=code).collect():
        (tmp_path / f"{x.file}.sgy").write_bytes(x.content)
    (tmp_path / "bad.sgy").write_bytes(b"short")
    back = {(r.field_record, r.channel): r for r in segy.read_traces(spark, f"{tmp_path}/*.sgy").collect()}
    assert len(back) == 12
    for path, i, ffid, ch, off, xs in rows:
        got = back[(ffid, ch)]
        assert got.trace_idx == i and got.offset == off and got.n_samples == 50 and np.allclose(got.samples, xs, rtol=1e-5, atol=1e-6)
    head = {os.path.basename(r.path): r for r in segy.read_records(spark, f"{tmp_path}/*.sgy").collect()}
    assert head["rec0.sgy"].n_traces == 6 and head["rec0.sgy"].sample_format == code and "SPARK" in head["rec0.sgy"].text_header and head["bad.sgy"].error


def test_su_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 7, [1.0, -2.5]), ("a", 1, 8, [0.5, 4.0])], "path string, trace_idx int, channel int, samples array<double>")
    (tmp_path / "a.su").write_bytes(segy.encode(df, su=True).first().content)
    assert [(r.channel, list(r.samples)) for r in segy.read_traces(spark, f"{tmp_path}/a.su", su=True).orderBy("trace_idx").collect()] == [(7, [1.0, -2.5]), (8, [0.5, 4.0])]


def test_sps_round_trip_and_fold(spark, tmp_path):
    r = generate.preplot(spark, 4, 48, 200.0, 25.0).select(F.lit("R").alias("kind"), (F.col("line") + 1000).cast("string").alias("line"), F.col("point").cast("double").alias("point"), F.lit("1").alias("idx"), (F.col("easting") % 1000000).alias("easting"), F.col("northing"), F.lit(12.5).alias("elevation"))
    s = r.where("point IN (1, 9) AND line = '1001'").withColumn("kind", F.lit("S"))
    x = s.select(F.lit("T1").alias("tape"), F.col("point").alias("ffid"), F.col("line").alias("source_line"), F.col("point").alias("source_point"), F.lit("1").alias("source_idx"), F.lit(1.0).alias("from_channel"), F.lit(48.0).alias("to_channel"), F.lit(1.0).alias("channel_step"), F.lit("1002").alias("receiver_line"), F.lit(1.0).alias("from_point"), F.lit(48.0).alias("to_point"), F.lit("1").alias("receiver_idx"))
    sps.station_lines(r.unionByName(s)).write.text(f"{tmp_path}/st")
    sps.relation_lines(x).write.text(f"{tmp_path}/x")
    lines = sps.read_lines(spark, f"{tmp_path}/*")
    st, rel = sps.stations(lines), sps.relations(lines)
    assert st.count() == 194 and rel.count() == 2 and st.where("line IS NULL OR easting IS NULL OR elevation <> 12.5").isEmpty()
    assert rel.where("receiver_line = '1002' AND from_point = 1 AND to_point = 48").count() == 2
    each = survey.expand(rel.select("ffid", F.col("source_line"), F.col("source_point"), F.col("receiver_line"), F.col("from_point").cast("long").alias("a"), F.col("to_point").cast("long").alias("b")), "a", "b", F.lit(1))
    src = st.where("kind = 'S'").select(F.col("line").alias("source_line"), F.col("point").alias("source_point"), F.col("easting").alias("sx"), F.col("northing").alias("sy"))
    rcv = st.where("kind = 'R'").select(F.col("line").alias("receiver_line"), F.col("point").cast("long").alias("point"), F.col("easting").alias("rx"), F.col("northing").alias("ry"))
    mid = survey.midpoints(each, src, rcv, ["source_line", "source_point"], ["receiver_line", "point"])
    assert mid.count() == 96 and survey.fold(mid, "mx", "my", 25.0, 25.0).agg(F.sum("fold")).first()[0] == 96


def test_coordinates(spark, tmp_path):
    (tmp_path / "p.csv").write_text("# plan\nStation,Line,X,Y\n1,A,500.5,7abc\n2,A,501,8\n")
    got = [tuple(r) for r in coordinates.read_coordinates(spark, f"{tmp_path}/p.csv").orderBy("point").collect()]
    assert got == [("A", 1.0, 500.5, 7.0, None, None, None), ("A", 2.0, 501.0, 8.0, None, None, None)]


def test_trigger_grammar(spark):
    said = ["[SHOT] #12 LA1:SP105.5 ts=2024-01-01T00:00:00", "TRIG 77", "nothing", None, "trigger #5"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").select("i", triggers.parse_line(F.col("x")).alias("t")).orderBy("i").collect()]
    assert tuple(got[0]) == ("shot", 12, "A1", 105.5, "2024-01-01T00:00:00") and tuple(got[1]) == ("trig", 77, None, None, None) and got[2] is None and got[3] is None and got[4].id == 5


def test_trigger_packets(spark):
    said = ['{"trig": 5, "sp": -1.5, "line": "B"}', '{"id": "5"}', "{", "[1]", '{"sp": 1e10, "ts": ""}', '{"trig": null, "shot": 1000000001, "time": "t"}', '{"line": "%s", "sp": 0}' % ("x" * 33), "TRIG 9", "x" * 513 + " TRIG 9", "\x01 TRIG\r\n#4", None, "", '{"ts": 5e12}']
    got = [r.t for r in spark.createDataFrame(list(enumerate(said)), "i int, x string").select("i", triggers.parse_packet(F.col("x")).alias("t")).orderBy("i").collect()]
    assert tuple(got[0]) == ("shot", 5, "B", -1.5, None) and tuple(got[5]) == ("trig", None, None, None, "t") and tuple(got[6]) == ("shot", None, None, 0.0, None)
    assert got[7].id == 9 and got[9].id == 4 and all(got[i] is None for i in (1, 2, 3, 4, 8, 10, 11, 12))


def test_streams(spark, tmp_path):
    for i, part in enumerate([["[SHOT] #1 LA:SP1 ts=0", "[SHOT] #1 LA:SP1 ts=400", "noise"], ["[SHOT] #2 LA:SP2 ts=1300", "[SHOT] #3 LA:SP3 ts=9000"]]):
        (tmp_path / f"in{i}.txt").write_text("\n".join(part))
    rows = live.parsed(live.landed_lines(spark, str(tmp_path), 1)).select("trigger.line", F.col("trigger.ts").cast("long").alias("ms"))
    q = live.collapsed(rows, "line", "ms", 1200).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    try:
        for _ in range(120):  # state with a time to live runs batches without data, so the query is never done
            assert q.exception() is None
            if sum(p["numInputRows"] > 0 for p in q.recentProgress) >= 2:
                break
            time.sleep(0.25)
    finally:
        q.stop()
    assert sorted(r.ms for r in spark.sql("SELECT * FROM bursts").collect()) == [0, 1300, 9000]


def test_kernels_against_closed_forms(spark):
    n = 64
    x = np.cos(2 * np.pi * 8 * np.arange(n) / n)
    assert int(np.argmax(kernels.spectrum_of(x))) == 8
    assert kernels.correlate(np.eye(1, 32, 5)[0], np.eye(1, 32, 9)[0]) == (-4, pytest.approx(1.0))
    assert np.allclose(np.abs(kernels.analytic(x)), 1, atol=1e-9)
    row = spark.range(1).select(F.lit(33.0).alias("lon"), F.lit(45.0).alias("lat"))
    e, m = geodesy.transverse_mercator(F.col("lon"), F.col("lat"), 33.0)
    assert row.select(e.alias("e"), m.alias("n")).first() == (500000.0, pytest.approx(4982950.4003, abs=1e-3))
    assert generate.sweep(spark, 8.0, 80.0, 4.0, 2000).count() == 2001


def test_formats_and_exports(spark, tmp_path):
    from shotframe.sources import formats

    d = tmp_path / "f"
    d.mkdir()
    (d / "a.sgy").write_bytes(b"x")
    (d / "b.bin").write_bytes(bytes([0x55, 0x3A]) + bytes(10))
    (d / "c.bin").write_bytes(b"H00SPS format")
    (d / "d.bin").write_bytes(bytes(4000))
    (d / "e.bin").write_bytes(b"?")
    got = {os.path.basename(r.path): r.format for r in formats.detect(spark, str(d)).collect()}
    assert got == {"a.sgy": "segy", "b.bin": "seg2", "c.bin": "sps", "d.bin": "segy", "e.bin": None}
    rows = spark.createDataFrame([(1.5, 2.5, "a<b"), (None, 1.0, "c")], "lon double, lat double, name string")
    formats.geojson_lines(rows, "lon", "lat", "name").write.text(f"{tmp_path}/g")
    back = formats.read_geojson_lines(spark, f"{tmp_path}/g").collect()
    assert [(r.lon, r.lat, r.properties["name"]) for r in back] == [(1.5, 2.5, "a<b")]
    assert [r.value for r in formats.kml_placemarks(rows, "lon", "lat", "name").collect()] == ["<Placemark><name>a&lt;b</name><Point><coordinates>1.50000000,2.50000000</coordinates></Point></Placemark>"]


def test_segp1_round_trip(spark, tmp_path):
    from shotframe.sources import segp1

    rows = spark.createDataFrame([("S", "LINE 1", 101.0, 29.5, -95.25, 500000.1, 326400.5, 12.5), (None, "L2", 7.0, -0.5, 179.99, 1.0, 2.0, None), ("R", "L3", 8.0, None, None, None, None, 3.0)], "kind string, line string, point double, lat double, lon double, easting double, northing double, elevation double")
    segp1.point_lines(rows).write.text(f"{tmp_path}/p1")
    (tmp_path / "p1" / "head.txt").write_text("H SEG-P1 header\n\n")
    got = {r.line: r for r in segp1.read_points(spark, f"{tmp_path}/p1/*").collect()}
    assert set(got) == {"LINE 1", "L2", "L3"}
    for r in rows.collect():
        g = got[r.line]
        assert g.point == r.point and g.kind == r.kind
        for n in ("lat", "lon", "easting", "northing", "elevation"):
            assert (g[n] is None and r[n] is None) or g[n] == pytest.approx(r[n], abs=0.051 if n not in ("lat", "lon") else 2e-6)
    assert spark.range(1).select(segp1.grid_metres(F.lit("660000.0")).alias("a"), segp1.packed_degrees(F.lit("299900.00N"), 2).alias("b")).first() == (660000.0, None)


def test_scalars_on_odd_values(spark):
    from shotframe.functions import scalars

    df = spark.createDataFrame([(1, 'a"b', -0.5, -190.0), (2, None, None, 540.0), (3, "", 1e12, float("nan"))], "id int, t string, v double, a double")
    got = {r.id: r for r in df.select("id", scalars.csv_cell(F.col("t")).alias("cell"), scalars.clean_message(F.col("t")).alias("said"), scalars.half_up(F.col("v")).alias("up"), scalars.wrap180(F.col("a")).alias("wrapped"),
                                      scalars.clamp01(F.col("a")).alias("clamped"), scalars.encode_scalar(F.col("v"), F.lit(-10)).alias("raw")).collect()}
    assert got[1].cell == '"a""b"' and got[1].up == 0 and got[1].wrapped == 170 and got[1].clamped == 0 and got[1].raw == -5
    assert got[2].cell is None and got[2].said is None and got[2].wrapped == 180 and got[2].raw is None
    assert got[3].said is None and got[3].clamped == 0 and got[3].raw == 2**31 - 1


def test_gain_and_picks_against_plain_loops():
    r = np.random.default_rng(4)
    for n in (0, 1, 3, 40, 200):
        xs = r.normal(size=n)
        for half in (0, 2, 30):
            near = [np.abs(xs[max(0, i - half) : i + half + 1]) for i in range(n)]
            assert np.allclose(traces.neighbour_levels(xs, half, "rms"), [np.sqrt((x * x).mean()) for x in near])
            assert np.allclose(traces.neighbour_levels(xs, half, "mean"), [x.mean() for x in near])
            assert np.allclose(traces.neighbour_levels(xs, half, "median"), [np.sort(x)[len(x) // 2] for x in near])
        e, want = xs * xs, None
        for i in range(7, n):
            long = e[max(0, i - 14) : max(0, i - 2)]
            if want is None and e[i - 2 : i + 1].mean() / max(long.mean() if len(long) else 0, 1e-4 * e.mean(), 1e-12) >= 2.5:
                want = i
        assert traces.first_pick(xs, 3, 12, 2.5, 7) == want


def test_detectors(spark):
    def trace(i):
        x = np.sin(np.arange(100) * 0.3) * (1 + i % 3 * 0.01)
        return {3: x * 1e-3, 5: x * 0.3, 7: x * 50, 9: np.clip(x, -0.2, 0.2), 11: np.zeros(100), 13: np.array([]), 15: 20 * np.where(np.arange(100) % 2, 1.0, -1.0) * (1 + 0.02 * np.arange(100))}.get(i, x)

    # One sample of three is a run of a third of the trace, so the short one counts as clipped.
    rows = [(1, i, trace(i).tolist()) for i in range(30)] + [(2, 100, [1.0, 2.0, -1.0]), (2, 101, None), (3, 200, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "record int, id int, xs array<double>")
    found = {r.id: r for r in traces.classify(traces.neighbour_scores(traces.evidence(df, "id", "xs", "record"), "record", "id")).collect()}
    assert len(found) == len(rows) and {i: found[i]["class"] for i in (3, 5, 7, 9, 11, 13)} == {3: "dead", 5: "amp", 7: "amp", 9: "clipped", 11: "dead", 13: "dead"}
    assert set(found[15].detectors) == {"clipped", "noisy", "amp"} - ({"clipped"} if found[15].rail_run < 3 else set()) and found[15].severity == 1
    assert found[0]["class"] == "good" and found[0].detectors == [] and found[0].severity == 0
    assert found[100]["class"] == "clipped" and found[101]["class"] == "dead" and found[200]["class"] == "good"
    assert all(0 <= r.severity <= 1 for r in found.values())


def test_plan_check(spark):
    names = "line string, k long, x double, y double, st long, h double, seen int"
    walk = [("A", i, 25.0 * i, 0.0, i + 1, 10.0, 0) for i in range(12)]
    walk[3] = ("A", 3, 50.2, 0.0, 2, 9500.0, 0)  # as good as at the point before, a number seen before, too high
    walk[8] = ("A", 8, 9000.0, 0.0, None, None, 0)
    walk[9] = ("A", 9, None, 0.0, 10, 1.0, 0)
    df = spark.createDataFrame([*walk, ("B", 0, 0.0, 0.0, 1, 0.0, 0)], names)
    got = {(r.line, r.pos, r.category): (r.severity, r.n) for r in survey.check_plan(df, "line", "k", "x", "y", "st", "h", preplot=True).collect()}
    assert got.pop((None, None, "dup-station-cross")) == ("info", 1) and got.pop(("A", 0, "no-station")) == ("error", 1) and got.pop(("B", 0, "short-line")) == ("error", 1)
    assert got == {("A", 3, "coincident"): ("error", 1), ("A", 3, "dup-station"): ("error", 1), ("A", 3, "monotonic"): ("warn", 1), ("A", 3, "elevation"): ("warn", 1),
                   ("A", 4, "interval"): ("warn", 1), ("A", 8, "outlier"): ("warn", 1)}
    assert survey.check_plan(df.limit(0), "line", "k", "x", "y", "st", "h").count() == 0
