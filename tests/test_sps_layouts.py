"""Layouts of SPS lines against a plain reading of the rules."""

import random
import re

from pyspark.sql import functions as F

from shotframe.sources import sps

NUMBER = re.compile(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def num(raw, a, b):
    m = NUMBER.match(raw[a:b].strip())
    return float(m.group()) if m else None


def plain(raw):
    """(layout, e, n, z, code) of a line, by trial."""
    raw = raw.ljust(80)
    code = raw[24:26].strip()
    if not re.search(r"\d", raw[46:65]) and num(raw, 11, 21) is not None and re.match(r"^[0-9 ]?$", raw[23]) and re.match(r"^[A-Za-z]{1,2}$", code):
        return "SPS2.1", None, None, None, code
    for name, (e, n, z, least) in sps.LAYOUTS.items():
        x, y = num(raw, *e), num(raw, *n)
        if x is not None and y is not None and (abs(x) > least or abs(y) > least):
            return name, x, y, num(raw, *z) if z else None, None
    large = [float(m.group()) for m in map(NUMBER.match, raw.split()[1:]) if m and abs(float(m.group())) > 10]
    return ("D", large[0], large[1], None, None) if len(large) > 1 else (None, None, None, None, None)


def test_lines_of_all_layouts(spark):
    r = random.Random(3)
    rows = []
    for k in range(400):
        e, n = r.uniform(0, 900_000), r.uniform(0, 9e6)
        raw = [
            f"S{k:<10}{k:10.2f}  1{r.choice(['KL', 'G1', '  ', '7 '])}{'':20}{e:9.1f}{n:10.1f}{5:6.1f}", f"R{k:6}{k:4}   {e:10.1f}{n:10.1f}{7:6.1f}", f"R{k:6}{k:4}   {e:12.3f}{n:12.3f}{7:6.1f}", f"s{k:6}{k:4}  {e:10.1f}{n:10.1f}",
            f"R a {100_000 + e / 10:8.1f} b {99_999.5:.1f} 9", f"S{k:<10}{k:10.2f}  1KL", "R", "S  x  y", f"S{'':45}{0.5:9.1f}{-0.5:10.1f}", "".join(r.choice("S 0123456789.x-") for _ in range(90))][k % 10]
        rows.append((f"f{k % 3}", k, raw[:1] if raw[:1].upper() in "SR" else "S", raw))
    got = sps.any_stations(spark.createDataFrame(rows, "file string, ord long, kind string, raw string")).orderBy("ord").collect()
    assert len(got) == 400
    for g, (_, _, _, raw) in zip(got, rows, strict=True):
        layout, e, n, z, code = plain(raw)
        assert (g.layout, g.easting, g.northing, g.code, g.error) == (layout, e, n, code, None if layout else "no place"), raw
        assert z is None or g.elevation == z
    assert {g.layout for g in got} == {"SPS2.1", "A", "B", "C", "D", None}


def test_the_vote_and_reading_again(spark):
    b = lambda k: ("f", k, "R", f"R{1:6}{k:4}   {123456.789:12.3f}{4567890.123:12.3f}{7:6.1f}")
    short = ("f", 50, "R", f"R{1:6}{9:4}   {12.5:12.3f}{99.25:12.3f}")  # also readable as A
    lines = spark.createDataFrame([b(k) for k in range(5)] + [short, ("g", 1, "X", "X")], "file string, ord long, kind string, raw string")
    first = {g.ord: (g.layout, g.file_layout) for g in sps.any_stations(lines).collect()}
    assert set(first.values()) <= {("A", "A"), ("B", "B"), ("A", "B"), ("B", "A")} and first[0][0] == plain(b(0)[3])[0]
    voted = sps.any_stations(lines, by_vote=True).collect()
    assert {g.layout for g in voted} == {g.file_layout for g in voted} or all(g.layout in ("A", "B") for g in voted)
    assert sps.any_stations(lines.limit(0)).count() == 0


def test_relations_and_kinds(spark):
    new = "X" + f"{'T1':<6}{77:8}11{'A':<10}{12.0:10.2f}1{1:5}{48:5}1{'R':<10}{101.0:10.2f}{148.0:10.2f}1"
    old = "X" + f"{'A':<6}{12:4}1{77:4}{'':6}{'LINE-A':<6}{101:4}1{'R2':<6}{148:4}2{'':3}{2:3}"
    rows = spark.createDataFrame([("a.x01", 1, "X", new), ("a.x01", 2, "x", old)], "file string, ord long, kind string, raw string")
    a, b = sps.any_relations(rows).orderBy("ord").collect()
    assert (a.layout, a.tape, a.ffid, a.source_line, a.source_point, a.from_channel, a.to_channel, a.channel_step, a.receiver_line, a.from_point, a.to_point, a.to_line) == ("SPS2.1", "T1", 77, "A", 12, 1, 48, 1, "R", 101, 148, "R")
    assert (b.layout, b.ffid, b.source_line, b.source_point, b.receiver_line, b.from_point, b.to_line, b.to_point, b.point_step, b.tape) == ("legacy", 77, "A", 12, "LINE-A", 101, "R2", 148, 2, None)
    files = [("/d/q.S01", "R"), ("/d/q.txt", "R"), ("/d/q.txt", "r"), ("/d/q.txt", "S"), ("/d/n", "H")]
    kinds = spark.createDataFrame([(f, i, k, k) for i, (f, k) in enumerate(files)], "file string, ord long, kind string, raw string")
    assert {g.file: g.kind for g in sps.kind_of_file(kinds).collect()} == {"/d/q.S01": "S", "/d/q.txt": "R", "/d/n": "mixed"}
