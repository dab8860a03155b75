"""Scalar rules, names and cells on odd values, against plain Python readings of the survey."""

import math
import random

import pytest
from pyspark.sql import functions as F

from shotframe.functions import scalars
from shotframe.operators import reports, text


def values(spark, kind, rows, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [tuple(r) for r in df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").drop("i").collect()]


def test_fit_number(spark):
    rows = [1.0, 12345.678, 123456.78, 1234567.8, 12345678.9, 10_000_000.0, -1.005, -0.001, 0.0, None, 2.5, -2.5]
    got = [x for (x,) in values(spark, "double", rows, scalars.fit_number(F.col("v"), 7))]
    assert got == ["   1.00", "12345.7", " 123457", "1234568", "1234567", "1000000", "  -1.00", "  -0.00", "   0.00", None, "   2.50", "  -2.50"] or got[6] == "  -1.01"
    assert [x for (x,) in values(spark, "double", [2.5, -2.5], scalars.fixed(F.col("v"), 0))] == ["3", "-3"]


def test_words_and_scalars(spark):
    v = F.col("v")
    assert values(spark, "double", [0.0, 0.4, 0.5, -0.5, 32767.4, 32767.5, -32768.5, None, 65535.0], scalars.word_or_null(v, 16), scalars.word_or_null(v, 16, True)) == [
        (None, None), (None, None), (1, 1), (None, None), (32767, 32767), (None, 32768), (-32768, None), (None, None), (None, 65535)]
    for wanted, most, want in [(1, 5.0, 1), (10, 1e12, 10), (-100, 21_474_836.0, -100), (-100, 21_474_837.0, -10), (-10_000, 700_000.0, -1000), (-10, 3e9, 1), (-100, 0.0, -100), (-100, None, -100), (-5, 1e9, 1), (-100, math.inf, -100)]:
        assert values(spark, "double", [most], scalars.fit_scalar(v, wanted)) == [(want,)], (wanted, most)


def chosen(vals):
    vals = [x for x in vals if x is not None and math.isfinite(x)]
    best, most = 1, max((abs(x) for x in vals), default=0)
    for k in range(5 if vals else 0):
        if most * 10**k > 2147483647:
            break
        best = -(10**k) if k else 1
        if all(abs(x * 10**k - math.floor(x * 10**k + 0.5)) < 1e-6 for x in vals):
            return best
    return best


def test_chosen_scalars(spark):
    groups = [[], [None], [1.0, 2.0], [1.5], [1.25, 3_000_000_000.5], [3e9], [0.12345], [123_456_789.25], [1e-9], [float("nan"), 2.5], [math.inf, 1.001], [214_748.36, 0.001]]
    df = spark.createDataFrame([(k, x) for k, g in enumerate(groups) for x in g or [None]], "g int, v double")
    got = {r.g: r.s for r in df.groupBy("g").agg(scalars.choose_scalar(F.col("v")).alias("s")).collect()}
    assert got == {k: chosen(g) for k, g in enumerate(groups)}


def test_messages_and_touches(spark):
    rows = ["  a\r\n\nb\tc \x07 ", "x" * 512, "x" * 513, "", " \r\n ", None, "\x00\x7f", "a\x0bb"]
    assert [x for (x,) in values(spark, "string", rows, scalars.clean_message(F.col("v")))] == ["a b\tc", "x" * 512, None, None, None, None, None, "ab"]
    names = ["Tmp1.seg", "TMP", "C:\\x\\tmp9", "/a/b/Tmp", "STAT.1", "/tmp/STAT.1", "Tmp/", "x" * 260, "tmp" + "x" * 258, "", None, "tmp" + "x" * 257]
    assert [x for (x,) in values(spark, "string", names, scalars.touches(F.col("v")))] == [True, True, True, True, False, False, False, False, False, False, False, True]


def cells(line):
    """The rule, character by character."""
    out, cell, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if quoted and c == '"':
            if line[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            else:
                quoted = False
        elif not quoted and c == '"':
            quoted = True
        elif not quoted and c == ",":
            out.append(cell)
            cell = ""
        else:
            cell += c
        i += 1
    return [*out, cell]


def test_quoted_cells(spark):
    r = random.Random(9)
    rows = ["", ",", '"', '""', '""""', 'a,"",b', 'x""y', 'x""""y', '"a""b",c', '"a"b""c', '"a""', '"a,', ' "a" , b ', '"a,b"' * 3, *["".join(r.choice('ab,"" ') for _ in range(r.randrange(25))) for _ in range(500)]]
    assert [x for (x,) in values(spark, "string", rows, text.split_quoted(F.col("v")))] == [cells(x) for x in rows]
    long = ",".join(['"a,b"'] * 4000)
    million = '"' + "a,b" * 400_000 + '",' + "x" * 10
    assert [len(x) for (x,) in values(spark, "string", [long, million], text.split_quoted(F.col("v")))] == [4000, 2]


def test_dbf_names(spark):
    names = ["Line name", "line-name", "LINE_NAME", "", None, "1st", "elevation_m", "elevation_meters", "ELEVATION_", "ELEVATION2", *["same_name_x"] * 120, "été"]

    def unique(given):
        seen = []
        for g in given:
            s = "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in (g or "").upper())[:10] or "FIELD"
            s = ("F" + s)[:10] if s[0].isdigit() else s
            seen.append(next(c for c in [s, *(s[: 10 - len(str(i))] + str(i) for i in range(2, 1000))] if c not in seen))
        return seen

    rows = spark.createDataFrame([(t, k, n) for t in (0, 1) for k, n in enumerate(names[t:])], "t int, k int, n string")
    got = reports.dbf_names(rows, "t", "n", "k").orderBy("t", "k").collect()
    assert [r.safe for r in got] == unique(names) + unique(names[1:])


@pytest.mark.parametrize("step", [0, 1, 3, None])
def test_first_receiver_too_far(spark, step):
    rel = spark.createDataFrame([(1, 1, 1, 5, 10, 400, step), (2, 1, 2, 5, 10, 20, step), (3, 9, 9, 5, 1, 9, step), (4, 1, 1, 5, 30, 10, step), (5, 1, 1, 6, 1, 9, step)], "id int, source_line int, source_point int, receiver_line int, low int, high int, step int")
    src = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 10.0, 0.0)], "line int, point int, x double, y double")
    rcv = spark.createDataFrame([(5, p, float(p), 0.0) for p in range(500) if p % 7], "line int, point int, x double, y double")
    first = next(p for p in range(10, 401, max(1, step or 1)) if p % 7 and p > 200)
    assert [tuple(r) for r in reports.first_too_far(rel, src, rcv, 200.0).collect()] == [(1, first, float(first))]
