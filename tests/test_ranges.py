"""The byte-range SEG-Y source against whole-file reading, on records of every kind."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotframe.sources import segy
from shotframe.sources.ranges import plan, register


def file_bytes(lengths, code=5, order="big", revision=0x0100, extended=0, extra=0, fixed=None, interval=2000, default=None, seed=1):
    r = np.random.default_rng(seed)
    text = "".join(f"C{i:2d} text".ljust(80) for i in range(1, 41)).encode("cp037")
    b = bytearray(400)
    n = default if default is not None else lengths[0] if lengths else 10
    fixed = int(len(set(lengths)) == 1) if fixed is None else fixed
    for at, v, size in ((16, interval, 2), (20, n, 2), (24, code, 2), (300, revision, 2), (302, fixed, 2), (304, extended & 0xFFFF, 2), (306, extra, 4)):
        b[at : at + size] = v.to_bytes(size, order)
    out, data = [text, bytes(b)], []
    if extended:
        count = extended if extended > 0 else 3
        out += ["((SEG: EndText))".ljust(3200).encode("cp037") if k == count - 1 else b"\x40" * 3200 for k in range(count)]
    for k, m in enumerate(lengths):
        x = np.round(r.normal(size=m) * 100).astype(np.float32) if code not in (10, 11, 12, 15, 16) else r.integers(0, 200, m).astype(np.float32)
        x = np.clip(x, -127, 127) if code == 8 else x
        h = bytearray(240)
        for at, v, size in ((4, 1000 + k, 4), (12, k, 4), (114, m, 2), (116, interval, 2)):
            h[at : at + size] = v.to_bytes(size, order)
        out += [bytes(h), bytes(240 * extra), segy.sample_bytes(x, code, order) if segy.FORMATS[code] else bytes(4 * m)]
        data.append(x)
    return b"".join(out), data


@pytest.fixture(scope="module")
def source(spark):
    register(spark)
    return spark


def read(spark, path, split=20_000, **options):
    return spark.read.format("segy").option("splitBytes", split).options(**options).load(str(path))


KINDS = {f"code{c}": {"code": c} for c in (1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 15, 16)} | {
    "little": {"order": "little", "code": 2}, "variable": {"lengths": [50, 70, 50, 31] * 40}, "endtext": {"extended": -1, "revision": 0x0200}, "two_blocks": {"extended": 2}, "extra": {"revision": 0x0201, "extra": 2},
    "little_rev2": {"order": "little", "revision": 0x0200, "extra": 1, "code": 3}, "undeclared": {"fixed": 0}, "own_count": {"default": 0, "lengths": [40] * 90, "fixed": 0}}


@pytest.mark.parametrize("kind", KINDS)
def test_split_reading_equals_what_was_written(source, tmp_path, kind):
    options = {"lengths": [60] * 150} | KINDS[kind]
    raw, data = file_bytes(**options)
    (tmp_path / "a.sgy").write_bytes(raw)
    ranges = plan(str(tmp_path / "a.sgy"), 20_000)
    assert len(ranges) > 1 and all(a.end == b.begin and a.last + 1 == b.first for a, b in zip(ranges, ranges[1:], strict=False)) and ranges[-1].end == len(raw)
    rows = read(source, tmp_path).orderBy("trace_idx").collect()
    assert [r.trace_idx for r in rows] == [r.channel for r in rows] == list(range(len(data))) and not any(r.error for r in rows)
    assert all(np.array_equal(np.array(r.samples, np.float32), x) for r, x in zip(rows, data, strict=True))


def test_only_headers_and_chosen_ranges(source, tmp_path):
    raw, _ = file_bytes([500] * 200)
    (tmp_path / "a.sgy").write_bytes(raw)
    got = source.read.format("segy").option("splitBytes", 50_000).schema("trace_idx long, channel int, n_samples int, error string").load(str(tmp_path))
    assert [tuple(r) for r in got.orderBy("trace_idx").collect()] == [(k, k, 500, None) for k in range(200)]
    one = read(source, tmp_path, 50_000).where("trace_idx = 137")
    assert one.rdd.getNumPartitions() == 1 and one.select("channel").first()[0] == 137
    assert read(source, tmp_path, 50_000).rdd.getNumPartitions() > 5
    assert read(source, tmp_path, 50_000).where("trace_idx > 1000000").count() == 0


def test_records_joined_end_to_end(source, tmp_path):
    parts = [file_bytes([40] * 30), file_bytes([55] * 20, code=3, order="little", seed=2), file_bytes([10, 12, 10] * 9, code=1, seed=3, interval=4000)]
    (tmp_path / "a.sgy").write_bytes(b"".join(raw for raw, _ in parts))
    rows = read(source, tmp_path, 5000).orderBy("trace_idx").collect()
    want = [(k, x) for k, (_, data) in enumerate(parts) for x in data]
    assert [r.record for r in rows] == [k for k, _ in want] and all(np.array_equal(np.array(r.samples, np.float32), x) for r, (_, x) in zip(rows, want, strict=True))


def test_faults_are_rows(source, tmp_path):
    raw, data = file_bytes([60] * 50)
    (tmp_path / "cut.sgy").write_bytes(raw[:-7])
    (tmp_path / "short.sgy").write_bytes(raw[:3000])
    broken = bytearray(raw)
    broken[3600 + 20 * 480 + 114 : 3600 + 20 * 480 + 116] = struct.pack(">H", 59)  # not of the declared length
    (tmp_path / "other.sgy").write_bytes(bytes(broken))
    (tmp_path / "code4.sgy").write_bytes(file_bytes([60] * 5, code=4)[0])
    (tmp_path / "empty.sgy").write_bytes(b"")
    by = read(source, tmp_path).groupBy(F.regexp_extract("path", r"([^/]+)$", 1).alias("f")).agg(F.count_if(F.col("samples").isNotNull()).alias("n"), F.max("error").alias("e")).collect()
    got = {r.f: (r.n, r.e) for r in by}
    assert got["cut.sgy"] == (49, "473 bytes after the last whole trace") and got["short.sgy"] == (0, "shorter than its headers") and got["empty.sgy"][0] == 0 and got["empty.sgy"][1]
    assert got["other.sgy"][1].startswith("a trace of another length") and got["other.sgy"][0] >= 20
    assert got["code4.sgy"] == (0, "samples of format 4 are not decoded")
    assert read(source, tmp_path / "none*").count() == 0
    whole = segy.read_records(source, str(tmp_path / "cut.sgy")).first()
    assert whole.n_traces == 49 and whole.error == "473 bytes after the last whole trace"


def test_random_bytes_end_in_rows(source, tmp_path):
    r = random.Random(6)
    raw, _ = file_bytes([30] * 40)
    for k in range(40):
        b = bytearray(raw if k % 2 else r.randbytes(r.randrange(8000)))
        for _ in range(r.randrange(30)):
            if b:
                b[r.randrange(len(b))] = r.randrange(256)
        (tmp_path / f"{k}.sgy").write_bytes(bytes(b))
    assert read(source, tmp_path).select("path").distinct().count() == 40


def test_a_file_over_three_gigabytes(source, tmp_path):
    """Sparse on disk: 400,000 traces of 2000 samples; headers are read in many tasks, a range of samples in one."""
    n, m = 400_000, 2000
    raw, _ = file_bytes([m], fixed=1)
    path, step = tmp_path / "large.sgy", 240 + 4 * m
    with open(path, "wb") as f:
        f.write(raw[:3600])
        f.truncate(3600 + n * step)
        h = bytearray(raw[3600 : 3600 + step])
        for k in (0, 123_456, n - 1):
            h[12:16] = k.to_bytes(4, "big")
            f.seek(3600 + k * step)
            f.write(bytes(h))
    assert os.path.getsize(path) > 3 << 30
    ranges = plan(str(path))
    assert len(ranges) > 40 and ranges[-1].last == n - 1 and ranges[-1].end == os.path.getsize(path)
    got = read(source, path, 64 << 20).where("trace_idx BETWEEN 123455 AND 123457").orderBy("trace_idx").collect()
    assert [r.trace_idx for r in got] == [123_455, 123_456, 123_457] and got[1].channel == 123_456 and len(got[1].samples) == m


def test_written_files_are_read_back(source, tmp_path):
    from shotframe.sources.files import write_files

    traces = source.range(600).selectExpr("concat('f', id % 3, '.sgy') as path", "cast(id div 3 as int) as trace_idx", "cast(id as int) as channel", "transform(sequence(1, 40), i -> cast(i * id as float)) as samples")
    write_files(segy.encode(traces), str(tmp_path))
    back = read(source, tmp_path, 9000)
    assert back.count() == 600 and back.where("samples[39] = 40 * channel").count() == 600
