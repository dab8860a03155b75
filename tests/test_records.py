"""SEG-D, SEG-2 and tape images: round trips over formats and revisions, odd and broken records."""

import random

import numpy as np
import pytest

from shotframe.sources import packed, seg2, segd, segy, tape
from shotframe.sources.files import put
from shotframe.sources.ranges import plan, register

from .test_ranges import file_bytes


def test_packed_integers():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 100):
        x = r.integers(-(2**19), 2**19, n)
        for high in (True, False):
            raw = packed.write_20(x, high)
            assert len(raw) == packed.bytes_of_20(n) and np.array_equal(packed.read_20(raw, 0, n, high), x)
        y = r.integers(-(2**23), 2**23, n)
        assert np.array_equal(packed.read_24(packed.write_24(y), 0, n), y)
    assert packed.read_20(bytes([0x12, 0x34, 0x5F, 0xFF, 0xFE]), 0, 2, True).tolist() == [0x12345, -2]
    assert packed.read_20(bytes([0x45, 0x23, 0xE1, 0xFF, 0xFF]), 0, 2, False).tolist() == [0x12345, -2]


@pytest.mark.parametrize("revision", [1, 2, 3])
@pytest.mark.parametrize("code", [8015, 8036, 8058])
def test_segd_round_trip(spark, tmp_path, code, revision):
    r = np.random.default_rng(code + revision)
    x = [np.float32(r.integers(-500_000, 500_000, 31)) for _ in range(7)]
    put(f"{tmp_path}/a.segd", segd.encode(x, code, revision, file_number=123 if code == 8015 else 70_123, interval_us=500, line=12, first_point=300, extended=3, external=2, kinds=[2 if revision < 3 else 0x20, 1 if revision < 3 else 0x10]))
    rows = segd.read_traces(spark, str(tmp_path)).orderBy("trace_idx").collect()
    assert [r.error for r in rows] == [None] * 7 and all(np.array_equal(a.samples, b) for a, b in zip(rows, x, strict=True))
    first, last = rows[0], rows[-1]
    assert (first.file_number, first.revision, first.format_code, first.channel_set, first.trace_number) == (123 if code == 8015 else 70_123, revision, code, 1, 1)
    assert (last.channel_set, last.trace_number, last.receiver_line, last.receiver_point, last.interval_us) == (2, 3, 12, 306, 500.0)
    assert (first.channel_type, last.channel_type) == ((2, 1) if revision < 3 else (0x20, 0x10))


def test_segd_traces_of_other_lengths_and_faults():
    x = [np.arange(n, dtype=np.float32) for n in (5, 9, 3)]
    raw = segd.encode(x, 8036, 3)
    assert [r["n_samples"] for r in segd.decode(raw)] == [5, 9, 3]
    cut = segd.decode(raw[:-4])
    assert cut[-1]["n_samples"] == 1 and cut[-1]["error"] == "trace 3 is cut off"
    gone = segd.decode(raw[: -9 - 52])
    assert len(gone) == 2 and gone[-1]["error"] == "3 traces declared, 2 read"
    odd = bytearray(raw)
    odd[2:4] = b"\x80\x22"
    assert "read as 20 bits" in segd.decode(bytes(odd))[-1]["error"]
    assert segd.decode(b"x")[0]["error"] == "shorter than its general headers" and "error" in segd.decode(bytes(64))[0]
    r = random.Random(1)
    for k in range(600):
        b = bytearray(raw if k % 3 else r.randbytes(r.randrange(600)))
        for _ in range(r.randrange(12)):
            if b:
                b[r.randrange(len(b))] = r.randrange(256)
        assert segd.decode(bytes(b[: r.randrange(len(b) + 1)]))


@pytest.mark.parametrize("kind", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("chained", [True, False])
def test_seg2_round_trip(spark, tmp_path, kind, chained):
    r = np.random.default_rng(kind)
    x = [np.float32(r.integers(-30_000, 30_000, n)) for n in (21, 40)]
    said = [{"CHANNEL_NUMBER": "1", "SAMPLE_INTERVAL": "0.00025", "RECEIVER_LOCATION": "12.25 3.5 1", "SOURCE_LOCATION": "1000.5"}, {"CHANNEL_NUMBER": "2", "DELAY": "-0.01", "TRACE_TYPE": "DEAD", "LOW_CUT_FILTER": "10 24 x", "SHOT_SEQUENCE_NUMBER": "99999999999"}]
    put(f"{tmp_path}/a.dat", seg2.encode(x, said, kind, chained))
    a, b = seg2.header_words(seg2.read_traces(spark, str(tmp_path))).orderBy("trace_idx").collect()
    assert a.error is None and b.error is None and np.array_equal(a.samples, x[0]) and np.array_equal(b.samples, x[1])
    assert a.strings == said[0] and a.interval_us == b.interval_us == 250
    assert (a.channel, a.coordinate_scalar, a.receiver_x, a.receiver_y, a.source_x, a.source_y) == (1, -100, 1225, 350, 100_050, None)
    assert (b.delay_ms, b.trace_id, b.low_cut_hz, b.low_cut_slope, b.field_record, b.coordinate_scalar) == (-10, 2, 10, 24, None, None)


def test_seg2_intervals_and_faults():
    assert [seg2.interval_us(v) for v in ("0.002", "2", "2000", "0", "x", None, "0.0995 s", "nan")] == [2000, 2000, 2000, 2000, 2000, 2000, 99_500, 2000]
    raw = seg2.encode([np.ones(5), np.ones(6)], [{}, {}], 1)
    assert seg2.decode(b"no")[0]["error"] and seg2.decode(raw[:2])[0]["error"] == "no traces"
    assert seg2.decode(raw[:-1])[-1]["error"] == "trace 1 has a senseless block"
    many = bytearray(raw)
    many[36:40] = many[32:36]  # two traces of one block: the second would go over the file's bytes in the long run
    assert len(seg2.decode(bytes(many))) == 2
    assert seg2.decode(raw[:6] + b"\xff\x3f" + raw[8:])[-1]["error"]
    r = random.Random(2)
    for k in range(600):
        b = bytearray(raw if k % 3 else b"\x55\x3a" + r.randbytes(r.randrange(300)))
        for _ in range(r.randrange(9)):
            b[r.randrange(2, len(b))] = r.randrange(256)
        rows = seg2.decode(bytes(b[: r.randrange(len(b) + 1)]))
        assert sum(len(x.get("samples", ())) for x in rows) <= len(b)


@pytest.mark.parametrize("labels, ebcdic", [(True, False), (True, True), (False, False)])
def test_tape_images(spark, tmp_path, labels, ebcdic):
    register(spark)
    parts = [file_bytes([30] * 20, seed=4), file_bytes([44] * 9, code=3, order="little", seed=5)]
    other = seg2.encode([np.ones(5)], [{"CHANNEL_NUMBER": "1"}])
    files = [("line one", parts[0][0]), ("a record", other), ("line two", parts[1][0]), ("segd", segd.encode([np.ones(3)]))]
    put(f"{tmp_path}/a.tpimage", tape.encode(files, labels, ebcdic))
    found = tape.blocks(spark, str(tmp_path)).orderBy("block").collect()
    assert [(b.kind, b.length, b.error) for b in found] == [(k, len(c), None) for k, (_, c) in zip(("segy", "seg2", "segy", "segd"), files, strict=True)]
    assert [b.name for b in found] == ([n for n, _ in files] if labels else [None] * 4)
    held = tape.block_bytes(tape.blocks(spark, str(tmp_path)).where("kind = 'seg2'")).first()
    assert bytes(held.content) == other
    rows = spark.read.format("segy").option("splitBytes", 3000).load(str(tmp_path)).orderBy("record", "trace_idx").collect()
    good = [r for r in rows if r.error is None]
    assert [r.record for r in good] == [0] * 20 + [2] * 9 and [r.trace_idx for r in good] == list(range(29)) and [r.error for r in rows if r.error] == [f"a block of {len(other)} bytes is no SEG-Y", f"a block of {len(files[3][1])} bytes is no SEG-Y"]
    assert all(np.array_equal(np.float32(r.samples), x) for r, x in zip(good, parts[0][1] + parts[1][1], strict=True))
    assert len(plan(f"{tmp_path}/a.tpimage", 3000)) > 4


def test_cut_and_empty_tapes(spark, tmp_path):
    raw, _ = file_bytes([30] * 20)
    image = tape.encode([("one", raw), ("two", raw)])
    put(f"{tmp_path}/cut", image[: len(image) - len(raw) // 2])
    got = tape.blocks(spark, str(tmp_path)).orderBy("block").collect()
    assert [b.error for b in got] == [None, "the block is cut off"]
    assert [r.error for r in plan(f"{tmp_path}/cut")][-1].endswith("is cut off")
    put(f"{tmp_path}/marks", tape.encode([]))
    assert tape.blocks(spark, f"{tmp_path}/marks").count() == 0 and plan(f"{tmp_path}/marks") == []


def test_byte_orders_and_text_blocks():
    raw, _ = file_bytes([10] * 3, order="little", code=5)
    assert segy.scan(raw)["order"] == "little"
    assert segy.scan(file_bytes([10] * 3, extended=-1, revision=0x0200)[0][:8000])["start"] is None
