"""SEG-D field records, demultiplexed, revisions 1 to 3: ``binaryFile`` rows decoded a record at a time.

A record is a chain of blocks: general headers (the first says how many more there are, or refers to the second), channel set
descriptors (32 bytes, from revision 3 on 96), extended and external headers, then the traces, each with a header of 20 bytes and
as many 32-byte extensions as it says. A trace's number of samples is that of its first extension, else its channel set's, else what is
left. What can't be read is told in ``error``: of the record, on its last trace, or on a row without trace if there is none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .packed import MOST_SAMPLES, bytes_of_20, decoded, read_20, read_24, write_20, write_24

TRACES = (
    "path string, trace_idx int, file_number int, revision int, format_code int, scan_type int, channel_set int, channel_type int, trace_number int, interval_us double, n_samples int, "
    "extensions int, receiver_line int, receiver_point int, receiver_index int, sensor int, block_types string, samples array<float>, error string")  # fmt: skip
# Format codes by the bits of a sample; any other is read as 20 bits, with an error.
BITS = {8058: 32, 32: 32, 8032: 32, 8036: 24, 36: 24, 8068: 24, 68: 24, 8015: 20}
#: Blocks and channel sets that a header may claim.
MOST_SETS = 1024


def _number(raw: bytes, at: int, size: int, sign: bool = False) -> int:
    return int.from_bytes(raw[at : at + size], "big", signed=sign)


def _bcd(raw: bytes, at: int, size: int) -> int:
    out = 0
    for b in raw[at : at + size]:
        out = out * 100 + (b >> 4) * 10 + (b & 15)
    return out


@dataclass
class ChannelSet:
    scan_type: int
    number: int
    kind: int
    channels: int
    samples: int
    interval: float


@dataclass
class Record:
    file_number: int
    revision: int
    code: int
    interval: float
    sets: list[ChannelSet]
    start: int

    @property
    def seismic(self) -> ChannelSet | None:
        """The set whose values stand in for those a trace lacks."""
        return next((s for s in self.sets if s.kind == (0x10 if self.revision >= 3 else 1)), self.sets[0] if self.sets else None)

    @property
    def channels(self) -> int:
        return sum(s.channels for s in self.sets)


def _block_counts(raw: bytes, revision: int) -> tuple[int, int, int, int]:
    """More general headers, channel sets of a scan type, extended and external headers; values that don't fit the first header are in the second."""
    more, sets, extended, external = raw[11] >> 4, raw[28], raw[30], raw[31]
    second = raw[32:64] if more else bytes(32)
    far = lambda v, at: _number(second, at, 2) if v == 0xFF else _bcd(bytes([v]), 0, 1)
    if more == 15:
        more = second[23] if revision >= 3 else 15
    return more, far(sets, 3), far(extended, 5), far(external, 28 if revision >= 3 else 7)


def _channel_set(raw: bytes, at: int, revision: int, base: float) -> ChannelSet:
    if revision >= 3:
        interval = _number(raw, at + 23, 3) or base
        start, end, samples = (_number(raw, at + k, 4) for k in (4, 8, 12))
        if not samples and interval:
            samples = round((end - start) / interval)  # the end lies one interval after the last sample
        found = ChannelSet(raw[at], _number(raw, at + 1, 2), raw[at + 3], _number(raw, at + 20, 3), samples, interval)
    else:
        interval = base or 2000.0
        start, end = 2 * _number(raw, at + 2, 2), 2 * _number(raw, at + 4, 2)
        found = ChannelSet(_bcd(raw, at, 1), _bcd(raw, at + 1, 1), raw[at + 10] >> 4, _bcd(raw, at + 8, 2), round(1000 * (end - start) / interval) + 1, interval)
    found.samples = min(max(found.samples, 0), MOST_SAMPLES)
    return found


def scan(raw: bytes) -> Record:
    """The headers of a record; raises ValueError if it is too short for them."""
    if len(raw) < 64:
        raise ValueError("shorter than its general headers")
    revision = raw[42] if raw[11] >> 4 and 1 <= raw[42] <= 3 else 1
    more, sets, extended, external = _block_counts(raw, revision)
    wide = _number(raw, 0, 2) == 0xFFFF
    file_number = (_number(raw, 32, 3) if raw[11] >> 4 else 0) if wide else _bcd(raw, 0, 2)
    base, at, size = 62.5 * raw[22], 32 * (1 + more), 96 if revision >= 3 else 32
    found = []
    for _ in range(min((_bcd(raw, 27, 1) or 1) * max(sets, 1), MOST_SETS)):
        if at + size > len(raw):
            raise ValueError("ends inside its channel sets")
        found.append(_channel_set(raw, at, revision, base))
        at += size
    return Record(file_number, revision, _bcd(raw, 2, 2), base, found, at + 32 * (extended + external))


def _samples(raw: bytes, at: int, n: int, bits: int) -> np.ndarray:
    return np.frombuffer(raw, ">f4", n, at).astype(np.float32) if bits == 32 else read_24(raw, at, n) if bits == 24 else read_20(raw, at, n, True)


def _size(n: int, bits: int) -> int:
    return bytes_of_20(n) if bits == 20 else n * bits // 8


def _extension(raw: bytes, at: int, count: int, revision: int) -> dict:
    """Values of a trace's first extension, and the types of all."""
    if not count:
        return {}
    line, point = _number(raw, at, 3, True), _number(raw, at + 3, 3, True)
    line = _number(raw, at + 10, 3, True) if line in (0, -1) else line
    point = _number(raw, at + 15, 3, True) if point in (0, -1) else point
    types = ",".join(f"{raw[at + 32 * k + 31]:02x}" for k in range(count)) if revision >= 3 and count > 1 else None
    known = lambda v: v if v not in (0, -1) else None
    return {"receiver_line": known(line), "receiver_point": known(point), "receiver_index": raw[at + 6] or None, "sensor": raw[at + 20] or None, "block_types": types}


def decode(raw: bytes) -> list[dict]:
    """The traces of a record, with its fault on the last one; one row without trace if there is none."""
    try:
        record = scan(raw)
    except ValueError as problem:
        return [{"error": str(problem)}]
    bits, seismic = BITS.get(record.code, 20), record.seismic
    error = None if record.code in BITS else f"format code {record.code} is not known, read as 20 bits"
    by_number = {(s.scan_type, s.number): s for s in reversed(record.sets)}
    at, out = record.start, []
    while at + 20 <= len(raw) and (not record.channels or len(out) < record.channels):
        extensions, first = raw[at + 9], at + 20
        data = first + 32 * extensions
        room = min((len(raw) - data) * 8 // bits, MOST_SAMPLES)
        if data >= len(raw):
            break
        own = by_number.get((_bcd(raw, at + 2, 1), _bcd(raw, at + 3, 1)), seismic)
        n = (_number(raw, first + 24, 4) if record.revision >= 3 else _number(raw, first + 7, 3)) if extensions else 0
        if not 1 <= n <= MOST_SAMPLES:
            n = own.samples if own and own.samples else room
        if n > room:
            n, error = room, f"trace {len(out) + 1} is cut off"
        if n <= 0:
            break
        wide_file, wide_trace = _number(raw, at, 2) == 0xFFFF, _number(raw, at + 4, 2) == 0xFFFF
        number = _number(raw, first + 21, 3) if wide_trace and record.revision >= 3 and extensions else _bcd(raw, at + 4, 2)
        out.append({
            "trace_idx": len(out), "file_number": (_number(raw, at + 17, 3) if wide_file else _bcd(raw, at, 2)) or record.file_number, "revision": record.revision, "format_code": record.code,
            "scan_type": _bcd(raw, at + 2, 1), "channel_set": _bcd(raw, at + 3, 1), "channel_type": own.kind if own else None, "trace_number": number, "interval_us": own.interval if own else record.interval or 2000.0, "n_samples": n,
            "extensions": extensions, **_extension(raw, first, extensions, record.revision), "samples": _samples(raw, data, n, bits)})
        at = data + _size(n, bits)
    if record.channels and len(out) < record.channels:
        error = error or f"{record.channels} traces declared, {len(out)} read"
    if not out:
        return [{"file_number": record.file_number, "revision": record.revision, "format_code": record.code, "error": error or "no traces"}]
    out[-1]["error"] = error
    return out


def _bcd_bytes(v: int, size: int) -> bytes:
    return bytes(int(x) // 10 << 4 | int(x) % 10 for x in [v // 100**k % 100 for k in reversed(range(size))])


def encode(traces: list[np.ndarray], code: int = 8058, revision: int = 2, file_number: int = 1, interval_us: float = 2000.0, line: int = 1, first_point: int = 1, extended: int = 0, external: int = 0, kinds: list[int] | None = None) -> bytes:
    """A record of a channel set for each kind (all seismic by default), its traces dealt out in order; file numbers over 9999 are written wide."""
    bits, seismic = BITS[code], 0x10 if revision >= 3 else 1
    kinds = kinds or [seismic]
    per = -(-len(traces) // len(kinds))
    groups = [traces[k * per : (k + 1) * per] for k in range(len(kinds))]
    head, second = bytearray(32), bytearray(32)
    head[0:2] = b"\xff\xff" if file_number > 9999 else _bcd_bytes(file_number, 2)
    head[2:4], head[10], head[11], head[12], head[22], head[27], head[28] = _bcd_bytes(code % 10_000, 2), 0x24, 0x10, 0x01, int(interval_us / 62.5), 0x01, 0xFF if len(kinds) > 99 else _bcd_bytes(len(kinds), 1)[0]
    head[30], head[31] = _bcd_bytes(extended, 1)[0], _bcd_bytes(external, 1)[0]
    second[0:3], second[3:5], second[10] = file_number.to_bytes(3, "big"), len(kinds).to_bytes(2, "big"), revision
    sets = []
    for k, (kind, group) in enumerate(zip(kinds, groups, strict=True), 1):
        n = len(group[0]) if group else 0
        d = bytearray(96 if revision >= 3 else 32)
        if revision >= 3:
            d[0], d[1:3], d[3], d[8:12], d[12:16], d[20:23], d[23:26], d[27] = 1, k.to_bytes(2, "big"), kind, int(n * interval_us).to_bytes(4, "big"), n.to_bytes(4, "big"), len(group).to_bytes(3, "big"), int(interval_us).to_bytes(3, "big"), 1
        else:
            d[0], d[1], d[4:6], d[8:10], d[10], d[28] = 1, _bcd_bytes(k, 1)[0], int((n - 1) * interval_us / 2000).to_bytes(2, "big") if n else b"\0\0", _bcd_bytes(len(group), 2), kind << 4, 1
        sets.append(bytes(d))
    out, nth = [bytes(head), bytes(second), *sets, bytes(32 * (extended + external))], 0
    for k, group in enumerate(groups, 1):
        for j, x in enumerate(group, 1):
            t, e = bytearray(20), bytearray(32)
            t[0:2] = b"\xff\xff" if file_number > 9999 else _bcd_bytes(file_number, 2)
            t[2], t[3], t[4:6], t[9], t[17:20] = 1, _bcd_bytes(k % 100, 1)[0], b"\xff\xff" if j > 9999 else _bcd_bytes(j, 2), 1, file_number.to_bytes(3, "big")
            e[0:3], e[3:6], e[6], e[20] = line.to_bytes(3, "big"), (first_point + nth).to_bytes(3, "big"), 1, 2
            if revision >= 3:
                e[21:24], e[24:28], e[31] = j.to_bytes(3, "big"), len(x).to_bytes(4, "big"), 0x40
            else:
                e[7:10] = len(x).to_bytes(3, "big")
            body = np.asarray(x, ">f4").tobytes() if bits == 32 else write_24(x) if bits == 24 else write_20(x, True)
            out += [bytes(t), bytes(e), body]
            nth += 1
    return b"".join(out)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """A row for each trace of the SEG-D files of a path or glob; a record is the unit, megabytes each."""

    return decoded(spark, path, decode, TRACES)
