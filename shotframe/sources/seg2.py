"""SEG-2 records: ``binaryFile`` rows decoded a record at a time, and the keywords of their traces as header words.

A file begins with its mark, the number of traces and its separators; pointers from byte 32 on lead to the trace blocks, each with
strings (a two-byte offset to the next one before each, or, in files of lenient writers, lines between separators), followed by the samples:
16- or 32-bit integers, 20-bit integers, 32- or 64-bit floats. A trace may not claim more samples than its block has bytes, nor all
traces together more than the file. What can't be read is told in ``error``, on the last trace or on a row without trace.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotframe.functions import scalars

from .packed import MOST_SAMPLES, bytes_of_20, decoded, read_20, write_20

TRACES = "path string, trace_idx int, format int, n_samples int, interval_us int, strings map<string, string>, samples array<float>, error string"
# Formats -> numpy kind (3 is 20 bits), and the marks.
KINDS = {1: "<i2", 2: "<i4", 4: "<f4", 5: "<f8"}
MARKS, BLOCK = (b"\x55\x3a", b"\x3a\x55"), (0x4422, 0x2244)
# Header words by keyword: (word, keyword, place among its numbers, bits, factor).
WORDS = (
    ("field_record", "SHOT_SEQUENCE_NUMBER", 0, 32, 1), ("channel", "CHANNEL_NUMBER", 0, 32, 1), ("source_point", "SOURCE_STATION_NUMBER", 0, 32, 1), ("ensemble", "CDP_NUMBER", 0, 32, 1), ("trace_in_ensemble", "CDP_TRACE", 0, 32, 1),
    ("stacked", "STACK", 0, 16, 1), ("delay_ms", "DELAY", 0, 16, 1000), ("gain_db", "FIXED_GAIN", 0, 16, 1), ("alias_hz", "ALIAS_FILTER", 0, 16, 1), ("alias_slope", "ALIAS_FILTER", 1, 16, 1),
    ("notch_hz", "NOTCH_FREQUENCY", 0, 16, 1), ("low_cut_hz", "LOW_CUT_FILTER", 0, 16, 1), ("low_cut_slope", "LOW_CUT_FILTER", 1, 16, 1), ("high_cut_hz", "HIGH_CUT_FILTER", 0, 16, 1), ("high_cut_slope", "HIGH_CUT_FILTER", 1, 16, 1))
TRACE_TYPES = {"SEISMIC_DATA": 1, "DEAD": 2, "UPHOLE": 5}


def _small(raw: bytes, at: int, size: int) -> int:
    return int.from_bytes(raw[at : at + size], "little")


def _size(n: int, kind: int) -> int:
    return bytes_of_20(n) if kind == 3 else n * (np.dtype(KINDS[kind]).itemsize if kind in KINDS else 4)


def _pair(line: bytes) -> tuple[str, str] | None:
    text = "".join(chr(c) if 32 <= c < 127 else " " for c in line).strip()
    key, _, value = text.partition(" ")
    return (key, value.strip()) if text else None


def strings(block: bytes, separators: bytes = b"\n") -> dict[str, str]:
    """The strings of a trace block: chained by offsets if the first one is plausible, else between separators."""
    found, at = [], 0
    first = _small(block, 0, 2)
    if 3 <= first <= min(512, len(block)):
        while at + 2 <= len(block):
            step = _small(block, at, 2)
            if step < 3 or at + step > len(block):
                break
            found.append(_pair(block[at + 2 : at + step].split(b"\0")[0]))
            at += step
    else:
        for mark in {b"\0", *(separators[k : k + 1] for k in range(len(separators)))}:
            block = block.replace(mark, b"\n")
        found = [_pair(line) for line in block.split(b"\n")]
    return dict(x for x in found if x)


def interval_us(value: str | None) -> int:
    """The sample interval: seconds below 0.1, milliseconds up to 200, else microseconds; 2000 where there is none."""
    try:
        v = float((value or "").split()[0])
    except (IndexError, ValueError):
        return 2000
    if not v > 0 or not math.isfinite(v):
        return 2000
    return math.floor(v * (1e6 if v < 0.1 else 1e3 if v <= 200 else 1) + 0.5)


def decode(raw: bytes) -> list[dict]:
    """The traces of a record, with its fault on the last one; one row without trace if there is none."""
    if raw[:2] not in MARKS:
        return [{"error": "not the mark of a SEG-2 file"}]
    declared, ends, error, out = _small(raw, 6, 2), raw[10] if len(raw) > 10 else 0, None, []
    lines = 11 + ends
    separators = (raw[11:12] if ends else b"\0") + (raw[lines + 1 : lines + 2] if raw[lines : lines + 1] not in (b"", b"\0") else b"\n")
    budget = max(0, len(raw) - 32)
    for k in range(declared):
        at = _small(raw, 32 + 4 * k, 4)
        if not at or at + 32 > len(raw):
            error = f"trace {k} lies outside the file"
            break
        size, held, n, kind = _small(raw, at + 2, 2), _small(raw, at + 4, 4), _small(raw, at + 8, 4), _small(raw, at + 12, 2)
        if _small(raw, at, 2) not in BLOCK:
            error = f"trace {k} has no trace block"
            break
        data = at + size
        if size < 32 or data + held > len(raw) or not 0 < n <= MOST_SAMPLES:
            error = f"trace {k} has a senseless block"
            break
        room = min(held or len(raw) - data, len(raw) - data, budget)
        n = min(n, room * 2 // 5 if kind == 3 else room // (_size(1, kind)))
        if n <= 0:
            error = f"trace {k} has no samples"
            break
        budget -= _size(n, kind)
        said = strings(raw[at + 32 : data], separators)
        samples = read_20(raw, data, n, False) if kind == 3 else np.frombuffer(raw, KINDS.get(kind, "<f4"), n, data).astype(np.float32)
        out.append({"trace_idx": k, "format": kind, "n_samples": n, "strings": said, "samples": samples})
    for row in out:
        row["interval_us"] = interval_us(next((r["strings"] for r in out if r["strings"]), {}).get("SAMPLE_INTERVAL"))
    if not out:
        return [{"error": error or "no traces"}]
    out[-1]["error"] = error
    return out


def encode(traces: list[np.ndarray], said: list[dict[str, str]], kind: int = 4, chained: bool = True) -> bytes:
    """A record in one format; strings chained by offsets, or as lenient lines."""
    head = bytearray(32 + 4 * len(traces))
    head[0:2], head[2:4], head[4:6], head[6:8] = MARKS[0], (1).to_bytes(2, "little"), (4 * len(traces)).to_bytes(2, "little"), len(traces).to_bytes(2, "little")
    head[8:14] = b"\0\0\x01\0\x01\n"
    out, at = [], len(head)
    for k, (x, words) in enumerate(zip(traces, said, strict=True)):
        items = [f"{key} {value}".encode() + b"\0" for key, value in words.items()]
        text = b"".join((len(i) + 2).to_bytes(2, "little") + i for i in items) + b"\0\0" if chained else b"".join(i[:-1] + b"\n" for i in items)
        text += bytes(-len(text) % 4)
        body = write_20(x, False) if kind == 3 else np.asarray(x).astype(KINDS[kind]).tobytes()
        block = bytearray(32)
        block[0:2], block[2:4], block[4:8], block[8:12], block[12:14] = BLOCK[0].to_bytes(2, "little"), (32 + len(text)).to_bytes(2, "little"), len(body).to_bytes(4, "little"), len(x).to_bytes(4, "little"), kind.to_bytes(2, "little")
        head[32 + 4 * k : 36 + 4 * k] = at.to_bytes(4, "little")
        out += [bytes(block), text, body]
        at += 32 + len(text) + len(body)
    return bytes(head) + b"".join(out)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """A row for each trace of the SEG-2 files of a path or glob; a record is the unit, megabytes each."""

    return decoded(spark, path, decode, TRACES)


def numbers(value: Column) -> Column:
    """The numbers at the beginning of a value, array<double>."""
    lead = F.regexp_extract(F.trim(value), r"^(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:\s+|$))*", 0)
    return F.transform(F.filter(F.split(lead, r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))


def whole_word(v: Column, bits: int) -> Column:
    """v as a whole number that fits; null for 0."""
    n = F.floor(v + 0.5)
    return F.when((n != 0) & n.between(-(2 ** (bits - 1)), 2 ** (bits - 1) - 1), n.cast("int"))


def header_words(traces: DataFrame) -> DataFrame:
    """traces with header words from their keywords; places share one coordinate scalar a file, the weakest that keeps all decimals."""
    said = F.col("strings")
    keys = dict.fromkeys([k for _, k, *_ in WORDS] + ["SOURCE_LOCATION", "RECEIVER_LOCATION"])
    # One struct of numbers by keyword first, so that no value is read twice.
    out = traces.withColumn("given", F.struct(*[numbers(said[k]).alias(k) for k in keys]))
    given = lambda key, i: F.get(F.col(f"given.{key}"), F.lit(i))
    out = out.withColumns({w: whole_word(given(k, i) * f, bits) for w, k, i, bits, f in WORDS})
    kind = F.upper(F.trim(said["TRACE_TYPE"]))
    places = {}
    for side, key in (("source", "SOURCE_LOCATION"), ("receiver", "RECEIVER_LOCATION")):
        places |= {f"{side}_x": given(key, 0), f"{side}_y": F.when(F.size(f"given.{key}") >= 3, given(key, 1))}
    out = out.withColumns({
        **{slope: F.when(F.col(of).isNotNull(), F.col(slope)) for slope, of in (("alias_slope", "alias_hz"), ("low_cut_slope", "low_cut_hz"), ("high_cut_slope", "high_cut_hz"))},
        "trace_id": F.coalesce(*[F.when(kind == name, v) for name, v in TRACE_TYPES.items()]), **places})
    out = out.withColumn("given", F.coalesce(*places).isNotNull())
    out = scalars.with_scalar(out, "coordinate_scalar", Window.partitionBy("path"), *places)
    out = out.withColumns({name: whole_word(scalars.encode_scalar(F.col(name), F.col("coordinate_scalar")), 32) for name in places})
    return out.withColumn("coordinate_scalar", F.when(F.col("given"), F.col("coordinate_scalar"))).drop("given")
