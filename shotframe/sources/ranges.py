"""Large SEG-Y files in byte ranges: the data source ``segy``.

Planning reads headers only. A file that declares traces of one length is cut by arithmetic; any other is walked header by header,
with a seek from one to the next, also across whole records that follow one another in one file (each with its own text and binary
header, byte order and sample format) and block by block through a tape image. Ranges end between traces and hold about ``splitBytes`` each, so a file of any size is read
by many tasks, and a task reads its range in pieces of PIECE bytes. Every task checks the lengths of its own traces again.

    register(spark)  # also lets Spark hand filters to Python sources in this session
    spark.read.format("segy").option("splitBytes", 64 << 20).load(path)

Columns are those of ``TRACES``; with a schema that leaves ``samples`` out only trace headers are read. Filters on trace_idx, record and
path choose among the ranges. What can't be read is a row with ``error`` and without samples: a file with senseless headers, bytes
after the last whole trace (a cut-off trace), a trace of another length in a file of one length. An empty folder gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .files import length, listed, opened
from .segy import BINARY, HEADER, TEXT, WIDTHS, WORDS, header_words, samples_of, scan
from .tape import is_tape, kind_of, walk

SPLIT_BYTES, PIECE, HEAD = 64 << 20, 8 << 20, 64 << 10
#: Headers of files that planning reads at a time.
PLANNERS = 16
#: Headers that must agree before a file that declares traces of one length is cut by arithmetic.
PROBES = 64
OTHER_LENGTH = "a trace of another length than its file declares"
TRACES = "path string, record int, trace_idx long, position long, " + ", ".join(f"{n} int" for n in WORDS) + ", samples array<float>, error string"


@dataclass(frozen=True)
class Layout:
    """How the traces of a record are written."""

    order: str
    code: int
    samples: int
    interval: int
    extra: int
    fixed: bool

    def size(self, n: int) -> int:
        return HEADER + self.extra + n * WIDTHS[self.code]


@dataclass
class Range(InputPartition):
    """Traces of one record between two offsets; first and last are the numbers of its traces in the file."""

    path: str
    record: int
    first: int
    last: int
    begin: int
    end: int
    layout: Layout | None
    error: str | None = None


def _head(f, at: int, size: int) -> tuple[Layout, int]:
    """The layout of the record at a place and where its traces begin."""
    take = HEAD
    while True:
        f.seek(at)
        raw = f.read(min(take, size - at))
        h = scan(raw)
        if h["start"] is not None:
            return Layout(h["order"], h["format"], h["samples"], h["interval"], h["extra"], h["fixed"]), at + h["start"]
        if take >= size - at:
            raise ValueError("its text blocks have no end")
        take *= 4


def _trace(f, at: int, size: int, layout: Layout) -> int:
    """Samples of the trace at a place; 0 if there is none that fits the file and agrees with its record's length or interval."""
    f.seek(at + 114)
    words = f.read(4)
    if len(words) < 4:
        return 0
    n, interval = int.from_bytes(words[:2], layout.order) or layout.samples, int.from_bytes(words[2:], layout.order)
    agrees = n == layout.samples or not layout.interval or interval in (0, layout.interval)
    return n if agrees and n and at + layout.size(n) <= size else 0


def _says(f, at: int, layout: Layout) -> int:
    """The number of samples that the trace header at a place gives itself."""
    f.seek(at + 114)
    return int.from_bytes(f.read(2), layout.order)


def _new_record(f, at: int, size: int) -> tuple[Layout, int] | None:
    """The record whose headers begin at a place, if a trace follows them."""
    if at + TEXT + BINARY + HEADER > size:
        return None
    try:
        layout, start = _head(f, at, size)
    except ValueError:
        return None
    return (layout, start) if layout.samples and _trace(f, start, size, layout) else None


def _window(f, path: str, begin: int, size: int, split_bytes: int, record: int = 0, first: int = 0) -> list[Range]:
    """The ranges of the bytes from begin to size."""
    out: list[Range] = []
    try:
        layout, at = _head(f, begin, size)
    except ValueError as problem:
        return [Range(path, record, first, first, begin, begin, None, str(problem))]
    begin, begin_first = at, first

    def cut(end: int, then: int) -> None:
        nonlocal begin, begin_first
        if end > begin:
            out.append(Range(path, record, begin_first, then - 1, begin, end, layout))
        begin, begin_first = end, then

    while True:
        n = _trace(f, at, size, layout)
        if n and layout.fixed and layout.samples in (0, n):
            # Traces of one length up to the end, unless another record begins on the way and puts the rest out of step.
            step = layout.size(n)
            count = (size - at) // step
            if all(_says(f, at + k * step, layout) == n for k in {count - 1, *range(0, count, max(1, count // PROBES))}):
                per = max(1, split_bytes // step)
                for k in range(0, count, per):
                    cut(at + min(count, k + per) * step, first + min(count, k + per))
                at, first = at + count * step, first + count
                break
        if n:
            at, first = at + layout.size(n), first + 1
            if at - begin >= split_bytes:
                cut(at, first)
            continue
        found = _new_record(f, at, size)
        if found is None:
            break
        cut(at, first)
        layout, at = found
        begin, record = at, record + 1
    cut(at, first)
    if at < size:
        out.append(Range(path, record, first, first, at, at, None, f"{size - at} bytes after the last whole trace"))
    return out


def plan(path: str, split_bytes: int = SPLIT_BYTES) -> list[Range]:
    """The ranges of a file, from its headers; of a tape image those of all its blocks, numbered on."""
    with opened(path) as f:
        size = length(f)
        f.seek(0)
        if not is_tape(f.read(min(size, HEAD)), size):
            return _window(f, path, 0, size, split_bytes)
        out: list[Range] = []
        for _, begin, n, whole in walk(f):
            record, first = (out[-1].record + 1, out[-1].last + (out[-1].error is None)) if out else (0, 0)
            f.seek(begin)
            kind = kind_of(f.read(min(n, HEAD)), n) if whole else None
            if kind == "segy":
                out += _window(f, path, begin, begin + n, split_bytes, record, first)
            else:
                out.append(Range(path, record, first, first, begin, begin, None, f"a block of {n} bytes is {'cut off' if kind is None else 'no SEG-Y'}"))
        return out


class SegyReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.arrow = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in schema.fields])
        self.path, self.split = options["path"], int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for x in filters:
            if len(x.attribute) == 1 and x.attribute[0] in ("path", "record", "trace_idx") and isinstance(x, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.filters.append(x)
            yield x  # ranges are coarser than rows, so Spark filters as well

    def _wanted(self, r: Range) -> bool:
        spans = {"path": (r.path, r.path), "record": (r.record, r.record), "trace_idx": (r.first, r.last)}
        for x in self.filters:
            low, high = spans[x.attribute[0]]
            if isinstance(x, (EqualTo, In)):
                keep = any(low <= v <= high for v in (x.value if isinstance(x, In) else [x.value]))
            elif isinstance(x, GreaterThan):
                keep = high > x.value
            elif isinstance(x, GreaterThanOrEqual):
                keep = high >= x.value
            else:
                keep = low < x.value if isinstance(x, LessThan) else low <= x.value
            if not keep:
                return False
        return True

    def partitions(self) -> list[Range]:
        with ThreadPoolExecutor(PLANNERS) as pool:
            found = [r for ranges in pool.map(lambda p: plan(p, self.split), listed(self.path)) for r in ranges]
        return [r for r in found if self._wanted(r)] or [Range("", 0, 0, 0, 0, 0, None)]

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        if r.layout is None:
            if r.error:
                yield self._batch({"path": [r.path], "record": [r.record], "trace_idx": [r.first], "position": [r.begin], "error": [r.error]}, 1)
            return
        with opened(r.path) as f:
            yield from self._whole(f, r) if "samples" in self.columns or r.end - r.begin < 4 * HEADER else self._headers(f, r)

    def _batch(self, values: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values.get(x.name, [None] * n), x.type) for x in self.arrow], schema=self.arrow)

    def _rows(self, r: Range, first: int, offsets: list[int], heads: list[bytes], samples: list | None, error: str | None = None) -> pa.RecordBatch:
        n = len(offsets)
        values: dict = header_words(np.frombuffer(b"".join(heads), np.uint8).reshape(-1, HEADER), r.layout.order) if heads else {}
        values |= {"path": [r.path] * n, "record": [r.record] * n, "trace_idx": np.arange(first, first + n), "position": offsets, "error": [error or ("samples of format 4 are not decoded" if r.layout.code == 4 else None)] * n}
        if samples is not None:
            values["samples"] = samples
        return self._batch(values, n)

    def _checked(self, r: Range, head: bytes, at: int) -> int:
        """Bytes of the trace at a place, or 0 if it leaves the range."""
        n = int.from_bytes(head[114:116], r.layout.order) or r.layout.samples
        size = r.layout.size(n)
        return size if n and at + size <= r.end and not (r.layout.fixed and r.layout.samples not in (0, n)) else 0

    def _whole(self, f, r: Range) -> Iterator[pa.RecordBatch]:
        f.seek(r.begin)
        raw, base, first = b"", r.begin, r.first
        while base < r.end:
            raw += f.read(min(PIECE, r.end - base - len(raw)))
            at, size, offsets, heads, samples = 0, 1, [], [], []
            while at + HEADER <= len(raw):
                size = self._checked(r, raw[at : at + HEADER], base + at)
                if not size or at + size > len(raw):
                    break
                offsets.append(base + at)
                heads.append(raw[at : at + HEADER])
                samples.append(samples_of(raw, at + HEADER + r.layout.extra, (size - HEADER - r.layout.extra) // WIDTHS[r.layout.code], r.layout.code, r.layout.order))
                at += size
            if offsets:
                yield self._rows(r, first, offsets, heads, samples)
            raw, base, first = raw[at:], base + at, first + len(offsets)
            if base < r.end and (not size or base + len(raw) >= r.end):
                yield self._rows(r, first, [base], [], None, OTHER_LENGTH)
                return

    def _headers(self, f, r: Range) -> Iterator[pa.RecordBatch]:
        at, first, offsets, heads = r.begin, r.first, [], []
        while at < r.end:
            f.seek(at)
            head = f.read(HEADER)
            size = self._checked(r, head, at)
            if not size:
                break
            offsets.append(at)
            heads.append(head)
            at += size
            if len(offsets) == 10_000:
                yield self._rows(r, first, offsets, heads, None)
                first, offsets, heads = first + len(offsets), [], []
        if offsets:
            yield self._rows(r, first, offsets, heads, None)
        if at < r.end:
            yield self._rows(r, first + len(offsets), [at], [], None, OTHER_LENGTH)


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<float>": pa.list_(pa.float32())}[kind]


class SegySource(DataSource):
    """SEG-Y files of a path, in byte ranges; option ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "segy"

    def schema(self) -> str:
        return TRACES

    def reader(self, schema: StructType) -> SegyReader:
        return SegyReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters."""
    spark.dataSource.register(SegySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
