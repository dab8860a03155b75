"""Field records: 20- and 24-bit integers as numpy arrays, both ways, and decoded records as Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Arrow types of the columns that records have.
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<float>": pa.list_(pa.float32()), "map<string, string>": pa.map_(pa.string(), pa.string())}

MOST_SAMPLES = 1 << 24


def signed(x: np.ndarray, bits: int) -> np.ndarray:
    return np.where(x >= 1 << (bits - 1), x - (1 << bits), x)


def bytes_of_20(n: int) -> int:
    return -(-5 * n // 2)


def read_20(raw: bytes, at: int, n: int, high_first: bool) -> np.ndarray:
    """n 20-bit integers, two in five bytes: the first in the leading 20 bits (high_first), or in the low 20 bits of a little-endian group."""
    b = np.frombuffer(raw[at : at + bytes_of_20(n)] + b"\0\0\0", np.uint8, 5 * (-(-n // 2))).reshape(-1, 5).astype(np.int64)
    if high_first:
        pair = [b[:, 0] << 12 | b[:, 1] << 4 | b[:, 2] >> 4, (b[:, 2] & 15) << 16 | b[:, 3] << 8 | b[:, 4]]
    else:
        pair = [b[:, 0] | b[:, 1] << 8 | (b[:, 2] & 15) << 16, b[:, 2] >> 4 | b[:, 3] << 4 | b[:, 4] << 12]
    return signed(np.stack(pair, 1).ravel()[:n], 20).astype(np.float32)


def write_20(x: np.ndarray, high_first: bool) -> bytes:
    v = np.append(np.asarray(x).astype(np.int64) & 0xFFFFF, np.zeros(len(x) % 2, np.int64)).reshape(-1, 2)
    a, c = v[:, 0], v[:, 1]
    if high_first:
        b = [a >> 12, a >> 4 & 255, (a & 15) << 4 | c >> 16, c >> 8 & 255, c & 255]
    else:
        b = [a & 255, a >> 8 & 255, a >> 16 | (c & 15) << 4, c >> 4 & 255, c >> 12]
    return np.stack(b, 1).astype(np.uint8).tobytes()[: bytes_of_20(len(x))]


def read_24(raw: bytes, at: int, n: int) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3).astype(np.int64)
    return signed(b[:, 0] << 16 | b[:, 1] << 8 | b[:, 2], 24).astype(np.float32)


def write_24(x: np.ndarray) -> bytes:
    v = np.asarray(x).astype(np.int64)
    return np.stack([v >> 16 & 255, v >> 8 & 255, v & 255], 1).astype(np.uint8).tobytes()


def decoded(spark: SparkSession, path: str, decode: Callable[[bytes], list[dict]], columns: str) -> DataFrame:
    """The rows that decode gives for each file of a path or glob, and the file's path; a file is the unit."""
    kinds = {name: ARROW[kind] for name, kind in (x.split(" ", 1) for x in re.split(r", (?=\w+ )", columns))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = [{**row, "path": name.as_py()} for row in decode(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([_plain(r.get(c)) for r in rows], t) for c, t in kinds.items()], names=list(kinds))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, columns)


def _plain(v):
    return list(v.items()) if isinstance(v, dict) else v
