"""Tape images: blocks, each after its length in four bytes, with labels of 80 bytes and tape marks of length 0 between the data blocks.

A walk seeks from one length to the next, so that a file of any size is walked without reading its data; what it finds goes on as rows:
the embedded files by name and kind, of which SEG-Y blocks are read in byte ranges by the ``segy`` source (which recognises a tape
image by itself), and small SEG-2 or SEG-D records as bytes. A block that is longer than the rest of its file ends the walk with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .files import length, opened

LABEL = 80
# The labels of tapes.
LABELS = ("VOL1", "HDR1", "HDR2", "EOF1", "EOF2", "EOV1")
BLOCKS = "path string, block int, name string, kind string, begin long, length long, error string"


def label(raw: bytes) -> str | None:
    """The text of a label block in ASCII or EBCDIC; None if it is none."""
    for code in ("latin-1", "cp037"):
        text = raw.decode(code, "replace")
        if len(raw) == LABEL and text[:4] in LABELS:
            return text
    return None


def kind_of(head: bytes, size: int) -> str:
    """What a data block holds, by its first bytes."""
    from .segy import BINARY, TEXT, scan

    if head[:2] in (b"\x55\x3a", b"\x3a\x55"):
        return "seg2"
    try:
        found = scan(head)
        if size >= TEXT + BINARY and found["samples"] and 1 <= int.from_bytes(head[TEXT + 24 : TEXT + 26], found["order"]):
            return "segy"
    except ValueError:
        pass
    # A SEG-D record: two BCD numbers first, the second a known format code.
    if len(head) >= 64 and head[2:4] in (b"\x80\x58", b"\x80\x36", b"\x80\x15") and all(b >> 4 < 10 and b & 15 < 10 for b in head[10:11]):
        return "segd"
    return "unknown"


def walk(f) -> Iterator[tuple[str | None, int, int, bool]]:
    """(name, begin, length, whole) of the data blocks of an open file; name is that of the last header label, if one came since the last data."""
    size, at, name = length(f), 0, None
    while at + 4 <= size:
        f.seek(at)
        n = int.from_bytes(f.read(4), "big")
        begin, at = at + 4, at + 4 + n
        if not n:
            continue
        if at > size:
            yield name, begin, size - begin, False
            return
        text = label(f.read(LABEL)) if n == LABEL else None
        if text is None:
            yield name, begin, n, True
            name = None
        elif text.startswith("HDR1"):
            name = text[4:21].strip() or "file"


def is_tape(head: bytes, size: int) -> bool:
    """Whether a file's first bytes are a label block, or a block with the headers of a SEG-Y file."""
    n = int.from_bytes(head[:4], "big")
    if n == LABEL:
        return label(head[4 : 4 + LABEL]) is not None
    return 3600 < n <= size - 4 and kind_of(head[4:], n) == "segy"


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The data blocks of the tape images of a path or glob, a row each; only lengths, labels and the blocks' first bytes are read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p in part["path"]:
                with opened(p) as f:
                    rows = []
                    for k, (name, begin, n, whole) in enumerate(walk(f)):
                        f.seek(begin)
                        head = f.read(min(n, 4096))
                        rows.append((p, k, name, kind_of(head, n) if whole else None, begin, n, None if whole else "the block is cut off"))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=[x.split()[0] for x in BLOCKS.split(", ")])
                            rows = []
                    yield pd.DataFrame(rows, columns=[x.split()[0] for x in BLOCKS.split(", ")])

    # Without content Spark lists the files and reads nothing of them.
    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, BLOCKS)


def block_bytes(found: DataFrame) -> DataFrame:
    """found (rows of ``blocks``) with the bytes of each block; for records of megabytes, not for whole lines."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k in range(len(part)):
                row = part.iloc[k : k + 1].copy()
                with opened(row["path"].iloc[0]) as f:
                    f.seek(int(row["begin"].iloc[0]))
                    row["content"] = [f.read(int(row["length"].iloc[0]))]
                yield row

    return found.mapInPandas(run, BLOCKS + ", content binary")


def encode(files: list[tuple[str, bytes]], labels: bool = True, ebcdic: bool = False) -> bytes:
    """A tape image of files: volume, header and end labels around each, or blocks and marks alone."""

    def written(text: str) -> bytes:
        return LABEL.to_bytes(4, "big") + text.ljust(LABEL)[:LABEL].encode("cp037" if ebcdic else "latin-1", "replace")

    out = [written("VOL1SHOT01")] if labels else []
    for k, (name, content) in enumerate(files, 1):
        if labels:
            out += [written(f"HDR1{name:<17.17}SHOT01{k:04d}"), bytes(4)]
        out += [len(content).to_bytes(4, "big"), content, bytes(4)]
        if labels:
            out += [written(f"EOF1{name:<17.17}SHOT01{k:04d}"), bytes(4)]
    return b"".join(out) + bytes(4)
