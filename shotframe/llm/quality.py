"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

A document is rejected as repetitive or incompressible if its ratio (compressed / raw bytes) leaves the band of its
length, or if more than CHUNK_SHARE of its chunks of CHUNK bytes leave the band of a chunk (the last one ends with the text). The base rules come first (too few
words, or too many words inside repeated 8-word windows).

Defined results: a null text has no words and fails the base rules, as does an empty one; texts below the shortest band
are judged by the base rules alone; a very long text is compressed as a stream of its chunks as well as whole;
repeated rows are judged one by one; an empty table gives no rows. The verdict is added as one struct column, whose name
is free of clashes with other columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches

MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
LEVEL, CHUNK, CHUNK_SHARE = 3, 4096, 0.34
# Fixed values: (from bytes, lowest ratio, highest ratio); a document takes the last line that it reaches.
BANDS = ((128, 0.45, 1.00), (256, 0.42, 0.95), (512, 0.40, 0.90), (1024, 0.36, 0.85), (2048, 0.33, 0.80), (4096, 0.30, 0.78), (16384, 0.26, 0.76))
#: The band of one full chunk.
CHUNK_BAND = (0.33, 0.80)
SYMBOLS = tuple("#*$%&|<>")

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, bad_chunks long, base_failed boolean, kept boolean, reason string"


def repeat_words(ids: np.ndarray, k: int = WINDOW) -> int:
    """Positions covered by k-windows (k a power of two) that occur twice or more; exact, by ranking doubled windows."""
    if len(ids) < k + 1:
        return 0
    rank, span = ids.astype(np.int64), 1
    while span < k:
        pair = rank[:-span] * np.int64(len(ids) + 1) + rank[span:]
        rank = np.unique(pair, return_inverse=True)[1]
        span *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def band_of(n: int, bands=BANDS) -> tuple[float, float] | None:
    found = None
    for least, low, high in bands:
        if n >= least:
            found = (low, high)
    return found


def judge(text: str | None, compressor: zstandard.ZstdCompressor, bands=BANDS, chunk_band=CHUNK_BAND) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    ids: dict[bytes, int] = {}
    repeated = repeat_words(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)) if n > WINDOW else 0
    # Code points in words: all bytes but white space and UTF-8 continuation bytes.
    chars = len(text) - (len(raw) - sum(map(len, words)))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
    ratio = len(compressor.compress(raw)) / len(raw) if raw else 0.0
    band = band_of(len(raw), bands)
    # The chunks begin at multiples of CHUNK; the last one ends with the text, so that no byte is left out.
    full = -(-len(raw) // CHUNK) if len(raw) >= CHUNK else 0
    bad = 0
    for i in range(full):
        at = min(i * CHUNK, len(raw) - CHUNK)
        bad += not chunk_band[0] <= len(compressor.compress(raw[at : at + CHUNK])) / CHUNK <= chunk_band[1]
    reason = "base" if failed else None
    if not failed and band and ratio < band[0]:
        reason = "repetitive"
    elif not failed and band and ratio > band[1]:
        reason = "incompressible"
    elif not failed and bad > CHUNK_SHARE * max(full, 1):
        reason = "chunks"
    return n, chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated, ratio, full, bad, failed, reason is None, reason


def _judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for texts in parts:
        yield pd.DataFrame([judge(x, compressor) for x in texts], columns=names)


def compression_bands(text: Column) -> Column:
    """The verdict on a text as a struct of SCHEMA."""
    small_batches()
    return F.pandas_udf(releasing(_judged), SCHEMA)(text.cast("string"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    name = "__verdict"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, compression_bands(F.col(f"`{text_col}`"))).where(F.col(name)["kept"]).drop(name)
