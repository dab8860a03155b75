"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotframe.shared import shared_dir, written  # noqa: F401  (the operators take them from here)

#: Bytes up to which a side may be broadcast; larger sides take a shuffled join.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at once, so that its memory doesn't follow the length of texts.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession | None = None) -> None:
    """Bound the session's Arrow batches by bytes (they are bounded by rows only by default); a smaller bound stays."""
    spark, name = spark or SparkSession.active(), "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if now.isdigit() and int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system: a worker that waits for its next task would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """task, a generator over a partition's batches, with its memory given back at the end."""

    @functools.wraps(task)
    def run(parts):
        try:
            yield from task(parts)
        finally:
            release()

    return run


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its measured size is below max_bytes, else as it is (a shuffled join then)."""
    width = sum((F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    size = df.agg(F.sum(width).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= max_bytes else df


def sha(col: Column) -> Column:
    return F.sha2(col, 256)


def doc_fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k (null id: the crc of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k
