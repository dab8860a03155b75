"""Sharding by extendible hashing; DataFrame functions only.

Rows have a 60-bit hash of their key (id and text). A directory starts with as many hash-prefix bits as the total size
asks for; only buckets over the byte limit split on another bit, until each fits. Sizes are first summed by cells of a
fixed number of further bits, so that splitting reads a small table; cells that are still too large are summed again
with more bits, from their own rows only. Rows whose whole hash is equal (repeated rows) can't be told apart by bits:
such a bucket is paged by counts.

Defined results: a null text has no bytes (a row counts ROW_BYTES besides its text); null ids hash as empty; a single row
over the limit is a shard of its own; repeated rows are placed one by one; an empty table gives no rows; other columns
are kept, and the added ones are named by parameter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, written

SHARD_BYTES, ROW_BYTES, BITS = 64 << 20, 16, 60
#: Bits by which cells are finer than the directory's first buckets, and by which each next summing is finer.
FINER = 8


def key_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of id, newline and text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, BITS - bits)


def first_bits(total: int, limit: int) -> int:
    """Bits of the first directory: the fewest whose buckets would fit if all were even."""
    return max(0, math.ceil(math.log2(max(1, total) / limit)))


def split(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cells (cell: a prefix of ``high`` bits, bytes, n) with the least depth from ``low`` at which their bucket fits (null: none up to high)."""
    depth = None
    out = cells.withColumn("p0", F.shiftright("cell", high - low))
    for d in range(low, high + 1):
        whole = Window.partitionBy("p0", F.shiftright("cell", high - d))
        fits = (F.sum("bytes").over(whole) <= limit) | (F.sum("n").over(whole) == 1)
        depth = F.when(fits, F.lit(d)) if depth is None else depth.when(fits, F.lit(d))
    return out.withColumn("depth", depth).drop("p0")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES, shard_col: str = "shard", bytes_col: str = "row_bytes", depth_col: str = "depth") -> DataFrame:
    """docs with row_bytes, depth (bits used) and shard (the bits as text; paged buckets have -page appended)."""
    text = F.col(f"`{text_col}`").cast("string")
    # The row is kept apart, so that its columns can't clash with ours.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key_hash(F.col(f"`{id_col}`"), text).alias("h"),
                         (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("bytes"))
    total = marked.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    low = min(first_bits(total, limit), BITS)
    rows, levels = marked.select("h", "bytes"), []
    while True:
        high = min(BITS, low + FINER)
        cells = rows.groupBy(prefix(F.col("h"), high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        cells = written(split(cells, low, high, limit), "shard-cells")
        levels.append((high, cells))
        over = cells.where("depth IS NULL")
        if high == BITS or over.isEmpty():
            break
        side = small_side(over.select("cell"))
        rows = rows.join(side, prefix(F.col("h"), high) == side["cell"], "left_semi")
        low = high + 1
    depth = None
    for i, (high, cells) in enumerate(levels):
        side = small_side(cells.where("depth IS NOT NULL").select(F.col("cell").alias(f"cell_{i}"), F.col("depth").alias(f"depth_{i}")))
        marked = marked.join(side, prefix(F.col("h"), high) == F.col(f"cell_{i}"), "left")
        depth = F.col(f"depth_{i}") if depth is None else F.coalesce(depth, F.col(f"depth_{i}"))
    placed = marked.withColumn("depth", F.coalesce(depth, F.lit(BITS)).cast("int"))
    name = F.expr(f"substring(lpad(conv(cast(h AS string), 10, 2), {BITS}, '0'), 1, depth)")
    placed = placed.withColumn("shard", name)
    if not levels[-1][1].where("depth IS NULL").isEmpty():  # equal hashes beyond the limit
        stuck = depth.isNull()
        # Equal rows, so of equal sizes: as many as fit make a page, and any numbering will do. They are numbered within their input
        # partition and each partition after those before it, so that no task takes all rows of a hash.
        equal = written(placed.where(stuck).withColumn("part", F.spark_partition_id()), "equal-rows")
        counts = equal.groupBy("h", "part").agg(F.count(F.lit(1)).alias("n"))
        before = counts.select("h", "part", (F.sum("n").over(Window.partitionBy("h").orderBy("part")) - F.col("n")).alias("before"))
        nth = F.row_number().over(Window.partitionBy("h", "part").orderBy("bytes")) - 1
        per_page = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.col("bytes")))
        numbered = equal.withColumn("nth", nth).join(small_side(written(before, "equal-counts")), ["h", "part"])
        paged = numbered.withColumn("shard", F.concat("shard", F.lit("-"), F.floor((F.col("before") + F.col("nth")) / per_page).cast("string")))
        placed = placed.where(~stuck).unionByName(paged.select(*placed.columns))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], F.col("bytes").alias(bytes_col), F.col("depth").alias(depth_col), F.col("shard").alias(shard_col))


def directory(placed: DataFrame, bytes_col: str = "row_bytes", depth_col: str = "depth", shard_col: str = "shard") -> DataFrame:
    """(shard, depth, n_rows, n_bytes)"""
    return placed.groupBy(shard_col, depth_col).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(bytes_col).alias("n_bytes"))
