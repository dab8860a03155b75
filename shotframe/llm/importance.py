"""Target-distribution importance resampling over a position table of words.

Every text is exploded into (row, position, word); for orders above one a window over a row's positions fetches the following
words with lead() and joins them by one space. A feature's bucket is the crc32 of its bytes modulo the number of buckets.
Counts by bucket of the documents and of the target give each bucket a gain, the floored thousandfold log-ratio of smoothed
shares; a document's weight is the floored mean of its features' gains, to which Gumbel noise seeded by its id is added, so
that the highest scores are a draw without replacement. Ranks are exact and need no task with all rows: scores are whole
numbers within bounds that the noise and the gains set, so counts by score give every score its first rank, and rows are
numbered within one score only.

The number of the row stands for the document while features are summed, so docs must be read from files (or any plan that
gives the same partitions when a task is run again); only counts by bucket (at most ``buckets`` rows) are broadcast.

Defined results: a null or empty text has no features and weight 0; a null id is noise of the empty id and the last of a tie;
repeated rows are documents of their own with the same score and following ranks; fewer than MIN_WORDS words are scored but
neither counted for nor in the draw; an empty table of documents gives no rows, an empty target the gains of its smoothing;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_side, written

BUCKETS, ORDERS, SEED, PERCENT, MIN_WORDS = 10_000, (1,), 2024, 10, 20
#: What is not a word: ASCII but letters and digits.
NO_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copies of one row that are numbered at a time.
COPIES = 100_000


def words(text: Column) -> Column:
    """The words of a text in order; A-Z stay as they are here and are lowered word by word."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), NO_WORD), lambda w: w != "")


def position_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, pos, word): a row for each word, and one with null pos and word for a text without any."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), words(F.col(f"`{text_col}`")).alias("words"))
    out = rows.select("row", "doc_id", F.posexplode_outer("words").alias("pos", "said"))
    return out.select("row", "doc_id", "pos", F.when(F.col("said") == F.lower("said"), F.col("said")).otherwise(F.translate("said", _UPPER, _LOWER)).alias("word"))


def features(docs: DataFrame, orders: Sequence[int] = ORDERS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, word, bucket): a row for each n-gram of each order; word is true on one row of each word, so that words can be counted."""
    table = position_table(docs, id_col, text_col)
    said, gram = F.col("pos").isNotNull().alias("word"), F.col("word")
    if tuple(orders) == (1,):
        out = table.select("row", "doc_id", said, gram.alias("gram"))
    else:
        following = W.partitionBy("row").orderBy("pos")
        grams = [F.struct(said, (gram if 1 in orders else F.lit(None).cast("string")).alias("gram"))]
        for n in sorted(set(orders) - {1}):  # null, and so no feature, where the text ends before the n-th word
            joined = gram
            for k in range(1, n):
                joined = F.concat(joined, F.lit(" "), F.lead("word", k).over(following))
            grams.append(F.struct(F.lit(False).alias("word"), joined.alias("gram")))
        out = table.select("row", "doc_id", F.array(*grams).alias("grams")).select("row", "doc_id", F.explode("grams").alias("g")).select("row", "doc_id", "g.word", "g.gram")
    return out.select("row", "doc_id", "word", (F.crc32(F.col("gram").cast("binary")) % buckets).alias("bucket"))


def bucket_gains(docs: DataFrame, target: DataFrame, orders: Sequence[int] = ORDERS, buckets: int = BUCKETS, text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(bucket, gain) of the buckets that any document or target text has; at most ``buckets`` rows."""
    empty = F.lit(0).alias("doc_id")
    sides = [features(x.select(empty, F.col(f"`{c}`").alias("text")), orders, buckets).where("bucket IS NOT NULL").select("bucket", F.lit(k).alias("side")) for k, x, c in ((0, docs, text_col), (1, target, target_text))]
    counts = written(sides[0].unionByName(sides[1]).groupBy("bucket").agg(F.count_if(F.col("side") == 0).alias("s"), F.count_if(F.col("side") == 1).alias("t")), "importance-counts")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(total["s"] + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total["t"] + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain"))


def _floored_mean(total: Column, n: Column) -> Column:
    """floor(total / n) in whole numbers; 0 of none."""
    return F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the id's hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, gains: DataFrame, orders: Sequence[int] = ORDERS, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of docs."""
    found = features(docs, orders, buckets, id_col, text_col).join(small_side(gains), "bucket", "left")
    by_row = found.groupBy("row", "doc_id").agg(F.count_if("word").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    weight = _floored_mean(F.col("gain"), F.col("n_features"))
    return by_row.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"), seed)).alias("score"))


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """scored (a written table) with rank: 1 for the highest score of those with min_words words, to floor(percent * N / 100); ties to the smaller id."""
    able = F.col("n_words") >= min_words
    n = scored.where(able).count() * percent // 100
    # Scores are whole thousandths of logarithms of doubles: some 10^5 values at most, whatever the number of rows.
    by_score = scored.where(able).groupBy("score").agg(F.count("*").alias("rows"))
    before = by_score.select("score", (F.sum("rows").over(W.orderBy(F.desc("score"))) - F.col("rows")).alias("before")).where(F.col("before") < n)
    before = written(before, "importance-ranks")
    alike = ["doc_id", "n_words", "n_features", "weight", "score"]
    inside = W.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "n_words", "weight")
    grouped = scored.where(able).groupBy(*alike).agg(F.count("*").alias("copies")).join(small_side(before), "score", "left")
    # Scores wholly below the draw need no numbers.
    high, low = grouped.where("before IS NOT NULL"), grouped.where("before IS NULL")
    high = high.withColumn("at", F.col("before") + F.sum("copies").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("copies"))
    single = high.unionByName(low.withColumn("at", F.lit(None).cast("long")))
    blocks = single.select(*alike, "at", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).alias("block"))
    last = F.least(F.col("copies"), (F.col("block") + 1) * COPIES) - 1
    each = blocks.select(*alike, "at", F.explode(F.sequence(F.col("block") * COPIES, last)).alias("nth"))
    rank = F.col("at") + F.col("nth") + 1
    drawn = each.select(*alike, F.when(rank <= n, rank).alias("rank"))
    return drawn.unionByName(scored.where(~F.coalesce(able, F.lit(False))).select(*alike, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, orders: Sequence[int] = ORDERS, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS,
    id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs; rank is null for what isn't drawn."""
    gains = written(bucket_gains(docs, target, orders, buckets, text_col, target_text), "importance-gains")
    return draw(written(weights(docs, gains, orders, buckets, seed, id_col, text_col), "importance-scores"), percent, min_words)
