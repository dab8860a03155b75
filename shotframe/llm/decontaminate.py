"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed pattern of word positions; the words at its ones are hashed and those at its zeros ignored, so a hit
survives substitutions. The four masks were chosen by enumeration so that every overlap of 11 words or more with 20 %
substitutions has a hit: 11 and 12 words (whole items, both ends of which agree) with 2, and at any places 13 with 2, 15
with 3, 20 with 4 and 25 with 5, thus all lengths from 13 to 25; a longer overlap parts into such lengths, of which one has
at most 20 %. Items shorter than the longest mask have masks of their own length, which leave out every place (of 10
words: every two places) between the ends. Seeds of documents meet those of items by an equi-join; each hit's
diagonal is then verified on a window of words that reaches as far as the longest item with that seed, so that the window holds
all of the diagonal: an overlap counts if it has MIN_OVERLAP words (or the whole of a shorter item) and at least IDENTITY of
them agree, whatever the length of the stretches that don't.

Items are a query set: they are taken in blocks of at most MAX_SEEDS seeds, whose hashes go to every task as a filter;
segments of documents without any hit never leave their task. Segments of equal texts are verified once.

Defined results: a null text has no words; items under MIN_ITEM words match nothing; a null doc_id or item_id is carried
through; repeated rows (and repeated items) each give their pairs; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches, small_side, written
from .words import WordHashes, mix

# The masks.
MASKS = ("1111011", "110010111", "1101100101", "11010001101")
SHORT_MASKS = {
    5: ("10111", "11011", "11101"),
    6: ("101111", "110111", "111011", "111101"),
    7: ("1001111", "1110011", "1111101"),
    8: ("10001111", "11110001"),
    9: ("100001111", "111110001"),
    10: ("1000001111", "1000010111", "1000111001", "1111000001"),
}
MIN_OVERLAP, IDENTITY, MIN_ITEM = 13, 0.8, 5
MAX_SEEDS = 1 << 20
_SPAN = max(map(len, MASKS))


def _seeds(h: np.ndarray, shape: tuple[int, ...], salt: int) -> np.ndarray:
    n = len(h) - shape[-1]
    if n <= 0:
        return h[:0]
    out = np.full(n, np.uint64(salt), np.uint64)
    for p in shape:
        out = mix(out ^ h[p : p + n]) + np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def shapes(short: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(salt, positions) of the masks and of those of the short lengths."""
    masks = [*enumerate(MASKS, 1), *((8 * n + i, m) for n in short for i, m in enumerate(SHORT_MASKS[n]))]
    return [(salt, tuple(j for j, c in enumerate(m) if c == "1")) for salt, m in masks]


def item_seeds(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words, seeds (h, q)) of items that can match."""

    def seeded(texts: pd.Series) -> pd.DataFrame:
        hashes, out = WordHashes(), []
        for text in texts:
            h = hashes([text])[0]
            found = []
            for salt, shape in shapes([len(h)] if MIN_ITEM <= len(h) < _SPAN else []) if len(h) >= MIN_ITEM else []:
                if len(h) < _SPAN and salt <= len(MASKS):
                    continue
                found += [{"h": int(x), "q": q} for q, x in enumerate(_seeds(h, shape, salt).view(np.int64))]
            out.append((h.view(np.int64), found))
        return pd.DataFrame(out, columns=["words", "seeds"])

    made = F.pandas_udf(seeded, "words array<long>, seeds array<struct<h: long, q: int>>")
    return items.select(F.col(f"`{id_col}`").alias("item_id"), made(F.col(f"`{text_col}`").cast("string")).alias("z")).select("item_id", "z.words", "z.seeds").where(F.size("seeds") > 0)


def _word_hashes(texts: pd.Series, hashes: WordHashes) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), 128):
        h, size = hashes(list(texts.iloc[at : at + 128]))
        yield from np.split(h, np.cumsum(size)[:-1])


def _scanner(known: np.ndarray, reach: np.ndarray, short: list[int]):
    """Segments of words around the hits of the sorted seed hashes ``known``, each as wide as its longest item (``reach``)."""
    bits = np.zeros(1 << 23, bool)
    bits[(known & np.uint64((1 << 23) - 1)).astype(np.int64)] = True

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for part in parts:
            out = []
            for doc_id, digest, h in zip(part["doc_id"], part["digest"], _word_hashes(part["text"], hashes), strict=True):
                at, which, wide = [], [], []
                for salt, shape in shapes(short):
                    s = _seeds(h, shape, salt)
                    maybe = np.flatnonzero(bits[(s & np.uint64((1 << 23) - 1)).astype(np.int64)])
                    nth = np.minimum(np.searchsorted(known, s[maybe]), len(known) - 1)
                    true = known[nth] == s[maybe]
                    at.append(maybe[true])
                    which.append(s[maybe[true]])
                    wide.append(reach[nth[true]])
                at, which, wide = np.concatenate(at), np.concatenate(which), np.concatenate(wide)
                if not len(at):
                    continue
                begins = np.maximum(0, at - wide)
                by = np.argsort(begins, kind="stable")
                at, which, begins, ends = at[by], which[by], begins[by], np.maximum.accumulate((at + wide)[by])
                for hits in np.split(np.arange(len(at)), np.flatnonzero(begins[1:] >= ends[:-1]) + 1):
                    begin = int(begins[hits[0]])
                    words = h[begin : ends[hits[-1]]].view(np.int64)
                    out.append((doc_id, digest, begin, words, [{"h": int(x), "p": int(p - begin)} for x, p in zip(which[hits].view(np.int64), at[hits], strict=True)]))
            yield pd.DataFrame(out, columns=["doc_id", "digest", "start", "words", "hits"])

    return scan


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(start in doc, words, agreeing words) of the longest verified overlap on a diagonal (place in doc less place in item).

    It begins and ends with agreeing words."""
    first, last = max(0, diagonal), min(len(doc), len(item) + diagonal)
    agree = doc[first:last] == item[first - diagonal : last - diagonal]
    # Scaled so that a stretch with IDENTITY or more agreeing words sums to 0 or more.
    score = np.concatenate([[0.0], np.cumsum(np.where(agree, 1 - IDENTITY, -IDENTITY))]) + 1e-9 * np.arange(len(agree) + 1)
    if not agree.any():
        return None
    lowest = np.minimum.accumulate(np.where(np.append(agree, False), score, np.inf))
    # The earliest start whose prefix sum is not above that of the end.
    starts = np.searchsorted(-lowest, -score, side="left")
    length = np.where(np.append(False, agree), np.arange(len(score)) - starts, 0)
    i = int(np.argmax(length))
    if length[i] < min(MIN_OVERLAP, len(item)):
        return None
    return first + int(starts[i]), int(length[i]), int(agree[starts[i] : i].sum())


def _verify(docs: pd.Series, items: pd.Series, diagonals: pd.Series) -> pd.DataFrame:
    found = [best_overlap(np.asarray(d), np.asarray(i), g) or (-1, 0, 0) for d, i, g in zip(docs, items, diagonals, strict=True)]
    return pd.DataFrame(found, columns=["at", "n", "agree"])


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, digest, item_id, start, n_words, n_agree, n_item): the longest verified overlap of each pair that has one."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    known = written(item_seeds(items, item_id, item_text), "item-seeds")
    total = known.agg(F.sum(F.size("seeds")).alias("n")).first()["n"] or 0
    blocks = int(total // MAX_SEEDS) + 1
    out = None
    kind = dict(base.dtypes)["doc_id"]
    for b in range(blocks):
        block = known.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b) if blocks > 1 else known
        # Of a block of the query set only: its seed hashes and the few lengths of short items.
        hashes = block.select(F.explode("seeds.h").alias("h"), F.size("words").alias("n")).groupBy("h").agg(F.max("n").alias("reach")).toPandas()
        short = sorted(r["n"] for r in block.where(F.size("words") < _SPAN).select(F.size("words").alias("n")).distinct().collect())
        if not len(hashes):
            continue
        h, reach = hashes["h"].to_numpy(np.int64).view(np.uint64), hashes["reach"].to_numpy(np.int64)
        by = np.argsort(h)
        scan = _scanner(h[by], reach[by], short)
        segments = written(base.mapInPandas(releasing(scan), f"doc_id {kind}, digest binary, start long, words array<long>, hits array<struct<h: long, p: int>>"), "segments")
        once = segments.select("digest", "start", "words", "hits").dropDuplicates(["digest", "start"])
        seeds = block.select("item_id", F.explode("seeds").alias("s")).select("item_id", F.col("s.h").alias("h"), F.col("s.q").alias("q"))
        hits = once.select("digest", "start", F.explode("hits").alias("x")).select("digest", "start", F.col("x.h").alias("h"), F.col("x.p").alias("p"))
        diagonals = hits.join(small_side(seeds), "h").select("digest", "start", "item_id", (F.col("p") - F.col("q")).alias("diagonal")).distinct()
        words = small_side(block.select("item_id", F.col("words").alias("item")))
        checked = diagonals.join(once.select("digest", "start", "words"), ["digest", "start"]).join(words, diagonals["item_id"].eqNullSafe(words["item_id"])).drop(words["item_id"])
        checked = checked.withColumn("v", F.pandas_udf(_verify, "at int, n int, agree int")("words", "item", "diagonal")).where("v.n > 0")
        best = checked.groupBy("digest", "item_id").agg(F.max(F.struct(F.col("v.n").alias("n"), F.col("v.agree").alias("agree"), (-(F.col("start") + F.col("v.at"))).alias("at"), F.size("item").alias("n_item"))).alias("b"))
        owners = segments.select("doc_id", "digest").distinct()
        found = owners.join(best, "digest").select("doc_id", "digest", "item_id", (-F.col("b.at")).alias("start"), F.col("b.n").cast("long").alias("n_words"), F.col("b.agree").cast("long").alias("n_agree"), F.col("b.n_item").cast("long").alias("n_item"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        ids = dict(items.dtypes)[item_id]
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, digest binary, item_id {ids}, start long, n_words long, n_agree long, n_item long")
    return out


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose text overlaps no item, with the columns of docs."""
    name = "__digest"
    while name in docs.columns:
        name += "_"
    dirty = small_side(written(overlaps(docs, items, id_col, text_col, **options).select(F.col("digest").alias(name)).distinct(), "overlapping"))
    marked = docs.withColumn(name, F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))))
    return marked.join(dirty, name, "left_anti").select(*docs.columns)
