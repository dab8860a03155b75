"""MinHash near-dedup with DartMinHash signatures and banded joins.

Darts are thrown into the (weight, rank) plane of every element: the plane is cut into fixed cells, a hash of (element,
cell) gives the cell's Poisson number of darts, and a hash of each dart its weight, rank and coordinate. Of the darts
under the element's weight, each coordinate keeps the earliest by rank. Two weighted sets agree in a coordinate with the
probability of their weighted Jaccard similarity, at a cost of about n + k log k for n elements and k coordinates.

Plan: texts that are equal become one node (grouped by digest). Nodes meet in buckets, one for each band of the
signature. In each bucket the most central member (that with the most bucket mates, summed over its buckets) is linked
with each of the others, exactly verified on the shingle sets, and the links' components are found. Buckets that then
still hold several components are compared in blocks: of the pairs across components that the signatures estimate high enough, a task
verifies each on the shingle sets, unless links that it has found join the two already, and only such links leave it. A bucket of over BLOCK members is cut into blocks of about half as many, and
every two blocks (and each by itself) are compared in one task, so that all its members meet; only the members of its
largest component need not meet one another. Nothing but counts reaches the driver.

Defined results: a null text equals an empty one; equal texts (also without any word) are one class; a text of under
five words has one shingle of all its words; a null doc_id is answered with its text's class, and a class of only null
ids has a null class_id; repeated rows are answered one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches, small_side, written
from .words import SHINGLE, WordHashes, batch_shingles, mix, shingle_hashes

COORDINATES, BAND_ROWS, SIMILARITY = 128, 4, 0.8
BLOCK = 1024
#: Signatures of 128 coordinates estimate 0.8 with a standard deviation of 0.035; four of them are allowed for.
ESTIMATE_SLACK = 0.15
#: Shingles that are compared with one set at once.
COMPARED = 1 << 18
GROUP = ["key", "x", "y"]
_BASE = 1 / 1  # height of the lowest rank stratum; each next one doubles the height reached


def _poisson_cdf(mean: float) -> np.ndarray:
    most = int(mean + 12 * math.sqrt(mean) + 20)
    n = np.arange(most + 1)
    logs = n * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in n])
    return np.cumsum(np.exp(logs))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, k: int = COORDINATES) -> np.ndarray:
    """(n_docs, k) uint32 of dart ids; zero rows for documents without elements. doc: the document of each element."""
    out = np.full(n_docs * k, np.uint64(0xFFFFFFFFFFFFFFFF))
    total = np.bincount(doc, weights, n_docs)
    theta = np.where(total > 0, k * (math.log(k) + 2) / np.maximum(total, 1e-300), 0)
    done = np.zeros(n_docs)  # ranks below this are thrown already
    open_ = total > 0
    while open_.any():
        low, high = 0.0, _BASE
        top = theta[open_].max()
        while low < top:
            use = open_[doc] & (theta[doc] > low) & (done[doc] < high)
            if use.any():
                _throw(elements[use], weights[use], doc[use], low, high, theta, done, k, out)
            low, high = high, high * 2
        filled = (out.reshape(n_docs, k) != np.uint64(0xFFFFFFFFFFFFFFFF)).all(axis=1)
        done = np.where(open_, theta, done)
        open_ &= ~filled
        theta = np.where(open_, theta * 2, theta)
    ids = (out & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n_docs, k)
    ids[total <= 0] = 0
    return ids


def _throw(e: np.ndarray, w: np.ndarray, doc: np.ndarray, low: float, high: float, theta: np.ndarray, done: np.ndarray, k: int, out: np.ndarray) -> None:
    cell_low, cell_high, cell = 0.0, 1.0, 0
    stratum = np.uint64(int(round(math.log2(high / _BASE))) * 64)
    while len(e):
        seed = mix(e ^ mix(np.full(1, stratum + np.uint64(cell), np.uint64) + np.uint64(0x632BE59BD9B4E019)))
        counts = np.searchsorted(_poisson_cdf((high - low) * (cell_high - cell_low)), _uniform(seed), side="right")
        at = np.repeat(np.arange(len(e)), counts)
        if len(at):
            nth = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            h = mix(seed[at] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            rank = low + (high - low) * _uniform(mix(h ^ np.uint64(1)))
            where = doc[at]
            keep = (rank < theta[where]) & (rank >= done[where])
            if cell_low or (w < cell_high).any():
                keep &= cell_low + (cell_high - cell_low) * _uniform(mix(h ^ np.uint64(2))) < w[at]
            h, rank, where = h[keep], rank[keep], where[keep]
            # The rank as 32 bits of a float keeps its order; below it the dart's id.
            key = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
            np.minimum.at(out, where * k + (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % k, key)
        more = w > cell_high
        e, w, doc = e[more], w[more], doc[more]
        cell_low, cell_high, cell = cell_high, cell_high * 2, cell + 1


def weighted_shingles(text: str | None, hashes: WordHashes, weight: str = "set") -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights: 1 (set), the count, or 1 + log of the count."""
    found, n = np.unique(shingle_hashes(hashes([text])[0], SHINGLE), return_counts=True)
    return found, weights_of(n, weight)


def weights_of(count: np.ndarray, weight: str) -> np.ndarray:
    return np.ones(len(count)) if weight == "set" else count.astype(float) if weight == "count" else 1 + np.log(count)


def _sketcher(weight: str, k: int, rows: int):
    def sketches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for texts in parts:
            bands, sigs = [], []
            for at in range(0, len(texts), 256):
                some = list(texts.iloc[at : at + 256])
                doc, found, count = batch_shingles(some, hashes)
                n = len(some)
                sig = dart_signatures(found, weights_of(count, weight), doc, n, k)
                # One 64-bit key for each band, which holds the band's number.
                keys = np.tile(np.arange(k // rows, dtype=np.uint64) + np.uint64(1), (n, 1))
                for i in range(rows):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, i::rows].astype(np.uint64))
                low = sig.astype(np.uint16)
                for i, m in enumerate(np.bincount(doc, minlength=n)):
                    bands.append(keys[i].view(np.int64) if m else None)
                    sigs.append(low[i].tobytes() if m else None)
            yield pd.DataFrame({"bands": bands, "sig": sigs})

    return F.pandas_udf(releasing(sketches), "bands array<long>, sig binary")


def _shingle_set(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    hashes = WordHashes()
    for texts in parts:
        yield pd.Series([weighted_shingles(t, hashes)[0].view(np.int64) for t in texts])


def text_node(text) -> object:
    """The 128-bit digest that stands for a text."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose shingle sets (node, s) have that similarity."""
    left, right = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return edges.select("a", "b").join(left, "a").join(right, "b").where(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, by rounds of neighbours' minimum and a pointer jump."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("jumped"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "m").alias("m"))
        step = step.join(jump, F.col("m") == F.col("j"), "left").select("node", F.col("label").alias("was"), F.least("m", "jumped").alias("label"))
        step = written(step, "labels")
        labels = step.select("node", "label")
        if step.where("label != was").isEmpty():
            return labels


def _cross_pairs(part: np.ndarray, side: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (left, right) of rows of one group, different parts and different sides (or none: -1), some 2**16 at a time.
    end: where each row's group ends."""
    later = end - np.arange(len(end)) - 1
    for rows in np.split(np.arange(len(end)), np.flatnonzero(np.diff(np.cumsum(later) >> 16)) + 1):
        left = np.repeat(rows, later[rows])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later[rows]) - later[rows], later[rows])
        use = (part[left] != part[right]) & ((side[left] < 0) | (side[left] != side[right]))
        yield left[use], right[use]


def bit_planes(sig: np.ndarray) -> np.ndarray:
    """(n, 16, words) of signatures (n, k) uint16: for each of the 16 bits, that bit of all coordinates as 64-bit words."""
    n, k = sig.shape
    wide = np.zeros((n, 16, -(-k // 64) * 64), np.uint8)
    for b in range(16):
        wide[:, b, :k] = (sig >> np.uint16(b)) & np.uint16(1)
    return np.ascontiguousarray(np.packbits(wide, axis=2)).view(np.uint64)


def agreeing(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Coordinates in which planes agree; of some of the 16 planes, an upper bound."""
    return k - np.bitwise_count(np.bitwise_or.reduce(a ^ b, axis=1)).sum(axis=1, dtype=np.int64)


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = parent[up]


def similar(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of the sorted set s with each of the others; sets aren't empty."""
    size = np.array([len(x) for x in others])
    joined = np.concatenate(others)
    hit = s[np.minimum(np.searchsorted(s, joined), len(s) - 1)] == joined
    both = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
    return both / (len(s) + size - both)


def _linker(similarity: float):
    """Of the pairs of blocks of buckets, in order of GROUP: links across components that join them like all links of the blocks do.
    Pairs that the signatures estimate high enough are verified on the shingle sets, unless links found before join them."""

    def linked(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(len(rows), -1)
        sets, node = [x.view(np.uint64) for x in rows["s"]], rows["node"].to_numpy()  # as they were sorted
        sizes = np.diff(np.append(starts, len(rows)))
        group = np.repeat(np.arange(len(starts)), sizes)
        part = pd.factorize(rows["label"])[0]
        side = np.where(rows["x"] == rows["y"], -1, rows["mine"])
        n = np.array([len(x) for x in sets])
        k, planes = sig.shape[1], bit_planes(sig)
        head = np.ascontiguousarray(planes[:, :4])
        least = (similarity - ESTIMATE_SLACK) * k
        # The components of each group, joined as links are found.
        parent = np.arange(int(part.max()) + 1)
        at, up, a, b = -1, parent, [], []
        for i, j in _cross_pairs(part, side, np.repeat(starts + sizes, sizes)):
            near = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])  # no others can be similar
            i, j = i[near], j[near]
            near = agreeing(head[i], head[j], k) >= least  # a bound, so that most pairs need no more
            i, j = i[near], j[near]
            near = agreeing(planes[i], planes[j], k) >= least
            i, j = i[near], j[near]
            for some in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else ():
                left, right = i[some[0]], j[some]
                if group[left] != at:
                    at, up = group[left], parent.copy()
                while len(right):
                    right = right[_roots(up, part[right]) != _roots(up, part[[left]])[0]]
                    if not len(right):
                        break
                    now = right[: max(1, int(np.searchsorted(np.cumsum(n[right]), COMPARED, side="right")))]
                    for r in now[similar(sets[left], [sets[x] for x in now]) >= similarity]:
                        x, y = _roots(up, part[[left, r]])
                        if x != y:
                            up[y] = x
                            a.append(node[left])
                            b.append(node[r])
                    right = right[len(now) :]
        return pd.DataFrame({"a": a, "b": b})

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in parts:
            if not len(part):
                continue
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            starts = np.flatnonzero((held[GROUP] != held[GROUP].shift()).any(axis=1))
            # The last block may go on; the others are taken by some thousand rows.
            for some in np.split(starts[:-1], np.flatnonzero(np.diff(starts[:-1] // (2 * BLOCK))) + 1):
                if len(some):
                    yield linked(held.iloc[some[0] : starts[np.searchsorted(starts, some[-1]) + 1]], some - some[0])
            held = held.iloc[starts[-1] :].reset_index(drop=True)
        if held is not None:
            yield linked(held, np.zeros(1, np.int64))

    return blocks


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, weight: str = "set", k: int = COORDINATES, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, node, class_id) for every row of docs: its text's digest and the smallest doc_id of its class."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("node", text_node(F.col("text")))
    sketch = base.select("doc_id", "node", _sketcher(weight, k, rows)("text").alias("z"))
    nodes = sketch.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("z").alias("z")).select("node", "rep", "z.bands", "z.sig")
    nodes = written(nodes, "sketches")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    multi = written(entries.join(shared, "key"), "buckets")
    mass = multi.groupBy("node").agg(F.sum("n").alias("mass"))
    pivots = written(multi.join(mass, "node").groupBy("key").agg(F.max(F.struct("mass", "node"))["node"].alias("pivot")), "pivots")
    edges = multi.join(pivots, "key").where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    texts = base.join(small_side(nodes.join(multi.select("node").distinct(), "node", "left_semi").select("node", F.col("rep").alias("doc_id"))), ["node", "doc_id"], "left_semi").select("node", "text")
    sets = written(texts.select("node", F.pandas_udf(releasing(_shingle_set), "array<long>")("text").alias("s")).dropDuplicates(["node"]), "shingle-sets")
    links = written(verified(edges, sets, similarity), "verified")
    labels = components(links)
    placed = multi.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    parts = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    # A large bucket is dealt into blocks, those of its largest component last; every two blocks meet, but for two of that.
    dealt = lambda n: F.ceil(n / (BLOCK // 2)).cast("int")
    held = placed.join(mixed, "key").withColumn("rest", dealt(F.col("n") - F.col("most.n"))).withColumn("all", F.col("rest") + dealt(F.col("most.n")))
    inner = F.col("label") == F.col("most.label")
    mine = F.crc32("node") % F.when(inner, F.col("all") - F.col("rest")).otherwise(F.col("rest")) + F.when(inner, F.col("rest")).otherwise(0)
    whole = F.col("n") <= BLOCK
    held = held.withColumn("mine", F.when(whole, 0).otherwise(mine).cast("int"))
    met = F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.when(inner, F.col("rest")).otherwise(F.col("all")) - 1))
    rows_ = held.select("key", "node", "label", "mine", F.explode(met).alias("other")).withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")})
    rows_ = rows_.drop("other").join(nodes.select("node", "sig"), "node").join(sets, "node")
    rows_ = rows_.repartition(*GROUP).sortWithinPartitions(*GROUP)
    more = written(rows_.mapInPandas(releasing(_linker(similarity)), "a binary, b binary").distinct(), "verified")
    if not more.isEmpty():
        labels = components(links.union(more))
    ids = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    classes = ids.join(ids.groupBy("label").agg(F.min("rep").alias("class_id")), "label").select("node", "class_id")
    return base.select("doc_id", "node").join(classes, "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each class, that with the smallest id (of repeated rows one; without any id, the smallest text digest's)."""
    name = "__node"
    while name in docs.columns:
        name += "_"
    answer = written(near_classes(docs, id_col, text_col, **options), "near-classes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("node"))).alias("best")
    key = F.coalesce(F.col("class_id").cast("string"), F.hex("node"))
    winners = answer.groupBy(key.alias("class")).agg(best).select(F.col("best.doc_id").alias("doc_id"), F.col("best.node").alias("node"))
    count = answer.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
    flags = written(count.join(winners.withColumn("won", F.lit(True)), [count["doc_id"].eqNullSafe(winners["doc_id"]), count["node"] == winners["node"]], "left")
                    .select(count["doc_id"], count["node"], "n", "won"), "near-flags")
    marked = docs.withColumn(name, text_node(F.col(f"`{text_col}`")))
    same = lambda side: [marked[id_col].eqNullSafe(side["doc_id"]), marked[name] == side["node"]]
    odd = small_side(flags.where("won IS NULL OR n > 1").select("doc_id", "node"))
    single = marked.join(odd, same(odd), "left_anti").select(*docs.columns)
    twice = small_side(flags.where("won AND n > 1").select("doc_id", "node"))
    return single.unionByName(marked.join(twice, same(twice), "left_semi").dropDuplicates([id_col, name]).select(*docs.columns))
