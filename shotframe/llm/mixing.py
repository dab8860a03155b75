"""LM scoring by online logistic context mixing over bits.

A text's tokens (A-Z lower-cased words and one end mark) are coded by the training tokens' own counts: each distinct count
n takes a stretch of the line [0, N) as long as its tokens' occurrences, the most frequent first, and a token's hash places it
inside its stretch. The line is cut into 2**depth cells, some N**0.47. The cell is coded bit by bit from
the root of the binary tree over all cells, with a first bit for unknown words, which are spelled by the bits of their bytes; bits whose
other side holds no token are not coded. Three predictors give the log-odds of each bit: the exact occurrences of
all training tokens on either side, and counts under two hashed contexts (the word's cell before or the two before, or the last bytes
spelled; and the place in the tree). A gate (how well the contexts are known, and whether a byte is coded) selects a set of weights; the weighted sum is squashed,
and an adaptive table (by gate and squashed probability) refines it. While a text is scored, its copy of the weights goes
on learning after each SEGMENT symbols, and so does its belief in the mix of contexts against the exact counts alone: the
probability of a segment's words is the believed mean of both, so that contexts that don't help a text cost it next to nothing. What is left of a known token's bits, below its cell, has the exact counts as its only predictor; their
product is n / (occurrences in the cell). ``score`` is the text's log10 probability; ``bits_per_byte`` follows from it.

What is learned grows with the input: every token's count (no token is left out, and counts meet the texts by a join), the tree's depth
and the tables of contexts, up to a broadcast of 2**MOST_BITS slots of 2 bytes for each context.

Plan: (1) one scan sums token and byte counts of the training rows; (2) the rows are dealt by hash into chunks of bounded size,
each chunk's distinct tokens meet their counts and cells by a join, and each chunk is coded; its training rows, in the order of a hash of
their id and text, are learned online (a batch is predicted, corrects the weights and the refining table, and is then counted, tokens that occur
once as unknown ones, as they would be in a new text); (3) the chunks' tables are added up in rounds of FAN_IN, the weights averaged by
the bits they saw, and the coded rows are scored with the broadcast model. Chunks and orders follow from the rows alone, so scores don't
change with partitions, cluster or retries.

Defined results: a null text is empty and scores its end mark; without training rows every token is unknown and all bits are
even; repeated rows are scored one by one; a null id counts as the empty text for the fold; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, releasing, small_batches, small_side, written

PRIOR, RATE, DOC_RATE, SEGMENT, BUCKETS = 0.4, 0.5, 0.02, 512, 33
#: The most (as log-odds) that a text may believe in the mix or in the counts alone; segments begin even.
BELIEF = 5.0
#: Bytes of text in a chunk, of texts coded at once, symbols of one numpy batch, and tables that one task adds up.
CHUNK, CODED, BATCH, FAN_IN = 18 << 20, 1 << 20, 4096, 32
#: Bytes of text whose words are counted, or found among a chunk's tokens, at once.
SPLIT = 32 << 20
#: Rows of a chunk, for tables of very short texts.
CHUNK_ROWS = 1 << 18
#: Bits of a table of contexts beyond the tree's depth, and at most.
MORE_BITS, MOST_BITS = 9, 24
END_TOKEN = b""  # no word is empty
#: Bytes of a spelled word that its next byte's contexts take.
SPELT = (2, 3)
#: Levels of how often a context has been met: never, once or twice, up to 15 times, more often.
LEVELS = 4
CONTEXTS, INPUTS, GATES = 2, 3, 2 * LEVELS**2
_TOP = (1 << 16) - 1
_LOG = np.log(np.arange(_TOP + 1) + PRIOR).astype(np.float32)
#: The log-odds that a packed slot holds.
_ODDS = (np.arange(_TOP + 1, dtype=np.uint16) & np.uint16(0xFFFC)).view(np.float16).astype(np.float32)
_NODE = np.uint64(0x9E3779B1)
PIECES = 32


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the tokens of all texts in order, each text's end mark included; number of tokens of each text): A-Z lower-cased."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    # A blank behind the last word makes the empty string that ends a text; a text without words is that string already.
    lists = pc.ascii_split_whitespace(pc.binary_join_element_wise(bare, pc.if_else(pc.equal(bare, ""), "", " "), ""))
    return lists.flatten().cast(pa.binary()), np.diff(lists.offsets.to_numpy())


def depth_of(n_all: int) -> int:
    """Bits of a cell: 0.47 of those of the number of training tokens."""
    return max(1, int(math.log2(max(2, n_all)) * 0.47))


class Tree:
    """The symbols' bits: cells of known tokens, one symbol for unknown words, and the bytes (with a blank as their end) that spell those.

    Symbol numbers: cells, ``unknown``, ``byte`` + byte; ``start`` stands before a text."""

    def __init__(self, depth: int, cells: dict[int, int], singles: int, letters: dict[int, int]):
        self.depth, cell = depth, 1 << depth
        self.unknown, self.byte, self.start = cell, cell + 1, cell + 257
        mass = np.zeros(4 * cell)
        mass[2 * cell + np.array(list(cells), np.int64)] = list(cells.values())
        for level in range(depth, 0, -1):
            a = 1 << level
            mass[a : a + a // 2] = mass[2 * a : 3 * a].reshape(-1, 2).sum(axis=1)
        mass[3] = max(1, singles)
        leaves = np.zeros(512)
        leaves[256:] = [letters.get(b, 0) + 1 for b in range(256)]
        for a in (128, 64, 32, 16, 8, 4, 2, 1):
            leaves[a : 2 * a] = leaves[2 * a : 4 * a].reshape(-1, 2).sum(axis=1)
        halves = np.concatenate([mass.reshape(-1, 2), leaves.reshape(-1, 2)])  # (node, side): occurrences
        with np.errstate(divide="ignore", invalid="ignore"):
            self.odds = np.nan_to_num(np.clip(np.log(halves[:, 1] / halves[:, 0]), -12, 12)).astype(np.float32)
        known = (2 * cell + np.arange(cell))[:, None] >> np.arange(depth, -1, -1)
        paths = [(known >> 1, known & 1), (np.array([[1]]), np.array([[1]]))]
        spelt = (256 + np.arange(256))[:, None] >> np.arange(7, -1, -1)
        paths.append(((spelt >> 1) + 2 * cell, spelt & 1))
        open_ = [(halves[n] > 0).all(axis=2) for n, _ in paths]
        self.node = np.concatenate([n[o] for (n, _), o in zip(paths, open_, strict=True)]).astype(np.int32)
        # What the paths' bits need, in the paths' order.
        self.path_odds, self.path_hash = self.odds[self.node], (self.node.astype(np.uint64) * _NODE).astype(np.uint32)
        self.bit = np.concatenate([b[o] for (_, b), o in zip(paths, open_, strict=True)]).astype(np.int8)
        self.length = np.concatenate([o.sum(axis=1) for o in open_])
        self.first = np.cumsum(self.length) - self.length
        # log10 of each known symbol's (and the unknown mark's) bits by the exact counts alone.
        chance = np.where(self.bit == 1, 1, -1) * self.path_odds.astype(np.float64)
        by_bit = np.append(0, np.cumsum(-np.logaddexp(0, -chance) / math.log(10)))
        self.alone = (by_bit[self.first + self.length] - by_bit[self.first])[: self.byte]

    def bits_of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of bits of each symbol, place among all paths of each bit), in order."""
        count = self.length[symbols]
        at = np.repeat(self.first[symbols] - (np.cumsum(count) - count), count)
        at += np.arange(len(at))
        return count, at

    def contexts(self, symbols: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """A hash of each symbol's two contexts: of the word before and of the two before; of a byte, what was spelled of its
        word, the last SPELT bytes at most. starts: where texts begin (with a word)."""
        spelt = symbols >= self.byte
        words = np.flatnonzero(~spelt)
        begin = np.searchsorted(words, starts)
        before, second = np.empty(len(words), np.uint64), np.empty(len(words), np.uint64)
        before[1:] = symbols[words[:-1]]
        before[begin] = self.start
        second[1:] = before[:-1]
        second[begin] = self.start
        hashes = np.empty((CONTEXTS, len(symbols)), np.uint64)
        hashes[:, words] = before + np.uint64(1), before * np.uint64(0xD6E8FEB86659FD93) + second + np.uint64(1 << 40)
        at = np.flatnonzero(spelt)
        back = at - np.maximum.accumulate(np.where(spelt, 0, np.arange(len(symbols))))[at]
        for k, order in enumerate(SPELT):
            h = np.full(len(at), np.uint64(order) << np.uint64(50))
            for i in range(1, order + 1):
                h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(back >= i, symbols[at - i], 0).astype(np.uint64)
            hashes[k, at] = h
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return list(((hashes ^ (hashes >> np.uint64(29))) >> np.uint64(16)).astype(np.uint32))


def symbols_of(words: list[bytes] | pa.Array, cell: np.ndarray, known: np.ndarray, tree: Tree, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, place of each word's first): known words are their cells, unknown ones are spelled. keep: the words meant, if not all."""
    size = np.ones(len(known), np.int64)
    odd = np.flatnonzero(~known)
    at = odd if keep is None else keep[odd]
    spelt = words.take(pa.array(at)).to_pylist() if isinstance(words, pa.Array) else [words[i] for i in at.tolist()]
    size[odd] += np.fromiter(map(len, spelt), np.int64, len(spelt)) + 1
    first = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int32)
    rest = np.ones(len(out), bool)
    rest[first] = False
    out[first] = np.where(known, cell, tree.unknown)
    if len(odd):
        out[rest] = np.frombuffer(b" ".join(spelt) + b" ", np.uint8).astype(np.int32) + tree.byte
    return out, first


def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, token, n): tokens (kind 0) and bytes (kind 1; a blank for each word) of training texts."""
    letters, held, size = np.zeros(256, np.int64), [], 0

    def sums(kind: int, token: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(token), kind, np.int32)), token, n], ["kind", "token", "n"])

    def summed() -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return sums(0, *found.flatten())

    for part in parts:
        if not part.num_rows:
            continue
        tokens, per = tokens_of(part.column(0))
        bounds = np.frombuffer(tokens.buffers()[1], np.int32)[[tokens.offset, tokens.offset + len(tokens)]]
        if bounds[1] > bounds[0]:
            letters += np.bincount(np.frombuffer(tokens.buffers()[2], np.uint8)[bounds[0] : bounds[1]], minlength=256)
        letters[32] += np.maximum(1, per - 1).sum()
        held.append(tokens)
        size += int(bounds[1] - bounds[0])
        if size > SPLIT:
            yield summed()
            held, size = [], 0
    if held:
        yield summed()
    at = np.flatnonzero(letters)
    yield sums(1, pa.array([int(x).to_bytes(2, "big") for x in at], pa.binary()), pa.array(letters[at]))


def _pack(counts: np.ndarray) -> bytes:
    """Counts as four byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _level(n: np.ndarray) -> np.ndarray:
    return (n > 0).view(np.uint8) + (n > 2).view(np.uint8) + (n > 15).view(np.uint8)


def packed_odds(counts: np.ndarray) -> np.ndarray:
    """Log-odds as half floats whose two lowest bits hold the level; large pairs of counts are scaled down together."""
    scale = np.maximum(1, counts.max(axis=1, keepdims=True) / _TOP)
    counts = np.minimum(_TOP, np.ceil(counts / scale)).astype(np.int64)
    level = _level(counts.sum(axis=1))
    return ((_LOG[counts[:, 1]] - _LOG[counts[:, 0]]).astype(np.float16).view(np.uint16) & np.uint16(0xFFFC)) | level


def _slots(context: np.ndarray, count: np.ndarray, hashed: np.ndarray, mask: np.uint32) -> np.ndarray:
    """The slot of each bit, from its symbol's context and its node's hash."""
    slots = np.repeat(context, count)
    slots += hashed
    slots &= mask
    return slots.astype(np.int64)


def _mixed(weights: np.ndarray, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
    odds = np.zeros(x.shape[1], np.float32)
    for k in range(len(x)):
        part = weights[:, k].take(gate, mode="clip")
        part *= x[k]
        odds += part
    return np.clip(odds, -12, 12, out=odds)


def _bucket(odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
    at = np.clip(odds, -8, 8)
    at *= np.float32((BUCKETS - 1) / 16)
    at += np.float32((BUCKETS - 1) / 2 + 0.5)
    at = at.astype(np.int64)
    at += gate * BUCKETS
    return at


def _squashed(odds: np.ndarray) -> np.ndarray:
    p = np.exp(-odds)
    p += 1
    return np.divide(1, p, out=p)


def _first_weights() -> np.ndarray:
    """The exact counts are trusted at first, and the contexts, once met, a little."""
    return np.tile(np.array([0.8, 0.2, 0.2], np.float32), (GATES, 1))


class Learner:
    """Counts, weights and the refining table of one chunk, learned online: each batch is predicted before it is counted."""

    def __init__(self, tree: Tree, bits: int):
        self.tree, self.mask = tree, np.uint32((1 << bits) - 1)
        self.tables = [np.full(2 << bits, 0, np.int32) for _ in range(CONTEXTS)]  # filled, as np.zeros would not ask for large pages
        self.weights = _first_weights()
        self.seen = np.zeros(GATES)
        self.table = np.zeros(GATES * BUCKETS * 2)

    def learn(self, symbols: np.ndarray, starts: np.ndarray) -> None:
        """symbols of texts, one after another, that begin at starts."""
        tree, context = self.tree, self.tree.contexts(symbols, starts)
        for a in range(0, len(symbols), BATCH):
            some = symbols[a : a + BATCH]
            count, at = tree.bits_of(some)
            bit, hashed = tree.bit.take(at, mode="clip"), tree.path_hash.take(at, mode="clip")
            gate = np.repeat((some >= tree.byte).view(np.uint8) << np.uint8(4), count)
            x = np.empty((INPUTS, len(bit)), np.float32)
            tree.path_odds.take(at, out=x[0], mode="clip")
            slots = [_slots(c[a : a + BATCH], count, hashed, self.mask) for c in context]
            for k, s in enumerate(slots):
                pair = self.tables[k].view(np.int64).take(s, mode="clip").view(np.int32)  # the counts of 0 and 1 in turn
                gate |= _level(pair[::2] + pair[1::2]) << np.uint8(2 * k)
                logs = _LOG.take(pair, mode="clip")
                np.subtract(logs[1::2], logs[::2], out=x[k + 1])
            gate = gate.astype(np.int64)
            odds = _mixed(self.weights, gate, x)
            self.table += np.bincount(_bucket(odds, gate) * 2 + bit, minlength=len(self.table))
            wrong = bit - _squashed(odds)
            n = np.bincount(gate, minlength=GATES)
            self.seen += n
            for k in range(INPUTS):
                self.weights[:, k] += RATE * np.bincount(gate, wrong * x[k], GATES) / np.maximum(256, n)
            for k, s in enumerate(slots):
                s *= 2
                s += bit
                np.add.at(self.tables[k], s, np.int32(1))

    def sums(self) -> np.ndarray:
        return np.concatenate([(self.weights * self.seen[:, None]).ravel(), self.seen, self.table])

    def rows(self) -> list[tuple[int, int, bytes]]:
        """(k, piece, counts): the weights' sums (k -1) and the tables in pieces."""
        return [(-1, 0, self.sums().tobytes()), *((k, i, _pack(piece)) for k in range(CONTEXTS) for i, piece in enumerate(np.split(self.tables[k], PIECES)))]


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pid")
    k = int(rows["k"].iloc[0])
    if k < 0:
        total = sum(np.frombuffer(x, np.float64) for x in rows["counts"]).tobytes()
    else:
        total = _pack(np.minimum(sum(_unpack(x).astype(np.int64) for x in rows["counts"]), 2**32 - 1))
    return pd.DataFrame({"pid": [int(rows["pid"].iloc[0]) // FAN_IN], "k": [k], "piece": [rows["piece"].iloc[0]], "counts": [total]})


class Model:
    """The log-odds and level of every slot, the weights of every gate and the refining table of probabilities."""

    def __init__(self, tree: Tree, tables: list[np.ndarray], sums: np.ndarray):
        self.tree, self.tables, self.mask = tree, tables, np.uint32(len(tables[0]) - 1)
        w, seen, table = np.split(sums, [GATES * INPUTS, GATES * (INPUTS + 1)])
        self.weights = np.where(seen[:, None] > 0, w.reshape(GATES, -1) / np.maximum(1, seen)[:, None], _first_weights()).astype(np.float32)
        middle = 1 / (1 + np.exp(-(np.arange(BUCKETS) * (16 / (BUCKETS - 1)) - 8)))
        table = table.reshape(GATES, BUCKETS, 2)
        self.refine = ((table[..., 1] + 32 * middle) / (table.sum(axis=2) + 32)).ravel().astype(np.float32)

    def log10(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each text's symbols, and by the exact counts alone (of its words); its copy of the weights goes on learning after each segment."""
        total = np.zeros((2, len(texts)))
        size = np.array([len(x) for x in texts], np.int64)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 32 * BATCH, side="right")) + at)
            total[:, at:end] = self._scored(texts[at:end])
            at = end
        return total[0], total[1]

    def _scored(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in texts], np.int64)
        symbols = np.concatenate(texts)
        starts = (np.cumsum(size) - size)[size > 0]
        context = self.tree.contexts(symbols, starts)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        segment = (np.arange(len(symbols)) - np.repeat(np.cumsum(size) - size, size)) // SEGMENT
        by = np.argsort(segment, kind="stable")
        moved = np.zeros((len(texts), INPUTS), np.float32)  # what each text has learned so far
        total, alone, belief = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
        # Parts of texts, segment by segment; some at a time, so that a processor's cache holds their bits.
        doc, segment = doc[by], segment[by]
        begin = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (segment[1:] != segment[:-1]))) if len(by) else np.empty(0, np.int64)
        end = np.append(begin[1:], len(by))
        first = 0
        while first < len(begin):
            last = max(first + 1, min(int(np.searchsorted(end, begin[first] + BATCH, side="right")), int(np.searchsorted(segment[begin], segment[begin[first]], side="right"))))
            a, z, text = begin[first], end[last - 1], doc[begin[first:last]]
            some = symbols[by[a:z]]
            self._part(some, [c[by[a:z]] for c in context], begin[first:last] - a, text, size[text] > (segment[a] + 1) * SEGMENT, moved, total, alone, belief)
            first = last
        return total, alone

    def _part(self, some: np.ndarray, context: list[np.ndarray], begin: np.ndarray, text: np.ndarray, on: np.ndarray, moved: np.ndarray, total: np.ndarray, alone: np.ndarray, belief: np.ndarray) -> None:
        """Score a segment of each of some texts: their symbols begin at begin; on: whether a text goes on after it."""
        tree = self.tree
        count, at = tree.bits_of(some)
        bits = np.add.reduceat(count, begin)
        if not bits.all():  # a text all of whose bits here are certain
            held = bits > 0
            begin, text, on, bits = begin[held], text[held], on[held], bits[held]
        if not len(text):
            return
        first = np.cumsum(bits) - bits
        bit, hashed = tree.bit.take(at, mode="clip"), tree.path_hash.take(at, mode="clip")
        spelt = some >= tree.byte
        gate = np.repeat(spelt.view(np.uint8) << np.uint8(4), count)
        x = np.empty((INPUTS, len(at)), np.float32)
        tree.path_odds.take(at, out=x[0], mode="clip")
        for k, c in enumerate(context):
            both = self.tables[k].take(_slots(c, count, hashed, self.mask), mode="clip")
            gate |= (both.astype(np.uint8) & np.uint8(3)) << np.uint8(2 * k)
            _ODDS.take(both, out=x[k + 1], mode="clip")
        gate = gate.astype(np.int64)
        odds = _mixed(self.weights, gate, x)
        for k in range(INPUTS):
            if moved[text, k].any():
                odds += np.repeat(moved[text, k], bits) * x[k]
        p = _squashed(odds)
        mixed = self.refine.take(_bucket(odds, gate), mode="clip")
        mixed += p
        mixed *= np.float32(0.5)
        mixed += bit - np.float32(1)  # the chance of 1, or that of 0 below zero
        np.abs(mixed, out=mixed)
        by_bit = np.log(np.clip(mixed, 1e-6, 1, out=mixed), out=mixed).astype(np.float64)
        by_mix = np.add.reduceat(by_bit, first)
        by_counts = np.add.reduceat(np.where(spelt, 0, tree.alone.take(some, mode="clip")), begin) * math.log(10)
        if spelt.any():
            by_bit *= gate > 15
            by_counts += np.add.reduceat(by_bit, first)
        # log of (e^b * mix + counts) / (e^b + 1), b the belief in the mix.
        ahead, b = by_mix - by_counts, belief[text]
        total[text] += (by_counts + np.logaddexp(b + ahead, 0) - np.logaddexp(b, 0)) / math.log(10)
        alone[text] += by_counts / math.log(10)
        belief[text] = np.clip(b + ahead, -BELIEF, BELIEF)
        if on.any():
            wrong = bit - p
            n = np.sqrt(bits)
            for k in range(INPUTS):
                moved[text, k] += DOC_RATE * np.add.reduceat(wrong * x[k], first) / n


def trained(rows: DataFrame, tree: Tree, bits: int, chunks: int) -> Model:
    """The model of all chunks' tables (pid, k, piece, counts), which are added up in rounds."""
    while True:
        rows = written(rows.groupBy("k", "piece", F.floor(F.col("pid") / FAN_IN).alias("next")).applyInPandas(_added, "pid long, k int, piece int, counts binary"), "count-tables")
        chunks = -(-chunks // FAN_IN)
        if chunks <= 1:
            break
    tables = [np.zeros((PIECES, (1 << bits) // PIECES), np.uint16) for _ in range(CONTEXTS)]
    none = packed_odds(np.zeros((1, 2)))
    for t in tables:
        t[:] = none
    sums = np.zeros(GATES * (INPUTS + 1 + 2 * BUCKETS))
    for r in rows.toLocalIterator():  # of a number and size that follow from the bits
        if r["k"] < 0:
            sums = np.frombuffer(r["counts"], np.float64)
        else:
            tables[r["k"]][r["piece"]] = packed_odds(_unpack(r["counts"]).reshape(-1, 2))
    return Model(tree, [t.ravel() for t in tables], sums)


def placed(vocabulary: DataFrame, n_all: int, depth: int) -> DataFrame:
    """(token, n, cell): every token's place among the cells. There are at most sqrt(2 N) different counts."""
    steps = vocabulary.groupBy("n").agg((F.count(F.lit(1)) * F.col("n")).alias("mass"))
    before = F.coalesce(F.sum("mass").over(Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = written(steps.select("n", "mass", before.alias("before")), "count-steps")
    share = F.shiftrightunsigned(F.xxhash64("token"), 11) * F.lit(2.0**-53)
    cell = F.floor((F.col("before") + share * F.col("mass")) / n_all * (1 << depth))
    return vocabulary.join(small_side(steps), "n").select("token", "n", F.least(cell, F.lit((1 << depth) - 1)).cast("int").alias("cell"))


#: A text's row (k -2) or a piece of a chunk's tables.
CODED_ROWS = pa.schema(
    [("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("within", pa.float64()),
     ("n_bytes", pa.int64()), ("symbols", pa.list_(pa.int32())), ("pid", pa.int64()), ("k", pa.int32()), ("piece", pa.int32()), ("counts", pa.binary())])


def _coded_rows(*columns) -> pa.Table:
    return pa.table([x.cast(f.type) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for x, f in zip(columns, CODED_ROWS, strict=True)], schema=CODED_ROWS)


def _coder(tree: Tree, bits: int, masses: np.ndarray, n_all: int, distinct: int):
    """Codes a chunk's rows and learns its training rows."""
    unit = math.log10(n_all + distinct + 1)

    def coded(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows.select(["place", "doc_id"]), [("place", "ascending"), ("doc_id", "ascending")], null_placement="at_start"))
        vocabulary = known["token"].combine_chunks()
        n, cell = np.append(known["n"].to_numpy(), 0), np.append(known["cell"].to_numpy(), np.int32(0))
        with np.errstate(divide="ignore"):
            inside = np.log10(n) - np.log10(masses[cell])
        base = np.log10(n + 1) - unit
        train, learner, out = rows["train"].to_numpy(), Learner(tree, bits), []
        length = pc.fill_null(pc.utf8_length(rows["text"]), 0).to_numpy().astype(np.int64)
        size = length.cumsum()

        def until(at: int, most: int) -> int:
            return max(at + 1, int(np.searchsorted(size, size[at] - length[at] + most, side="right")))

        at = read = 0
        while at < len(rows):
            if at == read:
                read = until(at, SPLIT)
                words, per_text = tokens_of(rows["text"][at:read].combine_chunks())
                places = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy()
                begin, since = np.append(0, np.cumsum(per_text)), at
            end = min(read, until(at, CODED))
            per, part = per_text[at - since : end - since].astype(np.int64), slice(begin[at - since], begin[end - since])
            of = places[part].astype(np.int64)
            doc = np.repeat(np.arange(end - at), per)
            symbols, first = symbols_of(words[part], cell[of], of >= 0, tree)
            begins = first[np.cumsum(per) - per]
            within = np.bincount(doc[of >= 0], inside[of[of >= 0]], end - at)
            summed = np.bincount(doc, base[of], end - at)
            hit = np.bincount(doc, of >= 0, end - at).astype(np.int64)
            out.append(_coded_rows(rows["doc_id"][at:end], ~train[at:end], per, hit, summed, within, length[at:end], pa.ListArray.from_arrays(np.append(begins, len(symbols)).astype(np.int32), symbols), *([x] * (end - at) for x in (0, -2, 0, b""))))
            use = train[at:end]
            if use.any():
                keep = np.flatnonzero(use[doc])
                symbols, first = symbols_of(words[part], cell[of[keep]], n[of[keep]] > 1, tree, keep)
                learner.learn(symbols, first[np.cumsum(per[use]) - per[use]])
            at = end
        if train.any():
            pid, found = rows["chunk"][0].as_py(), learner.rows()
            release()
            out.append(_coded_rows(*([x] * len(found) for x in (None, False, 0, 0, 0.0, 0.0, 0, [], pid)), *zip(*found, strict=True)))
        return pa.concat_tables(out) if out else CODED_ROWS.empty_table()

    return coded


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, counts_score, bits_per_byte) for every row; counts_score: with words by the exact counts alone; training: the predicate of rows that train."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    kind = dict(base.dtypes)["doc_id"]
    base = base.withColumn("doc_id", F.col("doc_id").cast("string"))
    counts = written(base.where("train").select("text").mapInArrow(releasing(counted), "kind int, token binary, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")), "token-counts")
    letters = {int.from_bytes(r["token"], "big"): r["n"] for r in counts.where("kind = 1").collect()}  # 256 rows at most
    vocabulary = counts.where("kind = 0").select("token", "n")
    whole = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("singles")).first()
    n_all, distinct = whole["n"] or 0, whole["v"]
    depth = depth_of(n_all)
    bits = min(MOST_BITS, depth + MORE_BITS)
    vocabulary = written(placed(vocabulary, max(1, n_all), depth), "vocabulary")
    cells = {r["cell"]: r["n"] for r in vocabulary.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # 2**depth at most
    tree = Tree(depth, cells, whole["singles"], letters)
    masses = np.ones(1 << depth)
    masses[list(cells)] = list(cells.values())
    size = base.agg(F.sum(F.octet_length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    chunks = int(max((size["n"] or 0) // CHUNK, size["rows"] // CHUNK_ROWS)) + 1
    place = F.xxhash64("doc_id", "text")
    dealt = base.select("doc_id", "text", "train", place.alias("place"), F.pmod(place, F.lit(chunks)).cast("int").alias("chunk"))

    def tokens(rows: pa.Table) -> pa.Table:
        found = pc.unique(pa.chunked_array([tokens_of(x)[0] for x in rows["text"].chunks] + [pa.array([END_TOKEN], pa.binary())]))
        return pa.table({"chunk": np.full(len(found), rows["chunk"][0].as_py(), np.int32), "token": found})

    asked = dealt.groupBy("chunk").applyInArrow(tokens, "chunk int, token binary")
    answered = asked.join(vocabulary, "token").select("chunk", "token", "n", "cell")
    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, within double, n_bytes long, symbols array<int>, pid long, k int, piece int, counts binary"
    coder = _coder(tree, bits, masses, n_all, distinct)
    coded = written(dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(coder, schema), "coded")
    handed = spark.sparkContext.broadcast(trained(coded.where("k > -2").select("pid", "k", "piece", "counts"), tree, bits, chunks))

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            symbols = part["symbols"]
            texts = np.split(symbols.flatten().to_numpy(), np.cumsum(symbols.value_lengths().to_numpy())[:-1])
            score, alone = (x + part["within"].to_numpy() for x in handed.value.log10(texts))
            bits = -score / math.log10(2) / (part["n_bytes"].to_numpy() + 1)
            kept = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), *map(pa.array, (score, alone, bits))], [*kept, "score", "counts_score", "bits_per_byte"])

    rows = coded.where("k = -2").select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "n_bytes", "symbols")
    out = rows.mapInArrow(releasing(scored), "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double, counts_score double, bits_per_byte double")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "counts_score", "bits_per_byte")
