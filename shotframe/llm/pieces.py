"""SentencePiece encoding and decoding by suffix-array matching.

Text is cut into units (a run of spaces with what follows up to the next space or line end); no piece of the vocabulary
reaches over a unit's end, which is checked when the model is loaded. The batch's distinct new units are concatenated
and indexed by a suffix array; every piece is binary-searched for the range of its occurrences; these are the lattice's
edges. They are sorted by position and relaxed from left to right: the model merges pairs by score (BPE), and a sequence
of pieces is its result exactly if each two neighbours are what it makes of their concatenation; so of the edges that end
at a place just one fits the best last piece at its start. Characters outside the vocabulary become byte pieces.

Defined results: a null text is empty and has no pieces; a text that holds U+2581 decodes it as a space (as the format
does) and is marked so by ``round_trip``; very long texts are encoded whole, a unit's length only adds relaxation steps;
repeated rows are encoded one by one; an empty table gives no rows. The model's bytes (its size is checked) go to tasks.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, small_batches
from .words import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 16 << 20
SPACE = "▁"
#: Bytes of distinct units that one suffix array indexes, and units whose pieces a worker remembers.
INDEX_BYTES, REMEMBER = 256 << 10, 400_000
#: Ids whose bytes are gathered at once.
GATHERED = 1 << 16
#: Bytes of a suffix that the binary search compares at first.
KEY = 16
_UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        out = f.read(MAX_MODEL_BYTES + 1)
    if len(out) > MAX_MODEL_BYTES:
        raise ValueError(f"the model is larger than {MAX_MODEL_BYTES} bytes")
    return out


class PairTable:
    """Remembered answers for pairs of pieces, looked up many at a time (open addressing in numpy)."""

    def __init__(self, bits: int = 21):
        self.mask = np.uint64((1 << bits) - 1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(int(self.mask) + 1, -1, np.int64)
        self.answers = np.zeros(int(self.mask) + 1, bool)
        self.n = 0

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free slot where it would go."""
        at = (mix(keys.view(np.uint64)) & self.mask).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & int(self.mask)
            open_ = open_[(self.keys[at[open_]] != keys[open_]) & (self.keys[at[open_]] != -1)]
        return at

    def add(self, keys: np.ndarray, answers: list[bool]) -> None:
        """Insert distinct new keys, all at once: of those that meet at a free slot one takes it, the others try the next."""
        answers = np.array(answers, bool)
        at = self.places(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]
            done = self.keys[at[left]] == keys[left]
            self.answers[at[left[done]]] = answers[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & int(self.mask)
        self.n += len(keys)


class Pieces:
    """The vocabulary of a model, and its encoder and decoder."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.names = {i: sp.id_to_piece(i) for i in plain}
        if any(SPACE in x.lstrip(SPACE) or "\n" in x for x in self.names.values()):
            raise ValueError("a piece reaches over the end of a unit")
        self.score = {x: sp.get_score(i) for i, x in self.names.items()}
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.size = n
        order = sorted(plain, key=lambda i: self.names[i].encode())
        self.ids = np.array(order, np.int64)
        self.depth = -(-max(len(x.encode()) for x in self.names.values()) // 8) * 8
        raw = [self.names[i].encode() for i in order]
        self.low = np.array([x[:KEY] for x in raw], f"S{KEY}")
        self.high = np.array([x[:KEY].ljust(KEY, b"\xff") for x in raw], f"S{KEY}")
        self.length = np.zeros(n, np.int64)
        self.length[self.ids] = [len(x) for x in raw]
        self.strange: list[str] = []  # characters outside the vocabulary, numbered from self.size
        self.strange_at: dict[str, int] = {}
        self.pairs = PairTable()
        self._forget()
        bytes_of = {i: x.replace(SPACE, " ").encode() for i, x in self.names.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()} | {self.unknown: " ⁇ ".encode()}
        spelt = [bytes_of.get(i, b"") for i in range(n)]
        # The pieces' bytes, one piece after another; the last one stands for ids outside the vocabulary.
        self.spelt, self.spelt_size = np.frombuffer(b"".join(spelt), np.uint8), np.array([*map(len, spelt), 0], np.int64)
        self.spelt_first = np.cumsum(self.spelt_size) - self.spelt_size

    def _forget(self) -> None:
        """Empty the store: unit -> row, and the rows' ids, one after another."""
        self.known: dict[str, int] = {}
        self.stored, self.counts, self.firsts = [np.empty(0, np.int32)], np.empty(0, np.int64), np.empty(0, np.int64)

    def text_of(self, piece: int) -> str:
        return self.names[piece] if piece < self.size else self.strange[piece - self.size]

    def stays_apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of left + right by score gives just these two."""
        parts, border, get, never = [*left, *right], len(left), self.score.get, -math.inf
        scores = [get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best = max(scores)
            if best == never:
                return True
            at = scores.index(best)
            if at == border - 1:
                return False
            parts[at] += parts.pop(at + 1)
            del scores[at]
            border -= at < border
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], never)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], never)
            if not scores:
                return True

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * np.int64(1 << 24) + right
        at = self.pairs.places(keys)
        new = self.pairs.keys[at] == -1
        if new.any():
            fresh = np.unique(keys[new])
            if self.pairs.n + len(fresh) > int(self.pairs.mask) // 2:
                self.pairs.clear()
                fresh = np.unique(keys)
            if len(fresh) > int(self.pairs.mask) // 2:  # more pairs at once than the table holds: answered directly
                answers = np.array([self.stays_apart(self.text_of(int(k >> 24)), self.text_of(int(k & 0xFFFFFF))) for k in fresh])
                return answers[np.searchsorted(fresh, keys)]
            self.pairs.add(fresh, [self.stays_apart(self.text_of(int(k >> 24)), self.text_of(int(k & 0xFFFFFF))) for k in fresh])
            at = self.pairs.places(keys)
        return self.pairs.answers[at]

    def suffix_array(self, t: np.ndarray, places: np.ndarray) -> np.ndarray:
        """places sorted by the bytes that follow them, to the depth of the longest piece."""
        wide = np.concatenate([t, np.zeros(self.depth + 8, np.uint8)])
        word = np.zeros(len(t) + self.depth, np.uint64)
        for i in range(8):
            word = (word << np.uint64(8)) | wide[i : i + len(word)]
        sa = places[np.lexsort((word[places + 8], word[places]))]
        # Ties of 16 bytes are sorted further, by run.
        first, second = word[sa], word[sa + 8]
        tied = np.zeros(len(sa) + 1, bool)
        tied[1:-1] = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        if tied.any() and self.depth > 16:
            where = np.flatnonzero(tied[1:] | tied[:-1])
            run, held = np.cumsum(~tied[where]), sa[where]
            sa[where] = held[np.lexsort([word[held + k] for k in range(self.depth - 8, 8, -8)] + [run])]
        return sa

    def edges(self, t: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece) of every occurrence of a piece, by binary search in the suffix array."""
        sa = self.suffix_array(t, starts)
        wide = np.concatenate([t, np.zeros(self.depth, np.uint8)])
        keys = np.ascontiguousarray(wide[sa[:, None] + np.arange(KEY)]).view(f"S{KEY}").ravel()
        low, high = np.searchsorted(keys, self.low, side="left"), np.searchsorted(keys, self.high, side="right")
        for i in np.flatnonzero((self.length[self.ids] > KEY) & (high > low)):  # the few pieces longer than a key
            name = self.names[self.ids[i]].encode()
            inside = [wide[x : x + len(name)].tobytes() for x in sa[low[i] : high[i]]]
            low[i], high[i] = low[i] + bisect_left(inside, name), low[i] + bisect_right(inside, name)
        count = high - low
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return sa[at].astype(np.int32), np.repeat(self.ids.astype(np.int32), count)

    def _index(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the units, one after another, and how many each has."""
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        size = np.array([len(x) for x in raw])
        t = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        starts = np.flatnonzero(((t & 0xC0) != 0x80) & (t != 0xFF))
        start, piece = self.edges(t, starts)
        length = self.length[piece].astype(np.int32)
        # Characters that are no piece get an edge of their own.
        wide = np.append(starts, len(t))
        char = np.zeros(len(t) + 1, np.int64)
        lead = t[starts]
        char[starts] = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        own = np.zeros(len(t) + 1, bool)
        own[start[length == char[start]]] = True
        odd = starts[~own[starts]]
        if len(odd):
            more = []
            for p in odd:
                c = t[p : p + char[p]].tobytes().decode("utf-8", "surrogatepass")
                if c not in self.strange_at:
                    self.strange_at[c] = self.size + len(self.strange)
                    self.strange.append(c)
                more.append(self.strange_at[c])
            start, piece, length = (np.append(x, y).astype(np.int32) for x, y in ((start, odd), (piece, more), (length, char[odd])))
        del wide
        unit = (np.searchsorted(begin, start, side="right") - 1).astype(np.int32)
        step = (start + length - begin[unit]).astype(np.int32)
        by = np.argsort(step, kind="stable")
        start, piece, length, unit, step = start[by], piece[by], length[by], unit[by], step[by]
        last, back = np.full(len(t) + 1, -1, np.int64), np.zeros(len(t) + 1, np.int64)
        for group in np.split(np.arange(len(step)), np.flatnonzero(np.diff(step)) + 1) if len(step) else ():
            s, p = start[group], piece[group]
            before = last[s]
            ok = s == begin[unit[group]]
            inner = np.flatnonzero(~ok & (before >= 0))
            if len(inner):
                ok[inner] = self.fits(before[inner], p[inner])
            end = s[ok] + length[group[ok]]
            last[end], back[end] = p[ok], s[ok]
        # All units are read back at once, a piece a round.
        rows, tokens = [], []
        live, at = np.arange(len(units)), begin + size
        while len(live):
            rows.append(live)
            tokens.append(last[at])
            at = back[at]
            on = at > begin[live]
            live, at = live[on], at[on]
        of, token = np.concatenate(rows)[::-1], np.concatenate(tokens)[::-1]
        by = np.argsort(of, kind="stable")
        token = token[by]
        counts = np.bincount(of, minlength=len(units))
        if (token >= self.size).any():
            spelt = [self._bytes(self.strange[p - self.size]) if p >= self.size else [p] for p in token.tolist()]
            sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
            counts = np.bincount(of[by], sizes, len(units)).astype(np.int64)
            token = np.fromiter((x for xs in spelt for x in xs), np.int64, int(sizes.sum()))
        return token.astype(np.int32), counts

    def _bytes(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw] if len(self.byte_ids) == 256 else [self.unknown]

    def _remember(self, units: list[str]) -> None:
        """Encode units and append their ids to the store."""
        at = 0
        while at < len(units):
            end, size = at, 0
            while end < len(units) and (end == at or size < INDEX_BYTES):
                size += len(units[end]) * 2
                end += 1
            ids, counts = self._index(units[at:end])
            self.known.update(zip(units[at:end], range(len(self.known), len(self.known) + end - at), strict=True))
            self.stored.append(ids)
            self.counts = np.append(self.counts, counts)
            at = end
        self.stored = [np.concatenate(self.stored)]
        self.firsts = np.cumsum(self.counts) - self.counts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        units = [_UNIT.findall(SPACE + x.replace(" ", SPACE)) if x else [] for x in texts]
        flat = [u for us in units for u in us]
        row = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missed = np.flatnonzero(row < 0)
        new = list(dict.fromkeys([flat[i] for i in missed.tolist()]))
        if len(self.known) + len(new) > REMEMBER:
            self._forget()
            missed, new = np.arange(len(flat)), list(dict.fromkeys(flat))
        if len(self.strange) > 100_000:
            self.strange, self.strange_at = [], {}
            self.pairs.clear()
        if new:
            self._remember(new)
            row[missed] = [self.known[flat[i]] for i in missed.tolist()]
        count = self.counts[row]
        before = np.cumsum(count) - count
        ids = self.stored[0][np.arange(count.sum()) + np.repeat(self.firsts[row] - before, count)] if len(row) else np.empty(0, np.int32)
        ends = np.append(before, count.sum())[np.cumsum([len(us) for us in units])] if units else []
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids) -> str:
        return self.decode_all([np.asarray(ids, np.int64)])[0]

    def decode_all(self, texts: list[np.ndarray]) -> list[str]:
        """The text of each array of ids; the bytes of many ids are gathered at once."""
        if not texts:
            return []
        ids = np.concatenate(texts)
        ids = np.where((ids < 0) | (ids >= self.size), self.size, ids)
        size = self.spelt_size[ids]
        raw = []
        for a in range(0, len(ids), GATHERED):
            some = size[a : a + GATHERED]
            at = np.repeat(self.spelt_first[ids[a : a + GATHERED]] - (np.cumsum(some) - some), some)
            at += np.arange(len(at))
            raw.append(self.spelt[at].tobytes())
        raw = b"".join(raw)
        stops = np.append(0, np.cumsum(size))[np.cumsum([len(x) for x in texts])].tolist()
        out = [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        return [x[1:] if x[:1] == " " else x for x in out]


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model's vocabulary, kept for the life of a worker."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = Pieces(model)
    return _LOADED[model]


def _coder(model: bytes):
    def coded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = loaded(model)
        for texts in parts:
            ids, back = [], []
            for at in range(0, len(texts), 256):
                some = list(texts.iloc[at : at + 256])
                found = pieces.encode(some)
                ids += found
                back += [y == (x or "") for y, x in zip(pieces.decode_all(found), some, strict=True)]
            yield pd.DataFrame({"ids": ids, "round_trip": back})
        pieces._forget()  # the worker may wait for other stages' tasks; the pairs' table stays

    return F.pandas_udf(releasing(coded), "ids array<int>, round_trip boolean")


def encoded(text: Column, path: str = MODEL) -> Column:
    """A struct of the text's piece ids and whether decoding them gives the text."""
    small_batches()
    return _coder(model_bytes(path))(text.cast("string"))


def decoded(ids: Column, path: str = MODEL) -> Column:
    """The text of an array of piece ids (null: null)."""
    model = model_bytes(path)

    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = loaded(model)
        for part in parts:
            yield pd.Series([None if x is None else pieces.decode(x) for x in part])

    return F.pandas_udf(texts, "string")(ids)


def encode_documents(docs: DataFrame, text_col: str = "text", path: str = MODEL, ids_col: str = "ids", count_col: str = "n_tokens", back_col: str = "round_trip") -> DataFrame:
    """docs with ids, n_tokens and round_trip."""
    name = "__coded"
    while name in docs.columns:
        name += "_"
    out = docs.withColumn(name, encoded(F.col(f"`{text_col}`"), path))
    return out.select(*docs.columns, F.size(F.col(f"{name}.ids")).cast("long").alias(count_col), F.col(f"{name}.ids").alias(ids_col), F.col(f"{name}.round_trip").alias(back_col))
