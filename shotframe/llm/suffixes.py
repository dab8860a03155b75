"""Suffix-array dedup: removes every byte covered by a string of LENGTH bytes that also starts earlier.

Every window of LENGTH bytes has an anchor: the leftmost least hashed GRAM inside it. Equal windows have equal anchors at
equal places, so anchors cut the corpus into suffix buckets that can be sorted one by one. A run of windows with one
anchor is a fragment. Plan:

1. Tasks cut texts into fragments (numpy over pieces of bounded size) and send one small row for each fragment that is
   the first with its content in the task's block; later ones are removable at once. A hot passage thus sends a row a
   block, not a row a document.
2. Rows meet by anchor. Of fragments with equal content the earliest stays; anchors with several contents need sorting.
3. The texts of those fragments only are cut out again, dealt into buckets by anchor and sorted: by anchor, place and the
   first V bytes, ties resolved by the ranks of a difference-cover sample (precomputed for the block by doubling).
   Neighbours that share LENGTH bytes are equal windows; all but the earliest are removable.
4. Removable runs are gathered by document and cut out of its bytes.

Order is by (doc_id, digest of the text, start). Defined results: a null text is empty; a null doc_id comes before all
others; rows with the same doc_id and the same text are one document and get the same answer, while of equal ids with
different texts the smaller digest is earlier; texts shorter than LENGTH lose nothing; an empty table gives no rows;
other columns are ignored. ``clean`` trims runs to whole characters, so that the remaining text is valid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, releasing, small_batches, written
from .words import mix

LENGTH, GRAM = 100, 20
#: Bytes of text that a task holds at once: of one piece (for arrays of 8 bytes each) and of one block of fragments.
PIECE, BLOCK = 1 << 19, 12 << 20
#: Bytes of fragments in a bucket, and of one sorted part of it.
BUCKET, PART = 4 << 20, 1 << 20
# A difference cover modulo 7.
V, COVER = 7, (0, 1, 3)
_NULL_ID = -(2**63)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class _Hasher:
    """Hashes of substrings: prefix sums of byte * base**i, divided by base**start (odd bases have inverses modulo 2**64)."""

    def __init__(self):
        self.size = 0

    def reach(self, n: int) -> None:
        if n > self.size:
            self.size = n + 1
            self.up = [_powers(b, self.size) for b in (_BASE, _BASE2)]
            self.down = [_powers(np.uint64(pow(int(b), -1, 2**64)), self.size) for b in (_BASE, _BASE2)]

    def prefix(self, t: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(t) + 1, np.uint64)
        np.cumsum((t.astype(np.uint64) + np.uint64(1)) * self.up[which][: len(t)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[which][start])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours, by block-wise running minima."""
    n = len(x)
    full = -(-n // w) * w
    pad = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad[:n] = x
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def fragments(t: np.ndarray, ends: np.ndarray, hasher: _Hasher) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor place, anchor hash, content hash) of the fragments of concatenated documents that end at ``ends``."""
    n = len(t)
    if n < LENGTH:
        return tuple(np.empty(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hasher.reach(n + 1)
    prefix = hasher.prefix(t, 0)
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * hasher.down[0][: n - GRAM + 1])
    place = np.arange(n - GRAM + 1, dtype=np.uint64)
    least = _window_min((grams & np.uint64(0xFFFFFFFF00000000)) | place, LENGTH - GRAM + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.arange(n - LENGTH + 1)
    inside = np.ones(len(at), bool)
    for e in ends[:-1] if len(ends) < 4096 else ():
        inside[max(0, e - LENGTH + 1) : e] = False
    if len(ends) >= 4096:
        inside = at + LENGTH <= ends[np.searchsorted(ends, at, side="right")]
    at, anchor = at[inside], anchor[inside]
    if not len(at):
        return fragments(t[:0], ends[:0], hasher)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, anchor = at[first], anchor[first]
    content = hasher.spans(hasher.prefix(t, 1), 1, start, start + count - 1 + LENGTH)
    content = mix(content ^ (count.astype(np.uint64) << np.uint64(20)) ^ (anchor - start).astype(np.uint64))
    return start, count, anchor, grams[anchor], content


def _pieces(docs: list[tuple[int, int, bytes]]) -> Iterator[tuple[bytes, list[tuple[int, int]], np.ndarray]]:
    """Concatenations of whole documents up to PIECE, longer documents in overlapping parts: (bytes, [(document, offset)], ends)."""
    held: list[bytes] = []
    marks: list[tuple[int, int]] = []
    size = 0
    for i, (_, _, raw) in enumerate(docs):
        for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
            part = raw[at : at + PIECE + LENGTH - 1]
            if size and size + len(part) > PIECE:
                yield b"".join(held), marks, np.cumsum([len(x) for x in held])
                held, marks, size = [], [], 0
            held.append(part)
            marks.append((i, at))
            size += len(part)
    if size:
        yield b"".join(held), marks, np.cumsum([len(x) for x in held])


def _block_rows(docs: list[tuple[int, int, bytes]], hasher: _Hasher) -> pd.DataFrame:
    docs = sorted({(i, d): (i, d, raw) for i, d, raw in docs if len(raw) >= LENGTH}.values())
    parts = []
    for text, marks, ends in _pieces(docs):
        start, count, anchor, h, d = fragments(np.frombuffer(text, np.uint8), ends, hasher)
        if len(start):
            k = np.searchsorted(ends, start, side="right")
            of, offset = np.array([m[0] for m in marks])[k], np.array([m[1] for m in marks])[k]
            parts.append((of, start - np.append(0, ends)[k] + offset, count, h, d, anchor - start))
    names = ["kind", "h", "d", "id", "digest", "p0", "n", "lead"]
    if not parts:
        return pd.DataFrame({x: [] for x in names})
    of, p0, n, h, d, lead = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((p0, of, d, h))  # documents are in order, so the first of equal contents is the earliest
    same = np.zeros(len(order), bool)
    same[1:] = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
    later = np.zeros(len(order), bool)
    later[order[same]] = True
    ids, digests = np.array([x[0] for x in docs]), np.array([x[1] for x in docs])
    keep = ~later
    rows = {"kind": np.ones(keep.sum(), np.int8), "h": h[keep].view(np.int64), "d": d[keep].view(np.int64), "id": ids[of[keep]], "digest": digests[of[keep]], "p0": p0[keep], "n": n[keep], "lead": lead[keep]}
    # Neighbouring removable fragments become one run.
    o, s, c = of[later], p0[later], n[later]
    by = np.lexsort((s, o))
    o, s, c = o[by], s[by], c[by]
    if len(o):
        cut = np.ones(len(o), bool)
        cut[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1] + c[:-1])
        f = np.flatnonzero(cut)
        runs = np.add.reduceat(c, f)
        more = {"kind": np.zeros(len(f), np.int8), "h": digests[o[f]], "d": np.zeros(len(f), np.int64), "id": ids[o[f]], "digest": digests[o[f]], "p0": s[f], "n": runs, "lead": np.zeros(len(f), np.int64)}
        rows = {k: np.concatenate([rows[k], more[k]]) for k in names}
    return pd.DataFrame(rows)


def _cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher, held, size = _Hasher(), [], 0
    for part in parts:
        for i, d, raw in zip(part["id"], part["digest"], part["raw"], strict=True):
            held.append((i, d, raw))
            size += len(raw)
            if size >= BLOCK:
                yield _block_rows(held, hasher)
                held, size = [], 0
    if held:
        yield _block_rows(held, hasher)


def cover_ranks(t: np.ndarray) -> np.ndarray:
    """Ranks, to a depth of 16 V bytes, of the suffixes that start in the difference cover; 0 elsewhere and at the end."""
    n = len(t)
    sample = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
    rank = np.zeros(n + 8 * V + 1, np.int64)
    rank[sample] = np.unique(first_bytes(t, sample), return_inverse=True)[1] + 1
    step = V
    while step < LENGTH:
        rank[sample] = np.unique(rank[sample] * np.int64(n + 2) + rank[np.minimum(sample + step, n)], return_inverse=True)[1] + 1
        step *= 2
    return rank


def first_bytes(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first V bytes from each place as one number."""
    wide = np.concatenate([t, np.zeros(V, np.uint8)])
    out = np.zeros(len(at), np.int64)
    for i in range(V):
        out = (out << 8) | wide[at + i]
    return out


#: From each residue the distance to the next member of the cover.
_AHEAD = np.array([min((c - r) % V for c in COVER) for r in range(V)])


def repeated_windows(anchors: np.ndarray, lead: np.ndarray, counts: np.ndarray, texts: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, window) of every window that an earlier fragment has as well.

    lead: bytes before the anchor; order: the fragments' places in the order of the corpus. Fragments are laid out with
    their anchors at multiples of V, so equal windows have equal residues and meet the cover at the same distance."""
    lengths = np.array([len(x) for x in texts])
    begin, total = np.empty(len(texts), np.int64), 0
    for i in range(len(texts)):
        begin[i] = total + (-(total + lead[i])) % V
        total = begin[i] + lengths[i]
    t = np.zeros(total + LENGTH + V, np.uint8)
    for i, x in enumerate(texts):
        t[begin[i] : begin[i] + lengths[i]] = np.frombuffer(x, np.uint8)
    rank = cover_ranks(t)
    of = np.repeat(np.arange(len(texts)), counts)
    window = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[of] + window
    bucket = anchors[of] * np.int64(2 * LENGTH) + lead[of] - window
    sa = np.lexsort((order[of], rank[at + _AHEAD[at % V]], first_bytes(t, at), bucket))
    b, p = bucket[sa], at[sa]
    same = np.zeros(len(sa), bool)
    near = np.flatnonzero(b[1:] == b[:-1])
    for i in range(0, len(near), 50_000):
        part = near[i : i + 50_000]
        x, y = t[p[part][:, None] + np.arange(LENGTH)], t[p[part + 1][:, None] + np.arange(LENGTH)]
        same[part + 1] = (x == y).all(axis=1)
    # Of equal windows the earliest stays, wherever what follows them has sorted it.
    group = np.cumsum(~same)
    least = np.full(group.max() + 1 if len(group) else 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, order[of[sa]])
    out = sa[order[of[sa]] > least[group]]
    return of[out], window[out]


def _sorted_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["h", "id", "digest", "p0"], ignore_index=True)
    found = {k: [] for k in ("id", "digest", "p0", "n")}
    group = rows["h"].ne(rows["h"].shift()).cumsum().to_numpy()
    size = rows["raw"].str.len().to_numpy().cumsum()
    at = 0
    while at < len(rows):
        # Whole anchors up to PART bytes; a single larger one is taken alone.
        last = group[min(len(rows) - 1, max(at, np.searchsorted(size, (size[at - 1] if at else 0) + PART)))]
        end = int(np.searchsorted(group, last if last > group[at] else last + 1, side="left"))
        part = rows.iloc[at:end]
        # Rows of one document with one start are the same fragment and so tie.
        order = (part["id"].ne(part["id"].shift()) | part["digest"].ne(part["digest"].shift()) | part["p0"].ne(part["p0"].shift())).cumsum().to_numpy()
        of, window = repeated_windows(group[at:end], part["lead"].to_numpy(), part["n"].to_numpy(), list(part["raw"]), order)
        by = np.lexsort((window, of))
        of, window = of[by], window[by]
        if len(of):
            cut = np.ones(len(of), bool)
            cut[1:] = (of[1:] != of[:-1]) | (window[1:] != window[:-1] + 1)
            f = np.flatnonzero(cut)
            found["id"].append(part["id"].to_numpy()[of[f]])
            found["digest"].append(part["digest"].to_numpy()[of[f]])
            found["p0"].append(part["p0"].to_numpy()[of[f]] + window[f])
            found["n"].append(np.diff(np.append(f, len(of))))
        at = end
    return pd.DataFrame({k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in found.items()})


def _taken_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the wanted fragments."""
    for part in parts:
        out = []
        for i, digest, raw, wanted in zip(part["id"], part["digest"], part["raw"], part["wanted"], strict=True):
            for w in wanted:
                text = raw[w["p0"] : w["p0"] + w["n"] - 1 + LENGTH]
                out.append((w["h"], i, digest, w["p0"], w["n"], w["lead"], text))
        yield pd.DataFrame(out, columns=["h", "id", "digest", "p0", "n", "lead", "raw"])


def _keys(id_col: str, text_col: str) -> list:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text")]


def removable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, runs): for each document that loses bytes, its runs of removable windows (p0, n)."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(*_keys(id_col, text_col)).select("id", "digest", F.col("text").cast("binary").alias("raw"))
    rows = keyed.mapInPandas(releasing(_cut), "kind byte, h long, d long, id long, digest long, p0 long, n int, lead int")
    # Content that has come earlier goes; anchors with several contents are to be sorted.
    placed = Window.partitionBy("kind", "h", "d").orderBy("id", "digest", "p0")
    whole = Window.partitionBy("kind", "h")
    seen = rows.repartition("kind", "h").select("*", F.rank().over(placed).alias("nth")).select("*", (F.min("d").over(whole) != F.max("d").over(whole)).alias("mixed"))
    seen = written(seen.where("kind = 0 OR nth > 1 OR mixed").select("id", "digest", "p0", "n", "lead", "h", ((F.col("kind") == 1) & (F.col("nth") == 1)).alias("open")), "fragments")
    wanted = seen.where("open").groupBy("id", "digest").agg(F.collect_set(F.struct("h", "p0", "n", "lead")).alias("wanted"))
    total = seen.where("open").agg(F.sum(F.col("n") + LENGTH - 1).alias("n")).first()["n"] or 0
    buckets = max(partitions(spark), int(total // BUCKET) + 1)
    taken = keyed.join(wanted.hint("shuffle_hash"), ["id", "digest"]).mapInPandas(releasing(_taken_out), "h long, id long, digest long, p0 long, n int, lead int, raw binary")
    runs = taken.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).groupBy("bucket").applyInPandas(_sorted_bucket, "id long, digest long, p0 long, n int")
    every = runs.unionByName(seen.where("NOT open").select("id", "digest", "p0", "n"))
    return every.groupBy("id", "digest").agg(F.collect_set(F.struct("p0", "n")).alias("runs"))


def removed_mask(n: int, runs) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    for r in [] if runs is None else runs:
        edge[r["p0"]] += 1
        edge[r["p0"] + r["n"] - 1 + LENGTH] -= 1
    return np.cumsum(edge[:-1]) > 0


def cut_out(raw: bytes, runs) -> tuple[int, int, str, str]:
    """(bytes removed, maximal runs, SHA-256 of what is left, the text left with runs trimmed to whole characters)."""
    mask = removed_mask(len(raw), runs)
    t = np.frombuffer(raw, np.uint8)
    spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
    left = t[~mask].tobytes()
    digest = hashlib.sha256(left).hexdigest()
    if spans:
        lead = (t & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        gone = np.ones(char[-1] + 1, bool)
        gone[char[~mask]] = False  # a character goes only if all its bytes do
        left = t[~gone[char]].tobytes()
    return int(mask.sum()), spans, digest, left.decode("utf-8", "replace")


def _cut_outs(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    out = []
    for x, r in zip(texts, runs, strict=True):
        raw = x.encode()
        out.append((len(raw), *cut_out(raw, r)))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_col: str = "cut") -> DataFrame:
    """docs with a struct column (``cut_col``; a column of that name is replaced): n_bytes, n_removed, n_spans, kept_sha256, kept_text."""
    runs = removable(docs, id_col, text_col).select(F.col("id").alias("run_id"), F.col("digest").alias("run_digest"), "runs")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys(id_col, text_col))
    joined = whole.join(runs.hint("shuffle_hash"), [F.col("id") == F.col("run_id"), F.col("digest") == F.col("run_digest")], "left")
    cut = F.pandas_udf(_cut_outs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    kept = [c for c in docs.columns if c != cut_col]
    return joined.select(*[F.col("row").getField(c).alias(c) for c in kept], cut("text", "runs").alias(cut_col))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with their repeats cut out of the text, and the same columns (n_chars follows if there is one)."""
    name = "cut"
    while name in docs.columns:
        name += "_"
    out = remove_repeats(docs, id_col, text_col, name)
    new = {text_col: F.col(name)["kept_text"]}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(F.col(name)["kept_text"]).cast("long")
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
