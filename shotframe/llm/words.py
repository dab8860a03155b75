"""Words, hashes and shingles; numpy kernels that run inside tasks."""

from __future__ import annotations

import numpy as np

#: ASCII punctuation and control characters become spaces; words are lower-case.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: the public splitmix64 finaliser


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN)


def words_of(text: str | None) -> list[bytes]:
    return plain(text).split()


class WordHashes:
    """64-bit hashes of words: polynomials over their bytes, whose prefix sums are taken for many words at once."""

    def __init__(self, piece: int = 1 << 20):
        self.piece, self.size = piece, 0

    def _reach(self, n: int) -> None:
        if n > self.size:
            self.size = n
            self.up, self.down = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n, np.uint64(b), np.uint64))) for b in (_BASE, pow(_BASE, -1, 2**64)))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts' words, one text after another, and each text's number of words."""
        raw = [plain(x) for x in texts]
        joined = b" ".join(raw) + b" "
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        out, size, at = [], np.zeros(len(raw), np.int64), 0
        while at < len(joined):
            end = len(joined) if len(joined) - at <= self.piece else joined.index(b" ", at + self.piece) + 1
            t = np.frombuffer(joined, np.uint8, end - at, at)
            self._reach(len(t))
            blank = np.concatenate([[True], t == 32])
            edges = np.flatnonzero(blank[1:] != blank[:-1])
            start, stop = edges[::2], edges[1::2]
            sums = np.zeros(len(t) + 1, np.uint64)
            np.cumsum((t.astype(np.uint64) + np.uint64(1)) * self.up[: len(t)], out=sums[1:])
            out.append(mix((sums[stop] - sums[start]) * self.down[start] + ((stop - start).astype(np.uint64) << np.uint64(48))))
            size += np.bincount(np.searchsorted(ends, start + at, side="right"), minlength=len(raw))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64), size


def shingle_hashes(word_hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every k-word shingle, in order; a shorter text is one shingle of all its words, an empty one none."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out ^ word_hashes[i : n - k + 1 + i]) + np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def batch_shingles(texts: list[str | None], hashes: WordHashes, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the distinct shingles of up to 256 texts, by text; of a shingle's hash the low 56 bits."""
    h, size = hashes(texts)
    first = np.cumsum(size) - size
    n = max(0, len(h) - k + 1)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = mix(out ^ h[i : n + i]) + np.uint64(0x9E3779B97F4A7C15)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), size)
    inside = np.flatnonzero(np.arange(n) + k <= np.repeat(first + size, size)[:n])
    short = np.flatnonzero((size > 0) & (size < k))
    low = np.uint64((1 << 56) - 1)
    key = np.concatenate([(mix(out[inside]) & low) | (doc[inside] << np.uint64(56)),
                          *[(shingle_hashes(h[first[i] : first[i] + size[i]], k) & low) | (np.uint64(i) << np.uint64(56)) for i in short]])
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    return (key[new] >> np.uint64(56)).astype(np.int64), key[new] & low, count
