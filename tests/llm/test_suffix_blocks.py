"""The suffix kernels without Spark: texts cut into overlapping pieces of any size give the same bytes as brute force."""

import random

import numpy as np
import pytest

suffixes = pytest.importorskip("shotframe.llm.suffixes")


def by_kernels(docs):
    rows = suffixes._block_rows(docs, suffixes._Hasher())
    raw = {(i, d): t for i, d, t in docs}
    runs = [(r.id, r.digest, r.p0, r.n) for r in rows[rows.kind == 0].itertuples()]
    first = rows[rows.kind == 1]
    several = first.groupby("h").d.nunique()
    mixed = first[first.h.isin(several[several > 1].index)].copy()
    if len(mixed):
        mixed["raw"] = [raw[(r.id, r.digest)][r.p0 : r.p0 + r.n - 1 + suffixes.LENGTH] for r in mixed.itertuples()]
        runs += [(r.id, r.digest, r.p0, r.n) for r in suffixes._sorted_bucket(mixed[["h", "id", "digest", "p0", "n", "lead", "raw"]]).itertuples()]
    return {i: suffixes.removed_mask(len(t), [{"p0": p, "n": n} for a, b, p, n in runs if (a, b) == (i, d)]) for i, d, t in docs}


def brute(docs):
    seen, out = set(), {}
    for i, _, t in sorted(docs):
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                mask[p : p + 100] = True
            seen.add(t[p : p + 100])
        out[i] = mask
    return out


@pytest.mark.parametrize("piece", [100, 333, 1 << 19])
def test_pieces_of_any_size(monkeypatch, piece):
    monkeypatch.setattr(suffixes, "PIECE", piece)
    for seed in range(8):
        r = random.Random(seed)
        passages = [bytes(r.choice(b"abcdef ") for _ in range(r.randrange(120, 600))) for _ in range(5)]

        def part(r=r, passages=passages):
            return r.choice([r.choice(passages), bytes(r.choice(b"abcdefgh") for _ in range(r.randrange(10, 300))), b"ab" * r.randrange(1, 120), b"x" * r.randrange(1, 150)])

        docs = [(i, i * 7, b"".join(part() for _ in range(r.randrange(1, 9)))) for i in range(8)]
        want, got = brute(docs), by_kernels(docs)
        assert all((got[i] == want[i]).all() for i in want)
