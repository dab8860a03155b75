"""The piece kernels take many pairs and ids at a time."""

import numpy as np

from shotframe.llm import pieces


def test_pairs_are_inserted_at_once(monkeypatch):
    calls, mix = [], pieces.mix
    monkeypatch.setattr(pieces, "mix", lambda x: calls.append(len(x)) or mix(x))
    table = pieces.PairTable(bits=12)
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 40, 2000))
    for some in np.array_split(np.random.default_rng(6).permutation(keys), 4):  # nearly half full: many meet at a slot
        table.add(some, (some % 3 == 0).tolist())
    assert len(calls) == 4 and table.n == len(keys) and np.count_nonzero(table.keys != -1) == len(keys)
    at = table.places(keys)
    assert (table.keys[at] == keys).all() and (table.answers[at] == (keys % 3 == 0)).all()
    other = keys + (1 << 41)
    assert (table.keys[table.places(other)] == -1).all()


def test_texts_are_decoded_at_once(monkeypatch):
    p = pieces.Pieces(pieces.model_bytes())
    texts = ["", "plain words", " led", "漢😀 ğ퟿", "a\n\nb" * 9, "\x00 ▁", "x" * 500]
    ids = p.encode(texts)
    back = [x.replace("▁", " ") for x in texts]
    for block in (1, 3, pieces.GATHERED):
        monkeypatch.setattr(pieces, "GATHERED", block)
        assert p.decode_all(ids) == back == [p.decode(i) for i in ids]
    assert p.decode_all([]) == [] and p.decode([]) == "" and p.decode([-1, p.size, 1 << 30]) == ""
