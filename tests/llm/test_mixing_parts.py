"""Texts are scored by parts of at most BATCH symbols, whatever they are scored with, and each as if it were alone."""

import random

import numpy as np

from shotframe.llm import mixing

from .test_operators import small_model


def test_parts_are_small_and_texts_independent(monkeypatch):
    tree, coded, _, model = small_model([b"ab ba c ab ba c"] * 200)
    r = random.Random(3)
    texts = [coded([r.choice([b"ab", b"ba", b"c", b"zz"]) for _ in range(r.choice([0, 1, 40, 500, 1300]))]) for _ in range(90)]
    texts += [np.empty(0, np.int32), texts[0], np.concatenate(texts[:20])]
    alone = np.array([[x[0] for x in model.log10([t])] for t in texts]).T
    sizes, bits_of = [], tree.bits_of
    monkeypatch.setattr(tree, "bits_of", lambda symbols: sizes.append(len(symbols)) or bits_of(symbols), raising=False)
    together = np.array(model.log10(texts))
    assert sum(sizes) == sum(map(len, texts)) and max(sizes) <= mixing.BATCH
    assert np.allclose(together, alone, rtol=1e-6, atol=1e-9)


def test_texts_whose_bits_are_certain():
    """Where one cell holds all tokens, a known word has no open bit but that it is known."""
    tree = mixing.Tree(2, {1: 9}, 1, {})
    learner = mixing.Learner(tree, 8)
    words = np.full(40, 1, np.int32)
    learner.learn(words, np.array([0, 20]))
    tree.length[1], tree.alone[1] = 0, 0.0  # and not even that
    model = mixing.Model(tree, [mixing.packed_odds(t.reshape(-1, 2)) for t in learner.tables], learner.sums())
    odd = np.array([tree.unknown, tree.byte + 97, tree.byte + 32], np.int32)
    texts = [words, odd, words[:1], np.concatenate([words, odd]), words]
    got = model.log10(texts)[0]
    assert got[0] == got[2] == got[4] == 0 and got[1] < -1 and got[3] < -1
