"""Texts and tokens stay Arrow arrays from the scan to the scores; their words are those of a plain split."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotframe.llm import mixing

SPACES = [" ", "\n", "\t", "\x0b", "\x0c", "\r"]


def plain(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()


def odd_texts():
    r = random.Random(5)
    letters = [chr(c) for c in range(0x250)] + [" ", " ", "　", "﻿", "\U0001f600"] + SPACES * 30
    return [None, "", " ", "\n \t", "a", " A ", "İK K"] + ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(2000)]


def test_no_step_over_texts_takes_pandas(spark, monkeypatch):
    plans, written = {}, mixing.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().toString()
        return written(df, name)

    monkeypatch.setattr(mixing, "written", noted)
    docs = spark.createDataFrame([(i, f"word{i} some words") for i in range(30)], "doc_id long, text string")
    plans["scores"] = mixing.score_documents(docs, F.col("doc_id") > 9)._jdf.queryExecution().toString()
    for step in ("token-counts", "coded", "scores"):
        assert "InArrow" in plans[step] and "InPandas" not in plans[step]


def test_tokens_are_those_of_a_plain_split():
    texts = odd_texts()
    each = [plain(t) + [mixing.END_TOKEN] for t in texts]
    for a, z in ((0, len(texts)), (3, 500)):
        tokens, per = mixing.tokens_of(pa.array(texts)[a:z])
        assert tokens.to_pylist() == [w for x in each[a:z] for w in x] and per.tolist() == [len(x) for x in each[a:z]]


@pytest.mark.parametrize("split", [1 << 25, 64])
def test_counts_and_codes_do_not_follow_what_is_split_at_once(monkeypatch, split):
    monkeypatch.setattr(mixing, "SPLIT", split)
    texts = odd_texts()[:300]
    each = [plain(t) for t in texts]
    got, letters = {}, np.zeros(256, np.int64)
    for batch in mixing.counted(iter(pa.record_batch({"text": pa.array(texts[i : i + 7])}) for i in range(0, 300, 7))):
        for row in batch.to_pylist():
            if row["kind"]:
                letters[int.from_bytes(row["token"], "big")] += row["n"]
            else:
                got[row["token"]] = got.get(row["token"], 0) + row["n"]
    words = [w for x in each for w in [*x, mixing.END_TOKEN]]
    assert got == {w: words.count(w) for w in set(words)}
    assert (letters == np.bincount(np.frombuffer(b"".join(b" ".join(x) + b" " for x in each), np.uint8), minlength=256)).all()

    tokens = sorted(set(words))[::2]  # the others are unknown
    cell = {w: i % 8 for i, w in enumerate(tokens)}
    tree = mixing.Tree(3, dict.fromkeys(range(8), 5), 1, {})
    rows = pa.table({"doc_id": [str(i) for i in range(300)], "text": pa.array(texts, pa.string()), "train": [i % 3 > 0 for i in range(300)], "place": list(range(300)), "chunk": [4] * 300})
    known = pa.table({"chunk": [4] * len(tokens), "token": pa.array(tokens, pa.binary()), "n": [got[w] for w in tokens], "cell": pa.array(list(cell.values()), pa.int32())})
    out = mixing._coder(tree, 6, np.full(8, 5.0), len(words), len(got))(rows, known).to_pylist()
    assert sum(r["pid"] == 4 for r in out if r["k"] > -2) == 1 + mixing.CONTEXTS * mixing.PIECES
    for r, text, found, i in zip(out, texts, each, range(300), strict=False):
        expected = []
        for w in [*found, mixing.END_TOKEN]:
            expected += [cell[w]] if w in cell else [tree.unknown, *(tree.byte + b for b in w + b" ")]
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_bytes"]) == (str(i), i % 3 == 0, len(found) + 1, len(text or ""))
        assert r["symbols"] == expected and r["n_known"] == sum(w in cell for w in [*found, mixing.END_TOKEN])
