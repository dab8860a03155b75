"""Importance resampling against a plain version, on odd rows, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("shotframe.llm")
from shotframe.llm import importance  # noqa: E402

SCHEMA = "doc_id long, text string, row int, word string, bucket int, gain int, score int, rank int, pos int, copies int"


def plain(docs, target, orders, buckets, percent, least):
    def grams(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in orders for i in range(len(words) - n + 1)]

    found = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for _, _, g in found for b in g), Counter(b for x in target for b in grams(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in {*s, *t}}
    out = []
    for i, n, g in found:
        h = int(hashlib.sha256(f"{importance.SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        out.append((i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[1], x[3]))
    drawn = able[: len(able) * percent // 100]
    ranked = [(*x, k + 1) for k, x in enumerate(drawn)]
    rest = Counter(out)
    rest.subtract(drawn)
    return sorted([*ranked, *[(*x, None) for x in rest.elements()]], key=str)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(i, " ".join(f"{w} Wörd{i * k % 7}É" for k, w in enumerate(["alpha", "Beta", "x-y", "10"] * (i % 9)))) for i in range(60)]
    texts += [(None, None), (None, "alpha " * 30), (70, ""), (71, "... !!"), (72, "a"), (73, "alpha beta " * 8000), *[(74, "alpha beta gamma " * 9)] * 40]
    return spark.createDataFrame([(i, t, 1, "w", 3, 4, 5, 6, 7, 8) for i, t in texts], SCHEMA), texts


@pytest.mark.parametrize("orders", [(1,), (1, 2), (2, 3)])
def test_against_a_plain_version(spark, docs, orders):
    df, texts = docs
    target = [None, "", "alpha Beta beta 10 10 zzz", "gamma gamma"]
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), orders, 97, percent=30)
    assert sorted(map(tuple, got.collect()), key=str) == plain(texts, target, orders, 97, 30, importance.MIN_WORDS)


def test_copies_are_ranked_in_blocks(docs, spark, monkeypatch):
    df, texts = docs
    monkeypatch.setattr(importance, "COPIES", 7)
    got = importance.resample(df, spark.createDataFrame([("alpha",)], "text string"), buckets=11, percent=100)
    ranks = sorted(r.rank for r in got.collect() if r.rank is not None)
    assert ranks == list(range(1, 1 + sum(x[1] >= importance.MIN_WORDS for x in plain(texts, ["alpha"], (1,), 11, 100, 20))))


def test_empty_tables(spark, docs):
    none = docs[0].limit(0)
    assert importance.resample(none, none).count() == 0
    assert importance.resample(docs[0], none, percent=100).count() == len(docs[1])
