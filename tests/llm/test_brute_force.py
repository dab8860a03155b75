"""Verdicts and scores that SQL can't express, held against plain versions; the pipeline on odd tables."""

import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

pytest.importorskip("shotframe.llm")
import corpus_pipeline  # noqa: E402
from shotframe.llm import classifier, quality  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_quality_verdicts(spark):
    """The verdict on every text of sf0.01, from the sizes that the compressor gives."""
    size = lambda raw: len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(raw))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", quality.compression_bands(F.col("text")).alias("v")).collect()
    seen = set()
    for d in docs:
        raw, v = (d.text or "").encode(), d.v
        band = [(lo, hi) for least, lo, hi in quality.BANDS if len(raw) >= least][-1:] or [(0.0, math.inf)]
        ratio = size(raw) / len(raw) if raw else 0.0
        cuts = [min(i, len(raw) - quality.CHUNK) for i in range(0, len(raw), quality.CHUNK)] if len(raw) >= quality.CHUNK else []
        bad = sum(not quality.CHUNK_BAND[0] <= size(raw[i : i + quality.CHUNK]) / quality.CHUNK <= quality.CHUNK_BAND[1] for i in cuts)
        want = "base" if v.base_failed else "repetitive" if ratio < band[0][0] else "incompressible" if ratio > band[0][1] else "chunks" if bad > quality.CHUNK_SHARE * max(1, len(cuts)) else None
        assert (v.reason, v.kept, v.n_chunks, v.bad_chunks) == (want, want is None, len(cuts), bad) and abs(v.ratio - ratio) < 1e-12, d.doc_id
        seen.add(want)
    assert {None, "base"} <= seen


def test_classifier_against_densities(spark):
    """Scores of sf0.01 from numpy's own means, covariances, inverses and determinants."""
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    got = {r.doc_id: r.score for r in classifier.classify(docs, labels, lambda c: F.crc32(c.cast("string").cast("binary")) % 5 != 0).collect()}
    import zlib

    texts = {r.doc_id: r.text for r in docs.collect()}
    x = {i: np.array(classifier.statistics(t)) for i, t in texts.items()}
    rows = [(i, q) for i, q, *_ in labels.collect() if zlib.crc32(str(i).encode()) % 5]
    by = {c: np.array([x[i] for i, q in rows if q == c]) for c in (0, 1)}
    mean, cov = {c: v.mean(axis=0) for c, v in by.items()}, {c: np.cov(v.T, bias=True) for c, v in by.items()}
    pooled = sum(len(by[c]) * cov[c] for c in (0, 1)) / len(rows)
    d = len(classifier.STATISTICS)
    shrunk = {}
    for c in (0, 1):
        own = (1 - classifier.SHRINK_POOLED) * len(by[c]) / (len(by[c]) + d)
        s = own * cov[c] + (1 - own) * pooled
        shrunk[c] = (1 - classifier.SHRINK_DIAGONAL) * s + classifier.SHRINK_DIAGONAL * np.diag(np.diag(pooled)) + classifier.FLOOR * np.eye(d)
    prior = (len(by[1]) + 0.5) / (len(rows) + 1)
    for i, v in x.items():
        log = {c: -0.5 * (v - mean[c]) @ np.linalg.inv(shrunk[c]) @ (v - mean[c]) - 0.5 * np.linalg.slogdet(shrunk[c])[1] for c in (0, 1)}
        z = (log[1] - log[0]) / classifier.TEMPERATURE + math.log(prior / (1 - prior))
        assert abs(got[i] - 1 / (1 + math.exp(-np.clip(z, -700, 700)))) < 1e-6, i


def test_classifier_ties_and_clashing_columns(spark):
    r = random.Random(3)
    words = lambda n: " ".join(r.choice(["lom", "nal", "pir", "sut"]) + str(r.randrange(50)) for _ in range(n))
    rows = [(i, words(50) if i % 2 else "AAA ### " * 20, i % 2) for i in range(80)]
    docs = spark.createDataFrame([(i, t, 1, 2.0, "x") for i, t, _ in rows] * 2, "doc_id long, text string, label int, x double, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = [(r.doc_id, r.score) for r in classifier.classify(docs, labels, lambda c: F.lit(True)).collect()]
    assert len(got) == 160 and len(set(got)) == 80


def test_pipeline_on_odd_tables(spark, tmp_path):
    r = random.Random(2)
    words = lambda n: " ".join("".join(r.choice("aeioulmnprst") for _ in range(r.randrange(2, 9))) for _ in range(n))
    good = [(i, words(120) + ".\n" + words(80) + ".", "en", "s", 1) for i in range(6)]
    long = (50, "\n".join(words(200) for _ in range(150)), "en", "s", 1)
    rows = [*good, (60, None, None, None, None), (61, "", "en", "s", 0), (None, good[0][1], "en", "s", 1), (0, good[0][1], "en", "s", 1), long]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("a", rows), ("b", [])):
        df = spark.createDataFrame([(*x, 1, 2, "c") for x in data], schema + ", __verdict int, class_id int, digest string")
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, words(40)), (2, None)] if data else [], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {"doc_id", "text", "lang", "source", "n_chars", "__verdict", "class_id", "digest", "n_tokens", "ids"} <= set(out.columns)
        kept = sorted((x.doc_id is None, x.doc_id) for x in out.select("doc_id").collect())
        assert len(kept) == (7 if data else 0)
