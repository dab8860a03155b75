"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance of the statistics, summed over every labelled training row by Spark (partial
moments per partition, added by index; only d*d numbers per class reach the driver). Covariances are shrunk towards the
pooled one and then towards its diagonal, factored once (Cholesky) and the factors sent to the tasks. The score is the
logistic of the log-density difference, half the difference of the Mahalanobis distances and log-determinants.

Defined results: a null text counts as empty and is scored from its statistics like any other; documents without a label
don't train; of several labels of one document each counts; null labels and null ids don't train, and a null id is
scored; with no training rows of a class the score is the share of label 1 (0.5 without any label); repeated rows are
scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, small_side, written

SHRINK_POOLED, SHRINK_DIAGONAL, FLOOR = 0.2, 0.05, 1e-3
THRESHOLD, FOLDS = 0.3, 5
#: Log-density differences are divided by this before the logistic: densities of dependent statistics are over-sure.
TEMPERATURE = 4.0
STATISTICS = (
    "log_bytes", "log_words", "log_word_length", "log_line_words", "upper", "digit", "symbol", "punctuation", "non_ascii", "short_words",
    "distinct_words", "distinct_pairs", "dup_lines", "top_word", "sentence_ends", "letter_entropy")


def _logit(share: float, n: float) -> float:
    """A share of n things as smoothed log-odds."""
    return math.log((share * n + 0.5) / (n - share * n + 0.5))


def statistics(text: str | None) -> list[float]:
    text = text or ""
    n, words = len(text), text.split()
    m = len(words)
    counts, pairs = Counter(words), len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    freq = np.bincount(letters, minlength=256).astype(float)
    upper, digit = freq[65:91].sum(), freq[48:58].sum()
    symbol = sum(freq[ord(c)] for c in "#*$%&|<>=@~^_\\{}[]+/")
    punct = sum(freq[ord(c)] for c in ".,;:!?'\"()-")
    p = freq[freq > 0] / max(1.0, freq.sum())
    return [
        math.log1p(len(letters)), math.log1p(m), math.log1p(sum(map(len, words)) / max(1, m)), math.log1p(m / max(1, len(lines))),
        _logit(upper / max(1, len(letters)), n), _logit(digit / max(1, len(letters)), n), _logit(symbol / max(1, len(letters)), n), _logit(punct / max(1, len(letters)), n),
        _logit(float((freq[128:].sum()) / max(1, len(letters))), n), _logit(sum(len(w) < 4 for w in words) / max(1, m), m),
        _logit(len(counts) / max(1, m), m), _logit(pairs / max(1, m - 1), max(1, m - 1)) if m > 1 else 0.0, _logit((len(lines) - len(set(lines))) / max(1, len(lines)), len(lines)),
        _logit(max(counts.values(), default=0) / max(1, m), m), _logit(sum(w[-1] in ".!?" for w in words) / max(1, m), m), float(-(p * np.log2(p)).sum())]


def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(x) for x in texts])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.pandas_udf(_statistics, "array<double>")(F.col(f"`{text_col}`").cast("string")).alias("x"))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Of (x, label): count, sum and sum of products for each label."""
    d = len(STATISTICS)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for label, rows in part.groupby("label"):
                x = np.column_stack([np.ones(len(rows)), np.stack(rows["x"].to_numpy())])
                sums[int(label)] = sums.get(int(label), 0) + (x.T @ x)
        for label, s in sums.items():
            yield pd.DataFrame({"label": label, "k": np.arange(s.size), "v": s.ravel()})

    rows = labelled.select("x", "label").mapInPandas(partial, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v")).collect()
    out: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    for label in {r["label"] for r in rows}:
        s = np.zeros((d + 1) * (d + 1))
        for r in rows:
            if r["label"] == label:
                s[r["k"]] = r["v"]
        s = s.reshape(d + 1, d + 1)
        out[label] = (s[0, 0], s[0, 1:], s[1:, 1:])
    return out


def fit(found: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> dict:
    """Means and inverse Cholesky factors of the shrunk covariances; only a prior if a class is missing."""
    n = sum(x[0] for x in found.values())
    prior = (found[1][0] + 0.5) / (n + 1) if 1 in found else 0.5 / (n + 1) if n else 0.5
    if not (0 in found and 1 in found):
        return {"prior": prior}
    d = len(STATISTICS)
    means = {c: found[c][1] / found[c][0] for c in (0, 1)}
    cov = {c: found[c][2] / found[c][0] - np.outer(means[c], means[c]) for c in (0, 1)}
    pooled = sum(found[c][0] * cov[c] for c in (0, 1)) / n
    model: dict = {"prior": prior}
    for c in (0, 1):
        keep = found[c][0] / (found[c][0] + d)  # a class of few rows leans on the pooled covariance
        s = (1 - SHRINK_POOLED) * keep * cov[c] + (1 - (1 - SHRINK_POOLED) * keep) * pooled
        s = (1 - SHRINK_DIAGONAL) * s + SHRINK_DIAGONAL * np.diag(np.diag(pooled)) + FLOOR * np.eye(d)
        factor = np.linalg.cholesky(s)
        model[c] = (means[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum())
    return model


def log_density_difference(x: np.ndarray, model: dict) -> np.ndarray:
    """log p(x | 1) - log p(x | 0) for the rows of x."""
    side = {c: -0.5 * (((x - model[c][0]) @ model[c][1].T) ** 2).sum(axis=1) - 0.5 * model[c][2] for c in (0, 1)}
    return side[1] - side[0]


def score_rows(stats: DataFrame, model: dict) -> DataFrame:
    @F.pandas_udf("double")
    def scored(xs: pd.Series) -> pd.Series:
        if 1 not in model or not len(xs):
            return pd.Series([model["prior"]] * len(xs), dtype=float)
        z = log_density_difference(np.stack(xs.to_numpy()), model) / TEMPERATURE + math.log(model["prior"] / (1 - model["prior"]))
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return stats.withColumn("score", scored("x"))


def classify(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, score) for every row; ``training`` is a predicate on the column doc_id that says which rows may train."""
    small_batches(docs.sparkSession)
    stats = written(document_statistics(docs, id_col, text_col), "qda-statistics")
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    seen = stats.where(training(F.col("doc_id"))).join(small_side(known), "doc_id")
    return score_rows(stats, fit(moments(seen))).select("doc_id", "score")
