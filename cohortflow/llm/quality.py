"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each class is a normal density over transformed statistics of the text. Its covariance is shrunk towards the pooled one
and then towards a multiple of the identity; the score compares the two log densities through Mahalanobis distances from
Cholesky factors that are computed once and shipped with the scoring function.

Defined cases: a null text is the empty text and has all-zero counts; rows without a label or id are scored, never learnt
from; with fewer than two labelled rows in a class the prior is the score of every row (0.5 without any label); repeated
labels count as often as they appear; extra columns are kept by `keep_good` and ignored elsewhere.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import fresh

FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_next", "log_symbols", "log_pipes",
    "log_bangs", "log_upper", "log_digits", "log_lines", "line_repeats", "log_other",
)
THRESHOLD = 0.7
TO_POOLED = 0.1
TO_IDENTITY = 0.02
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*@^~_=+<>\\"]] = True


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text, in the order of FEATURES; shares get log(share + 0.001)."""
    text = text or ""
    words = text.split()
    n = len(words)
    if n == 0:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    size = counts.sum()
    distinct = len(set(words))
    again = sum(map(operator.eq, words, words[1:]))
    lines = text.split("\n")
    log_share = lambda k: float(np.log(k / size + 1e-3))
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    spaces = counts[9:14].sum() + counts[32]
    return [
        float(np.log1p(n)),
        float(np.log(len(text) / n)),
        float(np.log(distinct / n**0.85)),  # distinct words grow slower than the text
        float(np.log(again / n + 1e-2)),
        log_share(counts[_SYMBOLS].sum()),
        log_share(counts[ord("|")]),
        log_share(counts[ord("!")]),
        log_share(counts[65:91].sum()),
        log_share(counts[48:58].sum()),
        float(np.log(len(lines) / n + 1e-2)),
        float(np.log(1.0 - len(set(lines)) / len(lines) + 1e-2)),
        log_share(size - letters - spaces),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row's whole text."""
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return docs.select("doc_id", stats("text").alias("x"))


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and log determinants over standardised features."""

    prior: float
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray | None = None
    inverse: np.ndarray | None = None
    log_det: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        z = (x - self.centre) / self.scale
        log_density = [
            -0.5 * (np.square((z - self.means[k]) @ self.inverse[k].T).sum(axis=1) + self.log_det[k]) for k in (0, 1)
        ]
        odds = log_density[1] - log_density[0] + np.log(self.prior / (1 - self.prior))
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -700, 700)))


def fit(labelled: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """From rows (x, y) with y in 0, 1. Spark sums the moments of all rows; the driver gets two rows of them."""
    d = len(FEATURES)
    item = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    moments = labelled.filter(F.col("y").isin(0, 1)).groupBy("y").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(c) for c in item]).alias("s"),
        F.array(*[F.sum(item[i] * item[j]) for i, j in pairs]).alias("q"),
    ).collect()
    by = {r["y"]: r for r in moments}
    n = np.array([by[k]["n"] if k in by else 0 for k in (0, 1)], float)
    prior = float((n[1] + 1) / (n.sum() + 2))
    if n.min() < 2:
        return Discriminant(prior, np.zeros(d), np.ones(d))
    sums = np.array([by[k]["s"] for k in (0, 1)])
    second = np.zeros((2, d, d))
    for k in (0, 1):
        for (i, j), v in zip(pairs, by[k]["q"]):
            second[k, i, j] = second[k, j, i] = v
    centre = sums.sum(0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(second.sum(0)) / n.sum() - centre**2, 1e-12))
    means = (sums / n[:, None] - centre) / scale
    spread = np.array([(second[k] / n[k] - np.outer(sums[k] / n[k], sums[k] / n[k])) / np.outer(scale, scale) for k in (0, 1)])
    pooled = np.tensordot(n / n.sum(), spread, 1)
    shrunk = (1 - to_pooled) * spread + to_pooled * pooled
    shrunk = np.array([(1 - to_identity) * s + to_identity * max(np.trace(s) / d, 1e-6) * np.eye(d) for s in shrunk])
    factors = np.linalg.cholesky(shrunk)
    return Discriminant(
        prior, centre, scale, means, np.linalg.inv(factors), 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
    )


def training_rows(rows: DataFrame, labels: DataFrame, condition=None) -> DataFrame:
    """rows (doc_id, x) with y = labels.quality, for ids that meet the condition."""
    y = labels.select("doc_id", F.col("quality").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    joined = rows.join(y, "doc_id")
    return joined if condition is None else joined.filter(condition)


def score_vectors(model: Discriminant):
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.tolist(), dtype=float).reshape(len(x), len(FEATURES))))

    return score


def score_texts(model: Discriminant):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))))

    return score


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns kept."""
    (name,) = fresh(docs, "score")
    return docs.withColumn(name, score_texts(model)("text")).filter(F.col(name) >= threshold).drop(name)
