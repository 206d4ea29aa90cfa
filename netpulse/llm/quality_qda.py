"""Quality by regularised quadratic discriminant analysis over document statistics.

Each document becomes a handful of transformed statistics of its whole text. Every
class has a Gaussian with a shrunken covariance: part of the pooled one and part of
a scaled identity. Means and second moments are aggregates over all labelled rows,
so nothing is sampled and only a few numbers reach the driver. The score compares
the two log-densities, by Mahalanobis distances through cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpulse.llm.language_id import held_out
from netpulse.sinks.tables import written

FEATURES = (
    "log_chars", "letters", "upper", "digits", "marks", "ends", "spaces", "other",
    "word_length", "distinct", "line_length", "repeated_lines",
)
TO_POOLED = 0.1
TO_IDENTITY = 0.05

# Classes of UTF-8 bytes: lower, upper, digit, sentence marks, white space, other ASCII, the rest (letters mostly).
_CLASS = np.full(256, 6, np.uint8)
_CLASS[:128] = 5
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 0
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_CLASS[[ord(c) for c in "0123456789"]] = 2
_CLASS[[ord(c) for c in ".,;:?'\"-"]] = 3
_CLASS[[ord(c) for c in " \t\n\r\f\v"]] = 4


def _logit(part: float, whole: float) -> float:
    share = (part + 0.5) / (whole + 1)
    return float(np.log(share / (1 - share)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text (null: empty); every one is finite."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    lower, upper, digits, ends, spaces, marks, other = np.bincount(_CLASS[data], minlength=7).tolist()
    words, lines = text.split(), [line for line in text.split("\n") if line]
    return [
        float(np.log1p(n)),
        _logit(lower + upper + other, n),
        _logit(upper, lower + upper),
        _logit(digits, n),
        _logit(marks, n),
        _logit(ends, n),
        _logit(spaces, n),
        _logit(other, n),
        float(np.log1p(n / (len(words) + 1))),
        _logit(len(set(words)), len(words)),
        float(np.log1p(n / (len(lines) + 1))),
        _logit(len(lines) - len(set(lines)), len(lines)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the statistics of every document."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.DataFrame([statistics(t) for t in batch["text"]], columns=list(FEATURES), dtype=float)
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy() if len(batch) else [])
            yield frame

    kind = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select("doc_id", "text").mapInPandas(task, kind).withColumn("held_out", held_out(F.col("doc_id")))


@dataclass
class QualityModel:
    """Per class (0, 1): mean, Cholesky factor of the inverse covariance, log of prior over root of determinant."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Score in 0..1 of each row; the log-odds are scaled by the number of statistics, so that ranks stay apart."""
        if not len(self.means):
            return np.full(len(x), 0.5)
        densities = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            away = (x - mean) @ factor
            densities.append(offset - 0.5 * (away**2).sum(axis=1))
        odds = (densities[1] - densities[0]) / x.shape[1]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(counts: list[float], sums: list[np.ndarray], squares: list[np.ndarray]) -> QualityModel:
    """The model from count, sum and sum of outer products of each class; a missing class gives none."""
    if min(counts) < 2:
        return QualityModel(np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0))
    means = [s / n for s, n in zip(sums, counts, strict=True)]
    own = [q / n - np.outer(m, m) for q, n, m in zip(squares, counts, means, strict=True)]
    pooled = sum(c * n for c, n in zip(own, counts, strict=True)) / sum(counts)
    # Statistics have unlike scales: the identity is that of the pooled variances.
    ridge = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, offsets = [], []
    for cov, n in zip(own, counts, strict=True):
        shrunk = (1 - TO_POOLED - TO_IDENTITY) * cov + TO_POOLED * pooled + TO_IDENTITY * ridge
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower).T)
        offsets.append(np.log(n / sum(counts)) - np.log(np.diag(lower)).sum())
    return QualityModel(np.array(means), np.array(factors), np.array(offsets))


def train(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on every labelled document that is not held out; labels other than 0 and 1 teach nothing.

    Several labels of one document all count.
    """
    marks = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality")
    rows = stats.where("NOT held_out").join(marks, "doc_id")
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    firsts = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    seconds = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i, j in pairs]
    found = {r["quality"]: r for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), *firsts, *seconds).collect()}
    counts, sums, squares = [], [], []
    for quality in (0, 1):
        row = found.get(quality)
        counts.append(float(row["n"]) if row else 0.0)
        sums.append(np.array([row[f"s{i}"] if row else 0.0 for i in range(len(FEATURES))]))
        square = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in pairs:
            square[i, j] = square[j, i] = row[f"q{i}_{j}"] if row else 0.0
        squares.append(square)
    return fit(counts, sums, squares)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts are scored as empty. Repeated rows and null ids are
    documents of their own; null ids teach nothing. With fewer than two labelled
    documents of either class every score is 0.5. An empty table gives no row.
    """
    stats = written(document_statistics(docs), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(train(stats, labels))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = shared.value.scores(batch[list(FEATURES)].to_numpy(float))
            yield batch[["doc_id", "held_out"]].assign(score=scores, predicted=(scores >= 0.5).astype("int32"))

    return stats.mapInPandas(task, "doc_id long, held_out boolean, score double, predicted int")
