"""Operator 10: quality classifier by regularised quadratic discriminant analysis.

Features are transformed statistics of the whole text (``features``).  Each
class has a Gaussian density; its covariance is shrunk towards a scaled
identity, ``(1 - shrinkage) * S + shrinkage * trace(S) / d * I``, on features
that are first scaled by their spread over all training rows.  Fitting needs
only counts, sums and sums of products per class, which tasks add up before
they are shuffled; so every labelled training row counts, there is no sample,
and the driver gets one small matrix per class.  The model keeps each class's
Cholesky factor; a score is the logistic of the log prior odds plus the
difference of the log densities, ``-0.5 * (Mahalanobis distance + log
determinant)``, divided by ``temperature``.

Training rows are those with ``crc32(doc_id as text) mod 5`` not 0 and a label.
The label, language, source and id are never features.

Cases: a null text is an empty text; empty texts get a score from their zero
statistics; rows with a null doc_id are scored, are not held out and have no
label; several labels of one doc_id count as one, their mean rounded up; a null
label is none; if a class has no training rows, the score is the share of label
1 among training rows, and 0.5 without any; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.workspace import written

FEATURES = (
    "log_words", "word_length", "symbols", "pipes", "exclamations", "capitals", "repeated_lines",
    "repeated_windows", "stutters", "commonest", "variety", "sentences", "commas", "digits",
)
THRESHOLD = 0.3
SHRINKAGE = 0.01
#: Texts of one class differ in ways that a Gaussian knows nothing of; dividing keeps scores off the extremes.
TEMPERATURE = 4.0

_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_NOT_COUNTED = bytes(range(0x80, 0xC0)) + _SPACE
_SYMBOLS = b"#*$%&<>"
_KEEP_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_KEEP_DIGITS = bytes(b for b in range(256) if b not in b"0123456789")
_KEEP_ENDS = bytes(b for b in range(256) if b not in b".!?")


def features(text: bytes) -> tuple[float, ...]:
    """The transformed statistics of one UTF-8 text, in the order of ``FEATURES``."""
    words = text.split()
    n = len(words) or 1
    chars = len(text.translate(None, _NOT_COUNTED))
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    windows = max(1, len(words) - 2)
    distinct_windows = len(set(zip(words, words[1:], words[2:], strict=False))) or 1
    lines = [line for line in text.split(b"\n") if line.strip()]
    n_lines = len(lines) or 1

    def rate(count: float) -> float:
        return math.log1p(10 * count / n)

    return (
        math.log1p(len(words)),
        math.log1p(chars / n),
        rate(len(text.translate(None, _KEEP_SYMBOLS))),
        rate(text.count(b"|")),
        rate(text.count(b"!")),
        rate(sum(word.isupper() and len(word) > 1 for word in words)),
        (n_lines - len(set(lines))) / n_lines,
        1 - min(windows, distinct_windows) / windows,
        rate(sum(map(bytes.__eq__, map(bytes.lower, words), map(bytes.lower, words[1:])))),
        math.log(max(counts.values(), default=1) / n),
        math.log(max(1, len(counts)) / n) + 0.1 * math.log(n),
        rate(len(text.translate(None, _KEEP_ENDS))),
        rate(text.count(b",")),
        rate(len(text.translate(None, _KEEP_DIGITS))),
    )


def document_features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, its features, for every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for batch in batches:
            x = [features(text.as_py() or b"") for text in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, kind)], ["doc_id", "x"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(each, "doc_id long, x array<double>")


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    cholesky: np.ndarray
    log_determinant: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        whitened = (x - self.mean).T
        for i, row in enumerate(self.cholesky):  # forward substitution: the factor is triangular
            whitened[i] = (whitened[i] - row[:i] @ whitened[:i]) / row[i]
        return -0.5 * ((whitened**2).sum(axis=0) + self.log_determinant)


@dataclass(frozen=True)
class Model:
    scale: np.ndarray
    classes: tuple[Gaussian, ...]  #: of label 0 and label 1; empty if one has no rows
    log_odds: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.log_odds)
        if self.classes:
            z = x / self.scale
            logit = (logit + self.classes[1].log_density(z) - self.classes[0].log_density(z)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and sums of products of each class, for the rows of one task."""
    d = len(FEATURES)
    sums = np.zeros((2, d + 1, d + 1))
    for batch in batches:
        x = np.asarray(batch.column(0).flatten()).reshape(-1, d)
        x = np.hstack([np.ones((len(x), 1)), x])
        label = np.asarray(batch.column(1))
        for k in (0, 1):
            sums[k] += x[label == k].T @ x[label == k]
    entry = np.arange((d + 1) ** 2)
    for k in (0, 1):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), k, np.int32)), pa.array(entry.astype(np.int32)), pa.array(sums[k].ravel())], ["label", "entry", "total"])


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE, temperature: float = TEMPERATURE) -> Model:
    """``labelled``: columns ``x`` and ``label`` (0 or 1)."""
    d = len(FEATURES)
    rows = labelled.select("x", F.col("label").cast("int")).mapInArrow(_moments, "label int, entry int, total double")
    sums = np.zeros((2, (d + 1) ** 2))
    for row in rows.groupBy("label", "entry").agg(F.sum("total").alias("total")).collect():
        sums[row["label"], row["entry"]] = row["total"]
    sums = sums.reshape(2, d + 1, d + 1)
    n = sums[:, 0, 0]
    if not n.all():
        odds = 0.0 if not n.any() else (500.0 if n[1] else -500.0)
        return Model(np.ones(d), (), odds, temperature)
    everything = sums.sum(axis=0) / n.sum()
    spread = np.sqrt(np.maximum(np.diag(everything)[1:] - everything[0, 1:] ** 2, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)
    classes = []
    for k in (0, 1):
        mean = sums[k, 0, 1:] / n[k] / scale
        covariance = sums[k, 1:, 1:] / n[k] / np.outer(scale, scale) - np.outer(mean, mean)
        covariance = (1 - shrinkage) * covariance + shrinkage * max(np.trace(covariance) / d, 1e-3) * np.eye(d)
        cholesky = np.linalg.cholesky(covariance)
        classes.append(Gaussian(mean, cholesky, 2 * float(np.log(np.diag(cholesky)).sum())))
    return Model(scale, tuple(classes), float(np.log(n[1] / n[0])), temperature)


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.asarray(batch.column(2).flatten()).reshape(-1, len(FEATURES))
        score = model.score(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def classified(docs: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, temperature: float = TEMPERATURE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``. ``labels``: ``doc_id`` and ``quality``."""
    x = written(document_features(docs), "classifier-features")
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    model = fit(x.filter(fold() != 0).join(known, "doc_id"), shrinkage, temperature)
    held_out = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return x.select("doc_id", held_out, "x").mapInArrow(partial(_scored, model=model), "doc_id long, held_out boolean, score double, predicted int")
