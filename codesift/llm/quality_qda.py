"""Quality classifier: quadratic discriminant with shrunk class covariances over statistics of whole texts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm import rows
from codesift.llm.quality_rules import STOP_WORDS

_STOP = frozenset(w.encode() for w in STOP_WORDS)
#: Classes of bytes; a byte may be in several.
_CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "blank": (*range(9, 14), 32), "line": (10,), "stop": b".!?",
    "mark": b",;:'\"()-!?", "symbol": b"#*$%&|<>~^{}[]@\\/+=_", "other": range(128, 256),
}
_MEMBER = np.array([[b in bytes(c) for c in _CLASSES.values()] for b in range(256)], np.float64)
FEATURES = (
    "words", *_CLASSES, "word_bytes", "distinct_words", "distinct_triples", "distinct_lines", "stop_words", "entropy")


def _share(part: float, whole: float) -> float:
    """Log odds of a share, held away from 0 and 1 by half a unit."""
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def features(text: bytes) -> list[float]:
    """Statistics of a whole text, each on a scale where shares and lengths are roughly normal. Empty texts have all."""
    n = len(text)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.lower().split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = len(words)
    used = histogram[histogram > 0] / max(n, 1)
    return [
        math.log1p(m), *[_share(x, n) for x in histogram @ _MEMBER], math.log1p(sum(map(len, words)) / max(m, 1)),
        _share(len(set(words)), m), _share(len(set(zip(words, words[1:], words[2:]))), max(m - 2, 0)),
        _share(len(set(lines)), len(lines)), _share(sum(w in _STOP for w in words), m), float(-(used * np.log2(used)).sum()),
    ]


@dataclass(frozen=True)
class Model:
    """Per class: log prior with half the log determinant taken off, mean, and the inverse of the Cholesky factor."""

    offsets: tuple[float, float]
    means: np.ndarray
    factors: np.ndarray
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the difference of the log densities, Mahalanobis distances by the cached factors."""
        density = []
        for offset, mean, factor in zip(self.offsets, self.means, self.factors, strict=True):
            z = (x - mean) @ factor.T
            density.append(offset - 0.5 * (z * z).sum(axis=1))
        gap = np.clip((density[1] - density[0]) / self.temperature, -500, 500)
        return 1 / (1 + np.exp(-gap))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (struct of all columns of docs) and x (array of the features of the whole text; null as empty)."""

    def start() -> Callable[[list[bytes]], list[list]]:
        return lambda batch: [[features(t) for t in batch]]

    return rows.map_texts(docs, text, start, [T.StructField("x", T.ArrayType(T.DoubleType()))])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, sums and sums of products of each class in one task, as rows (label, i, v)."""
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, d)
        for c in (0, 1):
            own = x[label == c]
            total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    label, i = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays(
        [pa.array(label.ravel(), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(total.ravel())],
        names=["label", "i", "v"])


def fit(labelled: DataFrame, shrinkage: float = 0.2, temperature: float = 4.0) -> Model | None:
    """Model of labelled (x, label 0 or 1): all rows count, as sums that Spark adds up. None if a class has no row.

    Each class covariance is shrunk towards the diagonal of the pooled one, with a small part of the mean variance, so
    that a statistic that is constant in a class doesn't make it singular. Repeated rows count each time.
    """
    d = len(FEATURES)
    sums = np.zeros((2, 1 + d + d * d))
    added = rows.map_arrow(labelled.select("x", F.col("label").cast("int")), _moments, "label int, i int, v double")
    for r in added.groupBy("label", "i").agg(F.sum("v").alias("v")).collect():  # 2 x 324 rows at any size
        sums[r["label"], r["i"]] = r["v"]
    n = sums[:, 0]
    if not n.all():
        return None
    means = sums[:, 1:1 + d] / n[:, None]
    scatter = sums[:, 1 + d:].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = np.diag(scatter.sum(axis=0)) / n.sum()
    target = np.diag(pooled + 1e-3 * pooled.mean() + 1e-6)
    offsets, factors = [], []
    for c in (0, 1):
        lower = np.linalg.cholesky((1 - shrinkage) * scatter[c] / n[c] + shrinkage * target)
        offsets.append(float(math.log(n[c] / n.sum()) - np.log(np.diag(lower)).sum()))
        factors.append(np.linalg.inv(lower))
    return Model((offsets[0], offsets[1]), means, np.array(factors), temperature)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from. A null id is in another one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
           shrinkage: float = 0.2, temperature: float = 4.0) -> DataFrame:
    """doc_id, held_out, score: one row for each row of docs; null and empty texts are scored by their statistics.

    Learns from labels outside the held-out fold that are 0 or 1; without rows of both, every score is 0.5. Only
    statistics meet the labels: texts are read once and not shuffled.
    """
    table = rows.landed(statistics(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), "t").select(
        F.col("row.d").alias("doc_id"), "x"))
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).filter(
        F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    model = fit(table.join(marks, "doc_id"), shrinkage, temperature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    schema = T.StructType([table.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return rows.map_arrow(table, run, schema).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
