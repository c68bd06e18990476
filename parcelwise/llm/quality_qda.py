"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Each class has a mean and a covariance of transformed statistics, from sums over all its labelled documents.
Covariances are shrunk towards the pooled one and a scaled identity. A score compares the log densities of both
classes; the Mahalanobis distances use Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm import stats
from parcelwise.llm import words as W
from parcelwise.llm.tables import crc_mod

FOLDS, HELD_OUT = 5, 0
TO_POOLED, TO_IDENTITY = 0.1, 0.01
TEMPER = 0.25  # weight of a log density difference, as the statistics are not independent normals
THRESHOLD = 0.3
_D = len(stats.FEATURES)
_N_SUMS = 1 + _D + _D * _D


def _transformed(rows: list[list[float]]) -> np.ndarray:
    """Shares and rates on a scale on which small ones differ."""
    x = np.array(rows, float).reshape(-1, _D)
    x[:, 1:] = np.log(x[:, 1:] + 0.01)
    return x


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its id and transformed statistics."""
    for ids, texts in W.rows_of(batches):
        x = _transformed([stats.document(t)[1] for t in texts])
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class the count, the sums and the sums of products."""
    sums = np.zeros((2, _N_SUMS))
    for batch in batches:
        rows, labels = batch.columns
        x, y = rows.flatten().to_numpy().reshape(-1, _D), labels.to_numpy(zero_copy_only=False)
        for k in (0, 1):
            mine = x[y == k]
            sums[k] += np.concatenate([[len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()])
    at = np.flatnonzero(sums)
    yield pa.record_batch([pa.array(at), pa.array(sums.ravel()[at])], names=["at", "value"])


@dataclass
class Model:
    mean: np.ndarray  # (2, d)
    factor: np.ndarray  # (2, d, d) inverse Cholesky factors
    offset: np.ndarray  # (2,) log prior less half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, offset in zip(self.mean, self.factor, self.offset, strict=True):
            far = (x - mean) @ factor.T
            logs.append(offset - 0.5 * (far * far).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(TEMPER * (logs[0] - logs[1]), -700, 700)))


def fit(count: np.ndarray, total: np.ndarray, product: np.ndarray) -> Model:
    """The model of class counts (2,), sums (2, d) and sums of products (2, d, d).

    A class without rows takes the pooled mean and covariance, so that only its prior, smoothed by one row, speaks.
    """
    n = max(1.0, count.sum())
    pooled_mean = total.sum(axis=0) / n
    mean = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], pooled_mean)
    scatter = [product[k] - count[k] * np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n
    d = len(pooled_mean)
    factors, offsets = [], []
    for k in (0, 1):
        own = scatter[k] / count[k] if count[k] > 1 else pooled
        cov = (1 - TO_POOLED) * own + TO_POOLED * pooled
        cov = (1 - TO_IDENTITY) * cov + TO_IDENTITY * (np.trace(cov) / d + 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log((count[k] + 1) / (n + 2)) - np.log(np.diag(lower)).sum())
    return Model(mean, np.array(factors), np.array(offsets))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model for ``quality`` from all labelled documents outside the held-out fold.

    Statistics are taken before the join, so that they and not the texts are shuffled. Only sums of a fixed number
    reach the driver, whatever the number of rows. Labels other than 0 and 1 are ignored.
    """
    labels = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .where(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.min("quality").cast("long").alias("label"))
    )
    sums = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .where(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
        .mapInArrow(_features, "doc_id long, x array<double>")
        .join(labels, "doc_id")
        .select("x", "label")
        .mapInArrow(_moments, "at long, value double")
        .groupBy("at")
        .agg(F.sum("value").alias("value"))
        .toPandas()  # 2 * (1 + d + d * d) rows at most
    )
    flat = np.zeros(2 * _N_SUMS)
    flat[sums["at"].to_numpy(np.int64)] = sums["value"].to_numpy()
    flat = flat.reshape(2, _N_SUMS)
    return fit(flat[:, 0], flat[:, 1 : 1 + _D], flat[:, 1 + _D :].reshape(2, _D, _D))


def _scored(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in W.rows_of(batches):
            scores = model.score(_transformed([stats.document(t)[1] for t in texts]))
            # Rounded, so that the order in which sums were added does not show.
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.round(scores, 6))], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs`` (``doc_id``, ``text``).

    Null and empty texts are scored by statistics of 0 words; null ids stay null and count as the empty text for the
    fold. Repeated rows score alike, an empty table gives no rows, further columns are ignored.
    """
    return (
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(_scored(model), "doc_id long, score double")
        .select(
            "doc_id",
            (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
            "score",
            (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        )
    )
