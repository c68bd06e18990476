"""Quality rules as gradient-boosted trees over document statistics.

The trees are fitted to labelled rows with histogram splits and logistic loss; chosen statistics may only
lower a document's odds. All trees are flattened into numpy node arrays, which score a batch of documents by
a few vector steps per level.
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

MAX_TRAINING_ROWS = 20_000  # labelled rows the trees are fitted to, by hash of the id
ROUNDS, DEPTH, BINS, RATE, PENALTY, LEAST_WEIGHT = 60, 3, 64, 0.2, 1.0, 2.0
THRESHOLD = 0.5
# More of these never makes a document better.
FALLING = ("symbols_per_word", "dup_line_share", "repeat_share", "mark_share", "top_share", "echo_share")
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


@dataclass
class Trees:
    """Complete trees of one depth; node ``i`` has children ``2i + 1`` and ``2i + 2``."""

    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # values up to the cut go left
    leaf: np.ndarray  # (trees, leaves)
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        inner, depth = self.feature.shape[1], self.leaf.shape[1].bit_length() - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def _best_split(
    binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, low: float, high: float, monotone: np.ndarray
) -> tuple[float, int, int, float, float]:
    """Gain, feature, bin, and the values left and right, kept within the bounds and the constraints."""
    best = (1e-9, 0, BINS, 0.0, 0.0)
    whole_g, whole_h = grad.sum(), hess.sum()
    loss = lambda g, h, v: g * v + 0.5 * (h + PENALTY) * v * v
    own = np.clip(-whole_g / (whole_h + PENALTY), low, high)
    for k in range(binned.shape[1]):
        g = np.cumsum(np.bincount(binned[:, k], grad, BINS))[:-1]
        h = np.cumsum(np.bincount(binned[:, k], hess, BINS))[:-1]
        left = np.clip(-g / (h + PENALTY), low, high)
        right = np.clip(-(whole_g - g) / (whole_h - h + PENALTY), low, high)
        gain = loss(whole_g, whole_h, own) - loss(g, h, left) - loss(whole_g - g, whole_h - h, right)
        allowed = (h >= LEAST_WEIGHT) & (whole_h - h >= LEAST_WEIGHT) & ((right - left) * monotone[k] >= 0)
        gain = np.where(allowed, gain, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), k, at, float(left[at]), float(right[at]))
    return best


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray) -> Trees:
    """Trees for labels 0 and 1; ``monotone`` has -1, 0 or 1 for each column.

    A constraint holds within a split, and the bounds handed to both sides keep it for all that follows. Without
    rows, or with one class, the trees say the smoothed share of label 1.
    """
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(np.unique(y)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)], axis=1)
    features, values, ends = [], [], []
    margin = np.full(len(y), start)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        nodes = {0: (np.arange(len(y)), -np.inf, np.inf, 0.0)}
        for node in range(inner):
            rows, low, high, value = nodes.pop(node)
            gain, k, at, left, right = _best_split(binned[rows], grad[rows], hess[rows], low, high, monotone)
            goes_left = np.ones(len(rows), bool)
            if node == 0 and at == BINS:
                break
            if at < BINS and at < len(cuts[k]):
                feature[node], cut[node] = k, cuts[k][at]
                goes_left = binned[rows, k] <= at
            else:
                left = right = value
            middle = (left + right) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            for child, chosen, v, (a, b) in zip(
                (2 * node + 1, 2 * node + 2),
                (goes_left, ~goes_left),
                (left, right),
                bounds.get(int(monotone[k]) if at < BINS else 0, ((low, high), (low, high))),
                strict=True,
            ):
                nodes[child] = (rows[chosen], a, b, v)
        if not nodes:
            break
        for node, (rows, _, _, value) in nodes.items():
            leaf[node - inner] = RATE * value
            margin[rows] += RATE * value
        features.append(feature)
        values.append(cut)
        ends.append(leaf)
    if not features:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    return Trees(np.array(features), np.array(values), np.array(ends), start)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts, labels in W.rows_of(batches):
        rows = [stats.document(t)[1] for t in texts]
        columns = [pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int64())]
        yield pa.record_batch(columns, names=["doc_id", "x", "label"])


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """Trees for ``quality`` from at most ``MAX_TRAINING_ROWS`` labelled documents, the first by hash of their id.

    Of several rows with one id the one with the least statistics counts, so no id sends more than one row to the driver.
    """
    labels = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").cast("long").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_TRAINING_ROWS)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(labels), "doc_id")  # at most MAX_TRAINING_ROWS rows
        .select(F.col("doc_id").cast("long"), "text", "label")
        .mapInArrow(_features, "doc_id long, x array<double>, label long")
        .groupBy("doc_id")
        .agg(F.min(F.struct("x", "label")).alias("row"))
        .select("row.*")
        .toPandas()
    )
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(stats.FEATURES))
    order = np.lexsort(x.T)  # the same trees for any order of rows
    monotone = np.array([-1 if f in FALLING else 0 for f in stats.FEATURES])
    return fit(x[order], rows["label"].to_numpy(float)[order], monotone)


def _verdicts(trees: Trees) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in W.rows_of(batches):
            both = [stats.document(t) for t in texts]
            counts = np.array([b for b, _ in both], np.int64)
            scores = trees.score(np.array([x for _, x in both]))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            columns = [pa.array(ids, pa.int64()), *(pa.array(c) for c in counts.T.copy())]
            columns += [pa.array(failed), pa.array(~failed & (scores >= THRESHOLD)), pa.array(scores)]
            yield pa.record_batch(columns, names=["doc_id", *stats.BASE, "base_failed", "kept", "score"])

    return run


def judge(docs: DataFrame, trees: Trees) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``) its counts, ``base_failed``, ``kept`` and ``score``.

    The base refuses documents of fewer than ``MIN_WORDS`` words or with more than ``MAX_REPEAT_PERCENT`` of their
    words in repeated 5-word windows; the trees keep the others from a score of ``THRESHOLD``. Null and empty
    texts count 0 everywhere and fail the base; null ids stay null; repeated rows are judged alike; an empty table
    gives no rows; further columns are ignored.
    """
    counts = ", ".join(f"{c} long" for c in stats.BASE)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _verdicts(trees), f"doc_id long, {counts}, base_failed boolean, kept boolean, score double"
    )
